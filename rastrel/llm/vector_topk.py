"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to the pivots are precomputed. For a query q and a vector x, the largest difference of their
distances to one pivot is a lower bound L of their distance, so their inner product is at most (|q|^2 + |x|^2 - L^2) / 2.
Vectors lie in blocks by their nearest pivot; a block's ranges of distances and its largest norm bound what any of its
vectors can reach. A query first gets the k-th best score over the sample that the pivots come from, goes to the blocks
alone whose bound reaches that, and there evaluates candidates in the order of their bounds until one falls below the
k-th best score found. Scores are exact integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrel.llm.common import mapped, materialise, table

TOP = 5
SCALE = 256
#: Ids divisible by this are queries.
EVERY = 50
PIVOTS = 24
#: Vectors, by the order of their ids' hashes, that pivots are chosen from and first thresholds are made of.
SAMPLE = 1024
#: Queries and vectors that meet in one task, about.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 16_384
#: Components of a block of vectors, about, where that makes it smaller, and rows it has all the same.
COMPONENTS, LEAST_BLOCK = 1 << 20, 1024
#: Blocks (some 500 bytes each) whose bounds are broadcast at once; queries go over the blocks in such slabs, each with the scores found so far.
SLAB = 16_384
#: Candidates evaluated between two looks at the bound.
STEP = 64
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """rid (a number of the row), vec_id, dim, v: scale * x of each component, down to the integer below. As doubles these
    are exact."""
    sound = F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))), F.lit(False))
    v = F.transform("embedding", lambda x: _down(x.cast("double") * scale))
    return vectors.where(sound).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), v.alias("v"))


def _down(x):
    """The integer at or below x, as a double also where no long holds it."""
    near = F.rint(x)
    return near - F.when(near > x, 1.0).otherwise(0.0)


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of x by rows of q) of integers held as doubles: longs where those hold them, else Python's."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (x @ q.T).astype(np.int64)
    if most < 2**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2**62:
        return x.astype(np.int64) @ q.T.astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object).reshape(m.shape)
    return whole(x) @ whole(q).T


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The farthest vector from the mean, then again and again the one farthest from those chosen."""
    x = sample.astype(np.float64)
    chosen, far = [], ((x - x.mean(0)) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)):
        at = int(far.argmax())
        d = ((x - x[at]) ** 2).sum(1)
        far = d if not chosen else np.minimum(far, d)
        chosen.append(at)
        if not far.any():
            break
    return sample[chosen]


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray], every: int = EVERY) -> DataFrame:
    """rid, vec_id, dim, v, norm2, far (distances to the pivots of the vector's dimension), cell (its nearest pivot)."""
    schema = "rid long, vec_id long, dim int, v array<double>, norm2 double, far array<double>, cell int"

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x, p = _matrix(part.column("v"), dim), pivots.get(dim, np.zeros((0, dim)))
                with np.errstate(over="ignore"):
                    norm2 = (x * x).sum(1)
                    far = np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in p], 1) if len(p) else np.zeros((len(x), 0))
                cell = far.argmin(1) if len(p) else np.zeros(len(x), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(p), pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("vec_id"), part.column("dim"), part.column("v"), pa.array(norm2), lists, pa.array(cell, pa.int32())], names=["rid", "vec_id", "dim", "v", "norm2", "far", "cell"])

    return mapped(vectors, measure, schema)


def _bounds(qn: np.ndarray, xn: np.ndarray, low: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """At least the inner products, from squared norms, lower bounds of distances, and the distances those come from.

    Rounding moves a distance by some 1e-13 of itself at most (thousands of components); the slack covers that.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        sure = np.maximum(low - 1e-12 * reach, 0)
        both = qn + xn
        out = np.floor((both - sure * sure) / 2 + 1e-12 * both + 1e-6)
    return np.where(np.isnan(out), np.inf, out)


_FOUND = "qid long, query_id long, xid long, vec_id long, score long, beyond string"


def _as_long(s: int) -> tuple[int, str]:
    """The nearest long, and a string that sorts scores by what lies beyond it."""
    if _LEAST <= s <= _MOST:
        return s, "" if s >= 0 else "~"
    digits = str(abs(s))
    if s > 0:
        return _MOST, f"{len(digits):04d}{digits}"
    return _LEAST, f"{9999 - len(digits):04d}{''.join(str(9 - int(c)) for c in digits)}"


def _block(q: pa.Table, x: pa.Table, k: int) -> pa.Table:
    """Each query's k best of one block of vectors, if they can be among its k best of all."""
    rows: list[tuple] = []
    if q.num_rows and x.num_rows:
        dim = q["dim"][0].as_py()
        qv, xv = _matrix(q["v"], dim), _matrix(x["v"], dim)
        qid, xid = q["rid"].to_numpy(), x["rid"].to_numpy()
        q_name, x_name = q["vec_id"].to_numpy(), x["vec_id"].to_pylist()
        name = np.array([_MOST if i is None else i for i in x_name], np.int64)  # ties without an id come last
        qn, xn, least = q["norm2"].to_numpy(), x["norm2"].to_numpy(), q["least"].to_numpy()
        pivots = len(q["far"][0])
        qf, xf = (_matrix(t["far"], pivots) for t in (q, x))
        for a in range(0, len(qid), 64):
            part = slice(a, a + 64)
            low, reach = np.zeros((len(qid[part]), len(xid))), np.zeros((len(qid[part]), len(xid)))
            for p in range(pivots):
                with np.errstate(invalid="ignore"):
                    gap = np.abs(qf[part, p, None] - xf[None, :, p])
                np.maximum(low, np.where(np.isnan(gap), 0, gap), out=low)
                np.maximum(reach, qf[part, p, None] + xf[None, :, p], out=reach)
            bound = _bounds(qn[part, None], xn[None, :], low, reach)
            for i in range(a, min(a + 64, len(qid))):
                of = np.flatnonzero((bound[i - a] >= least[i]) & (xid != qid[i]))
                of = of[np.argsort(-bound[i - a][of], kind="stable")]
                b, best = bound[i - a][of], []
                for at in range(0, len(of), STEP):
                    if len(best) == k and b[at] < -best[-1][0]:
                        break
                    now = of[at : at + STEP]
                    got = _scores(qv[i : i + 1], xv[now])[:, 0]
                    if len(best) == k:
                        hope = np.flatnonzero(got >= -best[-1][0])
                        now, got = now[hope], got[hope]
                    best = sorted([*best, *zip((-got).tolist(), name[now].tolist(), xid[now].tolist(), now.tolist(), strict=True)])[:k]
                rows += [(qid[i], q_name[i], xid[at], x_name[at], *_as_long(-s)) for s, _, _, at in best if -s >= float(least[i])]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (("qid", pa.int64()), ("query_id", pa.int64()), ("xid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string()))
    return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(kinds, cols, strict=True)})


def _routes(sampled: dict, stats: dict, k: int):
    """For queries (rid, vec_id, dim, v, norm2, far, qb, least): a row for each block that may hold one of their k best.

    stats: by dimension, the blocks' names, least and greatest distances to each pivot, and greatest squared norms.
    """

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in stats:
                    continue
                part = batch.filter(pa.array(dims == dim))
                names, lo, hi, top = stats[dim]
                v, rid = _matrix(part.column("v"), dim), part.column("rid").to_numpy()
                far = _matrix(part.column("far"), lo.shape[1])
                least = part.column("least").to_numpy().copy()
                sid, sv = sampled.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                if len(sid) > k:  # the k-th best of a sample is no more than that of all
                    s = _scores(v, sv).T
                    for i in range(len(rid)):
                        kth = float(np.sort(s[i][sid != rid[i]])[-k])
                        least[i] = max(least[i], kth - abs(kth) * 1e-15)
                gap = np.zeros((len(rid), len(names)))
                reach = np.zeros_like(gap)
                with np.errstate(invalid="ignore"):
                    for p in range(lo.shape[1]):
                        f = far[:, p, None]
                        apart = np.maximum(lo[None, :, p] - f, f - hi[None, :, p])
                        np.maximum(gap, np.where(np.isnan(apart), 0, apart), out=gap)
                        np.maximum(reach, f + hi[None, :, p], out=reach)
                bound = _bounds(part.column("norm2").to_numpy()[:, None], top[None, :], gap, reach)
                i, j = np.nonzero(bound >= least[:, None])
                sent = part.take(pa.array(i))
                cols = [sent.column(c) for c in ("rid", "vec_id", "dim", "v", "norm2", "far", "qb")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(least[i]), pa.array(names[j])], names=["rid", "vec_id", "dim", "v", "norm2", "far", "qb", "least", "block"])

    return route


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, slab: int = SLAB) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every query row, ties to the smaller vec_id.

    vectors: vec_id, embedding, and whatever else (ignored). Vectors that are null or hold null or non-finite
    components take no part (nor does a double whose multiple no double holds); all others do, of whatever size: scores are compared exactly, and one beyond a long is given
    as the nearest long. Every row is a candidate for every query but itself: rows that repeat an id are several (each
    one's query has its own ranks), and one without an id is a candidate (ties to it come last) but no query. Vectors meet
    those of their own dimension, also of none, where all scores are 0; a query with fewer than k others gets them all;
    very long vectors are read whole; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = materialise(quantised(vectors, scale), "vectors")
    drawn = base.orderBy(F.xxhash64("vec_id", "rid"), "rid").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(r["dim"], []).append(r)
    sampled = {d: (np.array([r["rid"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(len(rows), d)) for d, rows in by_dim.items()}
    chosen = {d: choose_pivots(v, pivots) for d, (_, v) in sampled.items() if d}
    index = materialise(pivot_table(base, chosen), "vector-pivots")
    # A cell has as many blocks as its vectors need; so no block grows with the data.
    cells = index.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / F.least(F.lit(vector_block), F.greatest(F.lit(LEAST_BLOCK), F.floor(COMPONENTS / F.greatest("dim", F.lit(1)))))).cast("int").alias("parts"))
    cells = cells.withColumn("first", F.coalesce(F.sum("parts").over(W.orderBy("dim", "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # rows: dimensions times pivots
    blocks = index.join(F.broadcast(cells), ["dim", "cell"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rid"), "parts")).cast("long"))
    blocks = materialise(blocks.withColumn("slab", F.floor(F.col("block") / slab).cast("long")).drop("first", "parts"), "vector-blocks")
    asks = index.where(F.col("vec_id") % every == 0)
    # Queries of near cells share a block until it is full, so that vectors are sent to as few blocks as there must be.
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("dim").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # rows: dimensions times pivots
    shares = asks.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.floor(ahead / query_block).alias("qfirst"), F.ceil(F.col("n") / query_block).alias("qs"))
    asks = asks.join(F.broadcast(shares), ["dim", "cell"]).withColumn("qb", (F.col("qfirst") + F.pmod(F.xxhash64("rid"), "qs")).cast("string")).drop("qs", "qfirst", "cell")
    asks = materialise(asks.withColumn("least", F.lit(float("-inf"))), "vector-queries")
    found, slabs = None, (blocks.agg(F.max("slab")).first()[0] or 0) + 1
    for at in range(slabs):
        here = blocks.where(F.col("slab") == at)
        stats = {}
        most = here.groupBy("dim", "block").agg(F.max("norm2").alias("top"))
        ranges = here.select("dim", "block", F.posexplode("far").alias("p", "f")).groupBy("block", "p").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
        ranges = ranges.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("r"))
        for r in most.join(ranges, "block", "left").orderBy("dim", "block").collect():  # rows: a slab's blocks
            stats.setdefault(r["dim"], []).append(r)
        stats = {d: (np.array([r["block"] for r in rows], np.int64), *(np.array([[x[c] for x in r["r"] or ()] for r in rows], np.float64).reshape(len(rows), -1) for c in ("lo", "hi")), np.array([r["top"] for r in rows])) for d, rows in stats.items()}
        route = _routes(sampled, stats, k)
        schema = "rid long, vec_id long, dim int, v array<double>, norm2 double, far array<double>, qb string, least double, block long"
        routed = materialise(mapped(asks, route, schema), "vector-routes")
        pairs = routed.select("qb", "block").distinct()
        x = here.join(pairs, "block")
        x = x.select(*[F.col(c).alias(c) for c in x.columns])  # columns of its own, for the cogroup
        met = routed.groupBy("dim", "qb", "block").cogroup(x.groupBy("dim", "qb", "block")).applyInArrow(lambda a, b: _block(a, b, k), _FOUND)
        best = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("beyond"), F.col("vec_id").asc_nulls_last(), "xid")
        every_ = met if found is None else met.unionByName(found)
        ranked = every_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if at + 1 == slabs:
            return ranked.select("query_id", "rank", "vec_id", "score")
        ranked = materialise(ranked, "vector-found")
        found = ranked.drop("rank")
        kth = ranked.where(F.col("rank") == k).select(F.col("qid").alias("rid"), (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("kth"))
        asks = materialise(asks.join(kth, "rid", "left").withColumn("least", F.greatest("least", F.coalesce("kth", F.lit(float("-inf"))))).drop("kth"), "vector-queries")
    raise AssertionError("no slab is the last")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT rid, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.rid AS qid, q.vec_id AS query_id, c.rid AS cid, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.i = c.i AND q.rid <> c.rid
      WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""
