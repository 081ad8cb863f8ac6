"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key scaled by its quality weight; within a source the documents in order of
that key are prefix-summed, and the source's token budget takes whole epochs first and then the head of that order.
The order is never built as a whole: keys fall in buckets whose sizes are summed, the bucket of a source in which its
budget ends is cut into finer ones until it is small, and only that is sorted. Rows that tie in key, id and text are told
apart by a number of their own, so a budget can end between them. A source with a third of all rows, or one document
repeated as often, costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrel.llm.common import materialise, table, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A level cuts each bucket of the one before into 2 to this power; keys have 48 bits for that, and so have rows that tie.
LEVEL_BITS, BITS = 12, 48
#: Rows of a source that one task sorts, at most.
EDGE_ROWS = 100_000
#: Up to so many sources their plan is broadcast (about 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
SEED = "mix1"


def quality(n_words, word_chars):
    """Quality weight in (0, 1]: falls as the mean length of a word leaves 5."""
    return F.when(n_words > 0, 1.0 / (1.0 + F.abs(word_chars / n_words - 5.0) / 5.0)).otherwise(F.lit(1.0))


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """_0, _1, ... (the columns of carry), _id, _src (source key), _size, _place (sampling key, id, md5 of the text, number
    of the row), and _at: 48 bits each of the key's place and of the row's, of every document; written as a table."""
    w = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)], F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.coalesce("text", F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    w = w.withColumn("_w", words(F.col("_text")))
    source = F.concat(F.when(F.col("_source").isNull(), "1").otherwise("0"), F.coalesce("_source", F.lit("")))
    keep = [f"_{i}" for i in range(len(carry))]
    out = w.select(*keep, "_id", "_row", source.alias("_src"), F.size("_w").cast("long").alias("_size"), F.md5(F.col("_text").cast("binary")).alias("_tie"), quality(F.size("_w"), F.length(F.array_join("_w", ""))).alias("_quality"))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_tie").cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    out = out.withColumn("_key", -F.log(u) / F.col("_quality"))
    at = F.least(F.lit(2**BITS - 1), F.floor(float(2**BITS) * (1.0 - F.exp(-F.col("_key"))))).cast("long")
    rows = F.shiftrightunsigned(F.xxhash64("_row"), 64 - BITS)
    place = F.struct(F.col("_key").alias("key"), F.col("_id").alias("id"), F.col("_tie").alias("tie"), rows.alias("row"))
    return materialise(out.select(*keep, "_id", "_src", "_size", place.alias("_place"), F.struct(at.alias("key"), rows.alias("row")).alias("_at")), "mix-sized")


def bucket(level: int):
    """The bucket of a level: by the key's place for the first levels, then, of one place alone, by the row's."""
    of_key = BITS // LEVEL_BITS
    if level <= of_key:
        return F.struct(F.shiftright("_at.key", BITS - LEVEL_BITS * level).alias("a"), F.lit(-1).cast("long").alias("b"))
    return F.struct(F.col("_at.key").alias("a"), F.shiftright("_at.row", BITS - LEVEL_BITS * (level - of_key)).alias("b"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (src, ...) with rank, from 0 in code point order; sorted over many tasks, each of which counts its own."""
    s = sources.orderBy("src").withColumn("at", F.monotonically_increasing_id())
    s = materialise(s, "mix-sources")
    task, per = F.shiftright("at", 33), W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # rows: tasks
    ahead = s.groupBy(task.alias("task")).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(per), F.lit(0)))
    return s.join(F.broadcast(ahead.select("task", "ahead")), task == F.col("task")).withColumn("rank", F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "task", "ahead")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size and its target in words, by water filling.

    What is over the open sources' weights is their level; sources whose share of that level is `most` times their size
    or more are full, and the rest is reshared until none is.
    """
    s = sizes.groupBy(F.col("_src").alias("src")).agg(F.sum("_size").alias("source_size"))
    s = _ranked(s)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    s = materialise(s.select("src", "source_size", "weight", "cap"), "mix-weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, known = None, None
    while True:
        full = F.lit(False) if level is None else F.col("cap") * level[1] <= F.col("weight") * level[0]
        got = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if got[2] == known or not got[1]:
            break
        known, level = got[2], (share * total - (got[0] or 0.0), float(got[1]))
    if level is None:
        return s.select("src", "source_size", F.lit(0.0).alias("target"))
    return s.select("src", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level[0] / level[1])).alias("target"))


def plan(d: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, edge_rows: int = EDGE_ROWS) -> tuple[DataFrame, int]:
    """What each source of sized documents gives, and the level of its edge's buckets: _src, source_size, target, epochs
    (whole ones), edge (the first bucket that isn't wholly in what is left) and cut (the last place within that bucket
    that is in)."""
    goal = targets(d, weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialise(goal.select(F.col("src").alias("_src"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")), "mix-goals")
    last = d.select("_src", "_size", "_place", "_at").join(goal.select("_src", "rest", F.lit(0).cast("long").alias("before")), "_src")
    for level in range(1, 2 * (BITS // LEVEL_BITS) + 1):
        # Of the bucket that the budget ends in, by the sizes of its buckets.
        buckets = last.groupBy("_src", bucket(level).alias("_bucket")).agg(F.sum("_size").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        buckets = buckets.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)))
        edge = buckets.where(F.col("upto") > F.col("rest")).groupBy("_src").agg(F.min(F.struct("_bucket", "upto", "n", "rows")).alias("e"), F.first("rest").alias("rest"))
        edge = materialise(edge.select("_src", F.col("e._bucket").alias("edge"), (F.col("e.upto") - F.col("e.n")).alias("before"), "rest", F.col("e.rows").alias("rows")), "mix-edges")
        inside = d.select("_src", "_size", "_place", "_at").withColumn("edge", bucket(level)).join(edge, ["_src", "edge"])
        if (edge.agg(F.max("rows")).first()[0] or 0) <= edge_rows:
            break
        last = materialise(inside.select("_src", "_size", "_place", "_at", "rest", "before"), "mix-inside")
    ahead = W.partitionBy("_src").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("_size").over(ahead), F.lit(0))
    # A document is in if at least half of it lies within the rest, which keeps the sum nearest to it.
    cut = inside.withColumn("in", start + F.col("_size") / 2.0 <= F.col("rest")).where("in").groupBy("_src").agg(F.max("_place").alias("cut"))
    goal = goal.join(edge.select("_src", "edge"), "_src", "left").join(cut, "_src", "left")
    return materialise(goal.select("_src", "source_size", "target", "epochs", "edge", "cut"), "mix-plan"), level


def decide(d: DataFrame, plan: DataFrame, level: int, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """Sized documents with their source's source_size and target, and times: how often each is taken."""
    d = d.withColumn("_bucket", bucket(level)).join(F.broadcast(plan) if plan.count() <= broadcast_sources else plan, "_src")
    chosen = F.col("edge").isNull() | (F.col("_bucket") < F.col("edge")) | ((F.col("_bucket") == F.col("edge")) & F.coalesce(F.col("_place") <= F.col("cut"), F.lit(False)))
    return d.withColumn("times", F.when(F.col("_size") > 0, F.col("epochs") + chosen.cast("long")).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, broadcast_sources: int = BROADCAST_SOURCES, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Words that the mix takes of every document: doc_id, size, source_size, target, taken.

    docs: doc_id, text, source, and whatever else (ignored). Null and blank texts have size 0 and are never taken; a null
    doc_id or source counts as a value of its own; rows that repeat all three are documents of their own, and the budget
    may take some of them; a very long text is one document like any other, and is in where at least half of it lies
    within the budget; an empty table gives an empty result. The same rows give the same mix.
    """
    d = sized(docs)
    out = decide(d, *plan(d, weights, share, most, edge_rows), broadcast_sources)
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, carry: tuple[str, ...], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the columns of `carry` of each document, as often as it is taken. Texts are written, not shuffled."""
    d = sized(docs, carry)
    out = decide(d, *plan(d, weights, share, most)).where("times > 0")
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS src,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, src, md5(text) AS tie, len(ws) AS size,
             CASE WHEN len(ws) > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(length(array_to_string(ws, ''))::DOUBLE / len(ws)::DOUBLE - 5.0::DOUBLE) / 5.0::DOUBLE) ELSE 1.0::DOUBLE END AS quality FROM w),
k AS (SELECT *, -ln((('0x' || substr(md5('mix1:' || coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / quality AS key FROM d),
s AS (SELECT src, sum(size)::DOUBLE AS source_size, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight FROM d GROUP BY src),
b AS (SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_weight,
             coalesce(sum(2 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
      FROM s WINDOW o AS (ORDER BY 2 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (budget - cap_before) * weight >= cap * (all_weight - weight_before) AS is_full FROM b),
t AS (SELECT src, source_size, CASE WHEN is_full THEN cap ELSE weight * ((budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY k.src ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
      FROM k JOIN e USING (src))
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (size * (epochs + CASE WHEN start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
