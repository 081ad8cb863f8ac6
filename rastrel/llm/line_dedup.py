"""Line dedup on sharded cuckoo filters that exact reference-count tables back.

The index has, for each shard of the key hashes, a table of keys with the number of documents that hold each, and a
cuckoo filter of the keys that reached the limit. Adding and removing documents changes the counts, and a key that
crosses the limit enters or leaves its shard's filter, so what was added can be taken back exactly. To drop lines,
a document's keys are looked up in the filters, and the hits alone in the exact table: its most frequent keys lie with the
filters in memory, the others meet the hits by shuffle, in which for that reason no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import WS_BYTES, least_count, mapped, materialise, table

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys of a shard, about; the number of shards follows from the number of keys.
SHARD_KEYS = 1_000_000
#: So many keys at the limit (16 bytes each), the most frequent, go to every worker; hits of the filters meet the others by shuffle.
BROADCAST_KEYS = 500_000
#: Bytes of filters that go to every worker at once; where there are more, documents are read once for each such part.
FILTER_BYTES = 64 << 20
#: Keys that a task counts before it hands them on.
FLUSH = 200_000
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; a key's two buckets follow from its hash alone, so keys can be deleted."""

    def __init__(self, buckets: int, data: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if data is None else data

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8)))))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these keys; it grows until all fit."""
        room = len(keys)
        while True:
            f = cls.sized(room)
            if all(f.insert(int(k)) for k in keys):
                return f
            room = f.buckets * SLOTS + 1

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        one = h & np.uint64(self.buckets - 1)
        return mark.astype(np.uint16), one, one ^ (mark * np.uint64(0x5BD1E995) & np.uint64(self.buckets - 1))

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(h)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def insert(self, h: int) -> bool:
        mark, one, two = (int(x[0]) for x in self.places(np.array([h & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        for b in (one, two):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = mark
                return True
        b = two
        for turn in range(500):  # the mark in a slot moves to its other bucket
            slot = turn % SLOTS
            mark, self.slots[b, slot] = int(self.slots[b, slot]), mark
            b ^= mark * 0x5BD1E995 & (self.buckets - 1)
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = mark
                return True
        return False

    def delete(self, h: int) -> None:
        mark, one, two = (int(x[0]) for x in self.places(np.array([h & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        for b in (one, two):
            at = np.flatnonzero(self.slots[b] == mark)
            if len(at):
                self.slots[b, at[0]] = 0
                return


def line_key(line: bytes) -> bytes:
    return line.strip(WS_BYTES).lower()  # bytes.lower() changes A-Z alone


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def key_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (128-bit hash of a line key), n: documents that hold it. Tasks count before the shuffle."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = _pairs(list(seen))
            out = pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(seen.values()), pa.int64())], names=["h1", "h2", "n"])
            seen.clear()
            return out

        for batch in it:
            for text in _texts(batch):
                keys = {line_key(x) for x in text.split(b"\n")}
                seen.update(_hash(k) for k in keys if _long_enough(k, min_chars))
                if len(seen) >= FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return mapped(docs.select("text"), count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


@dataclass
class LineIndex:
    """counts: shard, h1, h2, n. filters: shard, buckets, slots (binary) of the shards with keys at the limit."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


_FILTER = "shard int, buckets long, slots binary"


def _filter_row(shard: int, f: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([f.buckets], pa.int64()), "slots": pa.array([f.slots.tobytes()], pa.binary())})


def build(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    counted = materialise(key_counts(docs, min_chars), "line-counts")
    shards = max(1, -(-counted.count() // shard_keys))
    counts = counted.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).select("shard", "h1", "h2", "n")

    def fill(keys: pa.Table) -> pa.Table:
        return _filter_row(keys.column("shard")[0].as_py(), CuckooFilter.of(np.sort(keys.column("h2").to_numpy())))

    filters = materialise(counts.where(F.col("n") >= min_docs).groupBy("shard").applyInArrow(fill, _FILTER), "line-filters")
    return LineIndex(counts, filters, shards, min_docs, min_chars)


def change(index: LineIndex, added: DataFrame | None = None, removed: DataFrame | None = None) -> LineIndex:
    """The index after documents came and others went. Keys at count 0 leave the table; a filter sees its crossings alone."""
    parts = [key_counts(d, index.min_chars).withColumn("n", sign * F.col("n")) for d, sign in ((added, 1), (removed, -1)) if d is not None]
    if not parts:
        return index
    delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    delta = delta.withColumn("shard", F.pmod("h1", F.lit(index.shards)).cast("int")).withColumn("was", F.lit(0).cast("long"))
    both = index.counts.withColumn("was", F.col("n")).unionByName(delta).groupBy("shard", "h1", "h2").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
    both = materialise(both, "line-changed")
    limit = index.min_docs
    crossed = both.where((F.col("n") >= limit) != (F.col("was") >= limit))

    def turn(old: pa.Table, keys: pa.Table) -> pa.Table:
        ups = keys.filter(pc.greater_equal(keys["n"], limit))["h2"].to_pylist() if keys.num_rows else []
        downs = keys.filter(pc.less(keys["n"], limit))["h2"].to_pylist() if keys.num_rows else []
        shard = (old if old.num_rows else keys)["shard"][0].as_py()
        f = CuckooFilter(old["buckets"][0].as_py(), np.frombuffer(old["slots"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy()) if old.num_rows else CuckooFilter.sized(len(ups))
        for k in downs:
            f.delete(k)
        for k in ups:
            if not f.insert(k):
                return _filter_row(shard, CuckooFilter(0))  # full: filled again below
        return _filter_row(shard, f)

    filters = materialise(index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(turn, _FILTER), "line-filters")
    counts = both.where("n > 0").select("shard", "h1", "h2", "n")
    full = filters.where("buckets = 0").select("shard")

    def fill(keys: pa.Table) -> pa.Table:
        return _filter_row(keys.column("shard")[0].as_py(), CuckooFilter.of(np.sort(keys.column("h2").to_numpy())))

    if full.limit(1).count():
        again = counts.join(full, "shard", "left_semi").where(F.col("n") >= limit).groupBy("shard").applyInArrow(fill, _FILTER)
        filters = materialise(filters.where("buckets > 0").unionByName(again), "line-filters")
    return LineIndex(counts, filters, index.shards, index.min_docs, index.min_chars)


class _Filters:
    """Filters of some shards, and the exact keys that lie beside them."""

    def __init__(self, filters: dict[int, tuple[int, bytes]], exact: bytes, shards: int, min_chars: int):
        self.filters = {s: CuckooFilter(b, np.frombuffer(x, np.uint16).reshape(-1, SLOTS)) for s, (b, x) in filters.items()}
        self.exact = {exact[i : i + 16] for i in range(0, len(exact), 16)}
        self.shards, self.min_chars = shards, min_chars

    def hits(self, keys: list[bytes], digests: list[bytes]) -> np.ndarray:
        """Which of the keys pass their filters and are long enough."""
        h = _pairs(digests)
        hit, shard = np.zeros(len(keys), bool), h[:, 0] % self.shards  # numpy's % is not negative here, as pmod
        for s, f in self.filters.items():
            of = np.flatnonzero(shard == s)
            hit[of] = f.contains(h[of, 1])
        for i in np.flatnonzero(hit).tolist():
            hit[i] = _long_enough(keys[i], self.min_chars)
        return hit


def _kept(batch: pa.RecordBatch, carry: tuple[str, ...], lines_of: list[list[bytes]], gone_of: list[list[bool]]) -> pa.RecordBatch:
    texts = [b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g).decode() for lines, gone in zip(lines_of, gone_of, strict=True)]
    made = [pa.array(texts, pa.string()), pa.array([len(x) for x in lines_of], pa.int64()), pa.array([sum(x) for x in gone_of], pa.int64())]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *made], names=[*carry, "text", "n_lines", "n_dropped"])


def drop_lines(index: LineIndex, docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), broadcast_keys: int = BROADCAST_KEYS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Every document without the lines whose keys reached the index's limit.

    docs: text and the columns of `carry`; others are ignored, whatever their names. Returns carry..., text (the kept
    lines, joined by \\n), n_lines, n_dropped. A null or empty text is one empty line; empty keys are below one code
    point and stay; a key in exactly the limit's number of documents goes; each row is a document, also one that repeats
    another; very long texts and lines are read whole, in time in proportion; an empty table gives an empty result.
    """
    hot = index.counts.where(F.col("n") >= index.min_docs)
    schema = docs.select(*carry).schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    spark, shards, min_chars = docs.sparkSession, index.shards, index.min_chars
    least = least_count(hot, "n", broadcast_keys)
    frequent = hot.where(F.col("n") >= least) if least is not None else hot.limit(0)
    exact = b"".join(np.array([r.h1, r.h2], "<i8").tobytes() for r in frequent.select("h1", "h2").collect())
    parts = max(1, -(-int(index.filters.agg(F.sum(F.col("buckets") * 2 * SLOTS)).first()[0] or 0) // filter_bytes))
    every = hot.agg(F.min("n")).first()[0] == least and parts == 1

    def sent_of(part: int):
        return spark.sparkContext.broadcast(({r.shard: (r.buckets, bytes(r.slots)) for r in index.filters.where(F.col("shard") % parts == part).collect()}, exact, shards, min_chars))

    def drop(sent):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Filters(*sent.value)
            for batch in it:
                lines_of = [x.split(b"\n") for x in _texts(batch)]
                keys = [line_key(x) for lines in lines_of for x in lines]
                digests = [_hash(k) for k in keys]
                hit = known.hits(keys, digests).tolist()
                gone, at = [h and d in known.exact for h, d in zip(hit, digests, strict=True)], np.cumsum([0, *map(len, lines_of)]).tolist()
                yield _kept(batch, carry, lines_of, [gone[a:b] for a, b in zip(at, at[1:], strict=False)])

        return run

    if every:
        return mapped(docs.select(*carry, *(["text"] if "text" not in carry else [])), drop(sent_of(0)), schema)

    def find(sent):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each document's distinct keys that pass the filters; sure: they are among the exact ones at hand."""
            known = _Filters(*sent.value)
            for batch in it:
                keys_of = [sorted({line_key(x) for x in text.split(b"\n")}) for text in _texts(batch)]
                keys = [k for x in keys_of for k in x]
                digests = [_hash(k) for k in keys]
                at = np.flatnonzero(known.hits(keys, digests))
                rid = np.repeat(batch.column("rid").to_numpy(), [len(x) for x in keys_of])[at]
                h, sure = _pairs(digests)[at], [digests[i] in known.exact for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(sure, pa.bool_())], names=["rid", "h1", "h2", "sure"])

        return run

    own = [f"_{i}" for i in range(len(carry))]
    rows = materialise(docs.select(*[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)], "text", F.monotonically_increasing_id().alias("rid")), "line-rows")
    found = None
    for part in range(parts):
        one = mapped(rows.select("rid", "text"), find(sent_of(part)), "rid long, h1 long, h2 long, sure boolean")
        found = one if found is None else found.unionByName(one)
    found = materialise(found, "line-hits")
    rest = hot.where(F.col("n") < least) if least is not None else hot
    gone = found.where("sure").select("rid", "h1", "h2").unionByName(found.where("not sure").select("rid", "h1", "h2").join(rest.select("h1", "h2"), ["h1", "h2"], "left_semi"))
    gone = gone.groupBy("rid").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))

    def strike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            named = pa.RecordBatch.from_arrays([batch.column(o) for o in own], names=list(carry))
            lines_of, gone_of = [x.split(b"\n") for x in _texts(batch)], []
            for lines, out in zip(lines_of, batch.column("gone").to_pylist(), strict=True):
                away = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in out or ()}
                gone_of.append([bool(away) and _hash(k) in away and _long_enough(k, min_chars) for k in map(line_key, lines)])
            yield _kept(named, carry, lines_of, gone_of)

    return mapped(rows.join(gone, "rid", "left").select(*own, "text", "gone"), strike, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(build(docs), docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_ABC}) AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hot.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY rid, doc_id
"""
