"""SimHash near-dedup with pivot distance tables.

Equal fingerprints are one node. A table holds each node's Hamming distances to reference fingerprints (pivots); by the
triangle inequality two fingerprints that differ in d bits differ by d at most in every coordinate of that table, so
pairs are discarded by their largest coordinate difference, and the survivors are verified bit by bit.

Pairs come from keys under which nodes meet. For links at few bits these are blocks of bits: with 64 bits in b blocks,
two fingerprints that differ in 3 bits agree on b - 3 blocks, so every choice of b - 3 blocks is a key; no link is
lost. For links by similarity, nodes are distinct sets of shingles with 256 bits of fingerprint; a key is one of a short
text's least shingles, of which two such texts always share one, or the hash of a slice of a long text's shingles, of
which they nearly always do. The bits only propose: within what they connect, the Jaccard similarity of the sets decides.
Crowded keys are tiled over tasks. What a key's nodes link to is handed on as trees, not pairs, and components grow from
those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rastrel.llm.common import mapped, materialise, table

SHINGLE = 3
DISTANCE = 3
PIVOTS = 16
#: A key with more nodes than this is split into tiles of half as many.
CROWDED = 4096
#: Up to so many nodes of a key, their pairs are compared along with other keys' and handed on as links.
FEW = 16
#: Up to so many crowded keys (16 bytes each) are broadcast; beyond, nodes meet them by shuffle.
BROADCAST_KEYS = 100_000
#: Further words of 64 bits of fingerprints for links by similarity.
MORE = 3
#: Slices that are keys, of each long text; shingles in a slice, from and (nearly) up to twice as many; texts under so many shingles are short.
SLICES, IN_SLICE, SHORT = 40, 3, 160
#: Standard deviations that the distance of two texts of the given similarity may exceed its mean by.
SLACK = 5.0


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = (text or b"").lower().split()  # bytes: A-Z, and white space [\x20\x09-\x0D], alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    h = b"".join([xxhash.xxh64_digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)])
    return np.frombuffer(h, ">u8").astype(np.uint64)


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    bits, raw = np.zeros(64, np.int64), h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(raw), 8192):
        bits += np.unpackbits(raw[a : a + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big", signed=True)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of what these are hashes of."""
    z = h + np.uint64((turn * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, as a signed long."""
    return _majority(_hashes(text, shingle))


def _keys(h: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Keys of a text's distinct shingle hashes, sorted: -1 or the number of the slice with its level, and a hash.

    Short texts, and those that are as similar as that to a short one, have their least hashes as keys: so many that two
    such texts can't be without a common one. The others have slices. A level halves the slices of the one before; texts
    near the border of two levels have keys of both.
    """
    c: list[int] = []
    k: list[int] = []
    if len(h) <= SHORT / similarity:
        first = h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
        c, k = [-1] * len(first), first.astype(np.int64).tolist()
    if len(h) >= SHORT:
        levels = {int(np.log2(len(h) * x / IN_SLICE)) for x in (1, similarity, 1 / similarity)}
        for level in sorted(levels):
            part = (h >> np.uint64(64 - level)).astype(np.int64)
            n = int(np.searchsorted(part, SLICES))
            starts = np.flatnonzero(np.diff(part[:n], prepend=-1))
            if n:
                c += (level << 8 | part[starts]).tolist()
                k += np.add.reduceat(_mixed(h[:n], MORE + 1), starts).astype(np.int64).tolist()
    return c, k


def _set_id(h: np.ndarray) -> int:
    """Hash of a set of shingle hashes, sorted, as a signed long."""
    return int.from_bytes(xxhash.xxh64_digest(h.astype(">u8").tobytes(), 42), "big", signed=True)


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """carry..., fp of every whole text; for links by similarity, fp is of the set of shingles, with its words of bits (more), keys (c, k) and the text's hash."""
    more = similarity is not None
    schema = docs.select(*carry).schema.add("fp", "long")
    if more:
        schema = schema.add("more", ArrayType(LongType())).add("c", ArrayType(LongType())).add("k", ArrayType(LongType())).add("text_hash", "long")

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp, wide, c, k = [], [], [], []
            for x in batch.column("text").cast(pa.binary()):
                h = _hashes(x.as_py(), shingle)
                if more:
                    h = np.unique(h)
                    wide.append([_majority(_mixed(h, i)) for i in range(MORE + 1)])
                    keys = _keys(h, similarity)
                fp.append(_set_id(h) if more else _majority(h))
                if more:
                    c.append(keys[0])
                    k.append(keys[1])
            made = [pa.array(fp, pa.int64()), *([pa.array(x, pa.list_(pa.int64())) for x in (wide, c, k)] if more else []), *([batch.column("text_hash")] if more else [])]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in carry], *made], names=schema.fieldNames())

    told = [F.xxhash64("text").alias("text_hash")] if more else []
    return mapped(docs.select(*carry, *(["text"] if "text" not in carry else []), *told), make, schema)


def pivots(n: int = PIVOTS, word: int = 0) -> list[int]:
    """Reference fingerprints (a word of 64 bits of each), the same for every table: hashes of their numbers."""
    return [int.from_bytes(xxhash.xxh64_digest(b"pivot %d" % i, 42 + word), "big", signed=True) for i in range(n)]


def pivot_table(nodes: DataFrame, more: bool = False) -> DataFrame:
    """bits (all words of the fingerprint) and far (distances to the pivots) of nodes (fp; more, where they have it)."""
    words = [F.col("more")[i] for i in range(MORE + 1)] if more else [F.col("fp")]
    refs = [pivots(word=w) for w in range(len(words))]
    far = [sum((F.bit_count(x.bitwiseXOR(F.lit(refs[w][p]))) for w, x in enumerate(words)), F.lit(0)).cast("short") for p in range(PIVOTS)]
    return nodes.select("fp", F.array(*words).alias("bits"), F.array(*far).alias("far"))


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks - distance blocks of bits, the mask of their bits, as signed longs."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    made = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def _apart(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)


def _near(bits: np.ndarray, far: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs (a, b) link: not discarded by a coordinate, then verified."""
    for p in range(far.shape[1]):
        left = np.abs(far[a, p] - far[b, p]) <= distance
        a, b = a[left], b[left]
        if not len(a):
            break
    ok = _apart(bits, a, b) <= distance
    return np.stack([a[ok], b[ok]], 1)


def _tree(bits: np.ndarray, far: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links from every node to the first of its component among these nodes."""
    n = len(bits)
    adjacent = np.zeros((n, n), bool)
    for a in range(0, n, 256):
        left = np.ones((min(256, n - a), n), bool)
        for p in range(far.shape[1]):
            left &= np.abs(far[a : a + 256, p, None] - far[None, :, p]) <= distance
        i, j = np.nonzero(left)
        ok = _apart(bits, i + a, j) <= distance
        adjacent[i[ok] + a, j[ok]] = True
    links, new = [], np.ones(n, bool)
    for root in range(n):
        if not new[root]:
            continue
        new[root], front = False, np.array([root])
        while len(front):
            reached = np.zeros(n, bool)
            for a in range(0, len(front), 256):
                reached |= adjacent[front[a : a + 256]].any(0)
            front = np.flatnonzero(reached & new)
            new[front] = False
            links += [(root, int(x)) for x in front]
    return links


def _links(it: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (key columns..., fp, bits, far) that are sorted by key, each key's rows together."""
    rest = None

    def key_of(t: pa.Table) -> np.ndarray:
        return np.stack([t[c].to_numpy().astype(np.int64) for c in t.column_names if c not in ("fp", "bits", "far")], 1)

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, fp = key_of(t), t["fp"].to_numpy()
        bits = t["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)
        far = t["far"].combine_chunks().flatten().to_numpy().astype(np.int16).reshape(len(fp), -1)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        sizes = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), sizes)
        pairs = []
        few = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= FEW))
        last = (starts + sizes)[group]
        for shift in range(1, FEW):
            few = few[few + shift < last[few]]
            if not len(few):
                break
            pairs.append(_near(bits, far, few, few + shift, distance))
        for g in np.flatnonzero(sizes > FEW):
            s = slice(starts[g], starts[g] + sizes[g])
            if tree := _tree(bits[s], far[s], distance):
                pairs.append(np.array(tree) + starts[g])
        if pairs and len(found := np.concatenate(pairs)):
            yield pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], names=["a", "b"])

    for batch in it:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        key = key_of(t)
        inner = np.flatnonzero((key != key[-1]).any(1))  # the last key may go on in the next batch
        cut = int(inner[-1]) + 1 if len(inner) else 0
        if cut:
            yield from work(t.slice(0, cut).combine_chunks())
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield from work(rest)


def block_keys(nodes: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """c, k, fp: the choices of blocks of bits, more of them and with more bits each the more nodes there are."""
    blocks = distance + (2 if n <= 1 << 22 else 3 if n <= 1 << 30 else 4)
    return nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks, distance)])).alias("c", "k")).select(F.col("c").cast("long"), "k", "fp")


def links(keys: DataFrame, known: DataFrame, distance: int, crowded: int = CROWDED, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """a, b: links at `distance` bits among nodes that share a key, enough of them to connect all such.

    keys: c, k, fp; known: fp, bits, far, the pivot table. Keys of one node alone go before anything is attached.
    """
    sizes = materialise(keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    met = keys.join(sizes.where(F.col("n") <= crowded).select("c", "k"), ["c", "k"], "left_semi").join(known, "fp")
    met = met.repartition("c", "k").sortWithinPartitions("c", "k", "fp").select("c", "k", "fp", "bits", "far")
    found = mapped(met, lambda it: _links(it, distance), "a long, b long")
    many = sizes.where(F.col("n") > crowded)
    if n_many := many.count():
        # Each node goes to the pairs of tiles that hold its own: as many as its key has tiles.
        t = keys.join(F.broadcast(many) if n_many <= broadcast_keys else many, ["c", "k"]).join(known, "fp")
        t = t.withColumn("tiles", F.ceil(F.col("n") / (crowded / 2)).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
        t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        t = t.select("c", "k", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "fp", "bits", "far")
        tiled = t.repartition("c", "k", "t1", "t2").sortWithinPartitions("c", "k", "t1", "t2", "fp")
        found = found.unionByName(mapped(tiled, lambda it: _links(it, distance), "a long, b long"))
    return found


def bits_apart(similarity: float, bits: int) -> int:
    """Bits that fingerprints of two equally long texts of this Jaccard similarity differ in, with the slack."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + SLACK * np.sqrt(bits * p * (1 - p)))


def components(found: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it reaches) of all nodes with links. Stars grow towards the smallest node, in both
    directions by turns, until nothing changes; each round's links are a table in the shared folder."""
    now = materialise(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "simhash-links")
    state = None
    for _ in range(rounds):
        # Large star: whatever is above a node links to the smallest that the node reaches.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and what it links to below link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialise(small, "simhash-links")
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(total)
    raise RuntimeError("components didn't settle")


def _alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links, each of that Jaccard similarity or more, from every set to one found before it, as a tree of each component."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(size) - size
    mark, left, links = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool), np.flatnonzero(size), []
    front: list[int] = []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        a = front.pop()
        may = left[(size[left] >= similarity * size[a] - 1e-9) & (size[a] >= similarity * size[left] - 1e-9)]
        if not len(may):
            continue
        mark[flat[first[a] : first[a] + size[a]]] = True
        begins = np.cumsum(size[may]) - size[may]
        at = np.repeat(first[may] - begins, size[may]) + np.arange(int(size[may].sum()))
        common = np.add.reduceat(mark[flat[at]].astype(np.int64), begins)
        mark[:] = False
        hit = may[common >= similarity * (size[a] + size[may] - common) - 1e-9]
        links += [(a, int(x)) for x in hit]
        front += hit.tolist()
        left = left[~np.isin(left, hit)]
    return links


def verified(found: DataFrame, prints: DataFrame, docs: DataFrame, shingle: int, similarity: float, crowded: int = CROWDED) -> DataFrame:
    """a, b: links at that Jaccard similarity of the sets of shingles, enough of them to connect all such within what `found` connects.

    A set goes once to the task of its component, or, where that has more than `crowded` nodes, to the pairs of tiles that hold it.
    """
    near = components(found)
    near = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    sizes = near.groupBy("root").agg(F.count("*").alias("n"))
    near = materialise(near.join(sizes, "root"), "simhash-near")
    one = prints.groupBy("fp").agg(F.min("text_hash").alias("text_hash"))
    near = near.join(one, near["node"] == one["fp"]).drop("fp")
    near = near.withColumn("tiles", F.when(F.col("n") <= crowded, 1).otherwise(F.ceil(F.col("n") / (crowded / 2))).cast("int"))
    near = near.withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    near = materialise(near.select("root", "node", "text_hash", "tiles", "own"), "simhash-near")
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(near.select("text_hash"), "text_hash", "left_semi")
    texts = texts.groupBy("text_hash").agg(F.first("text").alias("text"))

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [np.unique(_hashes(x.as_py(), shingle)).astype(np.int64) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(made, pa.list_(pa.int64()))], names=["text_hash", "h"])

    sets = mapped(texts, make, "text_hash long, h array<long>").join(near, "text_hash")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sets = sets.select("root", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "node", "h")

    def link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(nodes: list, sets: list) -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1 and (tree := _alike(sets, similarity)):
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x[i]] for x in tree], pa.int64()) for i in (0, 1)], names=["a", "b"])

        at, nodes, sets = None, [], []
        for batch in it:
            h = batch.column("h")
            for i, (key, node) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in ("root", "t1", "t2")), strict=True), batch.column("node").to_pylist(), strict=True)):
                if key != at:
                    yield from done(nodes, sets)
                    at, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.array(h[i].values.to_numpy()))
        yield from done(nodes, sets)

    dealt = sets.repartition("root", "t1", "t2").sortWithinPartitions("root", "t1", "t2", "node")
    return mapped(dealt, link, "a long, b long")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, distance: int = DISTANCE, similarity: float | None = None, crowded: int = CROWDED) -> DataFrame:
    """carry..., fp, component_id (the smallest doc_id reachable over links, itself included), root of every document.

    root tells components apart, also those that have no id or share one.

    Fingerprints link at `distance` differing bits of 64; with `similarity`, texts link where their sets of shingles have
    that Jaccard similarity or more, and fp is of the set.
    docs: doc_id, text and the columns of `carry`; others are ignored, whatever their names. Null and blank texts have
    one fingerprint (0, without similarity) and link like others; rows that repeat an id are documents of their own; null ids never name a
    component unless it has none else (then null); an empty table gives an empty result.
    """
    keep, more = tuple(dict.fromkeys((*carry, "doc_id"))), similarity is not None
    prints = materialise(fingerprints(docs, keep, shingle, similarity), "simhash-prints")
    wide = [F.min(F.struct("more", "c", "k")).alias("w")] if more else []
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), *wide)
    nodes = materialise(nodes.select("fp", "least", "w.*") if more else nodes, "simhash-nodes")
    known = materialise(pivot_table(nodes, more), "simhash-pivots")
    if more:
        keys = nodes.select("fp", F.explode(F.arrays_zip("c", "k")).alias("s")).select("s.c", "s.k", "fp")
        found = links(keys, known, bits_apart(similarity, 64 * (MORE + 1)), crowded)
        found = verified(found, prints, docs, shingle, similarity, crowded)
    else:
        found = links(block_keys(nodes, nodes.count(), distance), known, distance, crowded)
    roots = components(found)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(label, "fp").select(*carry, "fp", "component_id", "root")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
