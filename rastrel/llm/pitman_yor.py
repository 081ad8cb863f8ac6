"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Restaurants of contexts that get shorter, each the child of the next:

* one for every preceding word (a document's end before its first word), over all words;
* one for words without context, the parent of all those, whose customers are their tables;
* its base spells words: restaurants for the two bytes before a byte or the word's end, for the one before, for none, and
  a uniform base. They learn from the tables of words.

So the probability of every text sums to one, words never seen included. Seating, discounts and strengths are sampled in
`restaurants`; what a dish's tables hold and what a restaurant leaves to its parent are averaged over the samples.

All words and all word pairs take part. Tokens stay in chunks; words are dealt to shards by hash, pairs to other shards by
their context, and a chunk asks both for its distinct words and pairs, so a frequent word costs one entry a chunk. A
context with more than SPLIT tokens is dealt to several shards by its words; each of them takes the restaurant's tables to
be its own times their number. Only the byte contexts, 65,793 at most, are in one task and broadcast.

The levels are sampled in blocks: pairs are first seated over the chances that a shard sees; their tables are the
customers of the word restaurant; its tables teach the spelling; words are then seated over that, and pairs over those.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import fresh_path, lean, mapped, materialise, remove_path, table
from rastrel.llm.restaurants import Restaurants, sampled

#: Bytes before a byte that its context has.
ORDER = 2
#: Tokens of a chunk, about.
CHUNK = 2_000_000
#: Shards of words: one for so many documents, and so many at least. Shards of pairs: one for so many tokens.
SHARD_DOCS, LEAST_SHARDS = 8_000, 16
PAIR_TOKENS, LEAST_PAIR_SHARDS = 2_000_000, 8
#: Tokens of a context that go to one shard.
SPLIT = 500_000
BURN_IN, SAMPLES = 3, 4
SEED = 20
#: Symbols of the spelling: bytes, and the end of a word.
BYTES = 257


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted codes among sorted ones, and which are there."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


# --- spelling


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end: code of the ORDER bytes before it (0 before the first) and itself; and the word's first row."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.int64)  # words have no white space
    first = np.cumsum(n) - n
    place = np.arange(len(flat)) - np.repeat(first, n)
    code = np.where(place == np.repeat(n - 1, n), 256, flat)
    for k in range(1, ORDER + 1):
        before = np.concatenate([np.zeros(k, np.int64), flat[:-k]]) if len(flat) > k else np.zeros(len(flat), np.int64)
        code |= np.where(place >= k, before, 0) << (9 + 8 * (k - 1))
    return code, first


class Spelling:
    """For each length of context: sorted codes of dishes in context with their chance beside the parent's, and of contexts
    with what they leave to the parent."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def fit(cls, code: np.ndarray, n: np.ndarray, seed: int = SEED) -> Spelling:
        """From the customers n of codes, sorted, each with its whole context."""
        rng = np.random.default_rng(seed)
        grams, below = [code], []
        for k in range(ORDER - 1, -1, -1):
            shorter = np.unique(grams[0] & ((1 << (9 + 8 * k)) - 1))
            below.insert(0, np.searchsorted(shorter, grams[0] & ((1 << (9 + 8 * k)) - 1)))
            grams.insert(0, shorter)
        contexts = [np.unique(g >> 9, return_inverse=True) for g in grams]
        levels: list[Restaurants] = [None] * (ORDER + 1)
        c = n
        for k in range(ORDER, -1, -1):  # to begin with, each dish has one table
            levels[k] = Restaurants(rng, contexts[k][1], c, len(contexts[k][0]))
            if k:
                c = np.bincount(below[k - 1], levels[k].t, len(grams[k - 1])).astype(np.int64)
        sums = [[np.zeros(len(g)), np.zeros(len(x[0]))] for g, x in zip(grams, contexts, strict=True)]

        def chances() -> list[np.ndarray]:
            p = np.full(len(grams[0]), 1.0 / BYTES)
            out = [p]
            for k, r in enumerate(levels):
                seen, rest = r.shares()
                p = seen + rest[r.at] * p
                out.append(p[below[k]] if k < ORDER else p)
                p = out[-1]
            return out

        for turn in range(BURN_IN + SAMPLES):
            for k in range(ORDER, -1, -1):
                if k < ORDER:  # the tables above are its customers
                    levels[k].refill(np.bincount(below[k], levels[k + 1].t, len(grams[k])))
                levels[k].sweep(chances()[k])
            if turn >= BURN_IN:
                for s, r in zip(sums, levels, strict=True):
                    seen, rest = r.shares()
                    s[0] += seen / SAMPLES
                    s[1] += rest / SAMPLES
        return cls([(g, s[0], x[0], s[1]) for g, s, x in zip(grams, sums, contexts, strict=True)])

    def chances(self, code: np.ndarray) -> np.ndarray:
        p = np.full(len(code), 1.0 / BYTES)
        for k, (gram, seen, context, rest) in enumerate(self.levels):
            g = code & ((1 << (9 + 8 * k)) - 1)
            at, there = _find(context, g >> 9)
            if len(context):
                p = np.where(there, rest[at] * p, p)
            at, there = _find(gram, g)
            p[there] += seen[at[there]]
        return p

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Of each word's spelling and end."""
        if not words:
            return np.zeros(0)
        code, first = _spelled(words)
        distinct, at = np.unique(code, return_inverse=True)
        return np.add.reduceat(np.log10(self.chances(distinct))[at], first)


# --- blobs


def _pack(x, kind: str) -> bytes:
    """Numbers in planes of bytes, compressed."""
    x = np.asarray(x).astype(kind)
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1) if len(x) else b""


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers, as differences."""
    return _pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)), "<u8")


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<u8"), dtype=np.uint64)


def _words(words: list[bytes]) -> bytes:
    return zlib.compress(b"\n".join(words), 1)


def _unwords(blob: bytes) -> list[bytes]:
    return zlib.decompress(blob).split(b"\n")


#: Rows that go to a chunk, a shard of words (w) or a shard of pairs (p): what they are, from whom, and their numbers.
_ROW = "chunk string, shard int, kind string, other int, a binary, b binary, c binary, doc_id array<long>, held_out array<boolean>, lengths array<int>"
_TYPES = {"chunk": pa.string(), "shard": pa.int32(), "kind": pa.string(), "other": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32())}


def _table(rows: list[dict]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in _TYPES.items()})


def _rows(t: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in t.to_pylist():
        out.setdefault(r["kind"], []).append(r)
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table by kind, so that each kind is read alone."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    return spark.read.schema(_ROW).parquet(path)


def _gone(df: DataFrame, kind: str | None = None) -> None:
    """Removes a written table, or its rows of a kind, that nothing needs any longer."""
    for folder in {f.rpartition("/")[0] for f in (df if kind is None else df.where(F.col("kind") == kind)).inputFiles()}:
        if kind is None or folder.endswith(f"kind={kind}"):
            remove_path(df.sparkSession, folder)


# --- chunks and words


def chunked(docs: DataFrame, shards: int, chunk: int = CHUNK) -> DataFrame:
    """Rows "chunk" (a: ids of its tokens among its words, an end, the word b"", behind each document; b: the words' shards)
    and "words" (to a shard of words; a: words, b: their tokens to learn from). Frequent words have small ids.

    docs: doc_id (long), held_out, text.
    """

    def close(vocabulary: dict[bytes, int], ids: list[np.ndarray], lengths: list[np.ndarray], doc_ids: list, held: list[bool]) -> pa.RecordBatch:
        name, words, flat, lengths = uuid.uuid4().hex, list(vocabulary), np.concatenate(ids), np.concatenate(lengths)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words, flat = [words[i] for i in order.tolist()], place[flat]
        shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in words), np.int64, len(words))
        counts = np.bincount(flat[~np.repeat(np.array(held, bool), lengths)], minlength=len(words))
        rows = [{"chunk": name, "kind": "chunk", "a": _pack(flat, "<u4"), "b": _pack(shard, "<u4"), "doc_id": doc_ids, "held_out": held, "lengths": lengths.tolist()}]
        by_shard = np.argsort(shard, kind="stable")
        for s, at in zip(np.unique(shard).tolist(), np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1), strict=True):
            rows.append({"chunk": name, "kind": "words", "shard": s, "a": _words([words[i] for i in at.tolist()]), "b": _pack(counts[at], "<u4")})
        return _table(rows).combine_chunks().to_batches()[0]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: ({b"": 0}, [], [], [], [])
        (vocabulary, ids, lengths, doc_ids, held), n = new(), 0
        for batch in it:
            texts = pc.fill_null(batch.column("text"), "")
            parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))  # A-Z, and white space [\x20\x09-\x0D], alone
            coded = parts.values.dictionary_encode()
            distinct, code, at = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), parts.offsets.to_numpy()
            blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)  # split to one empty word
            size = np.where(blank, 0, np.diff(at)) + 1
            doc_id, out, a = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), 0
            while a < batch.num_rows:
                b = min(batch.num_rows, a + 1 + int(np.searchsorted(np.cumsum(size[a:]), chunk - n)))
                slice_, used = code[at[a] : at[b]], np.zeros(len(distinct), bool)
                used[slice_] = True
                place = np.zeros(len(distinct), np.int64)
                for i in np.flatnonzero(used).tolist():
                    place[i] = vocabulary.setdefault(distinct[i], len(vocabulary))
                kept = slice_[np.repeat(~blank[a:b], np.diff(at[a : b + 1]))]
                ids.append(np.insert(place[kept], np.cumsum(size[a:b] - 1), 0))
                lengths.append(size[a:b])
                doc_ids += doc_id[a:b]
                held += out[a:b]
                n, a = n + int(size[a:b].sum()), b
                if n >= chunk:
                    yield close(vocabulary, ids, lengths, doc_ids, held)
                    (vocabulary, ids, lengths, doc_ids, held), n = new(), 0
        if doc_ids:
            yield close(vocabulary, ids, lengths, doc_ids, held)

    return _written(mapped(docs.select("doc_id", "held_out", "text"), run, _ROW), "lm-chunks")


def _gathered(t: pa.Table) -> pa.Table:
    """A shard of words: "vocabulary" (a: distinct words, frequent ones first, then in byte order, b: their counts) and, for
    each chunk, "codes" (a: its words' places among them, b: their counts)."""
    asked = t.to_pylist()
    lists = [_unwords(r["a"]) for r in asked]
    counts = np.concatenate([_unpack(r["b"], "<u4") for r in asked]).astype(np.int64)
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    distinct, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n = np.bincount(code, counts, len(distinct)).astype(np.int64)
    order = pc.sort_indices(distinct).to_numpy().astype(np.int64)
    order = order[np.argsort(-n[order], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code, n = rank[code], n[order]
    words = distinct.take(pa.array(order)).to_pylist()
    shard = asked[0]["shard"]
    rows = [{"shard": shard, "kind": "vocabulary", "other": len(words), "a": _words(words), "b": _pack(n, "<u8"), "lengths": [int((n > 0).sum())], "doc_id": [int(n.sum())]}]
    ends = np.cumsum([len(x) for x in lists])
    for r, a, b in zip(asked, np.concatenate([[0], ends[:-1]]), ends, strict=True):
        rows.append({"chunk": r["chunk"], "shard": shard, "kind": "codes", "a": _pack(code[a:b], "<u4"), "b": _pack(n[code[a:b]], "<u8")})
    return _table(rows)


class _Tokens:
    """A chunk's tokens: ids of all words of the corpus, training counts, and its distinct pairs by shard."""

    def __init__(self, kinds: dict[str, list[dict]], shards: int, pair_shards: int):
        row = kinds["chunk"][0]
        self.doc_id, self.held, self.lengths = row["doc_id"], row["held_out"], np.array(row["lengths"], np.int64)
        self.ids = _unpack(row["a"], "<u4").astype(np.int64)
        self.word_shard = _unpack(row["b"], "<u4")
        self.word = self.of_words(kinds["codes"], "a", "<u4").astype(np.uint64) * np.uint64(shards) + self.word_shard
        self.count = self.of_words(kinds["codes"], "b", "<u8").astype(np.int64)
        before = np.concatenate([self.ids[-1:], self.ids[:-1]])  # the chunk's last token is an end, as are those before documents
        pair = self.word[before] << np.uint64(32) | self.word[self.ids]
        self.pair, self.of = np.unique(pair, return_inverse=True)
        where = np.unique(self.of, return_index=True)[1]
        self.context_at, self.word_at = before[where], self.ids[where]  # places among the chunk's words
        parts = np.clip(-(-self.count // SPLIT), 1, pair_shards)
        mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        home = mix(self.word) % np.uint64(pair_shards)
        part = mix(self.word[self.word_at] ^ np.uint64(0x5BD1E995)) % parts[self.context_at].astype(np.uint64)
        self.shard = ((home[self.context_at] + part) % np.uint64(pair_shards)).astype(np.int64)
        self.split = {}  # of each shard: split contexts of this chunk that it has a part of
        for w in np.unique(self.context_at[parts[self.context_at] > 1]).tolist():
            for j in range(int(parts[w])):
                self.split.setdefault(int((home[w] + np.uint64(j)) % np.uint64(pair_shards)), []).append(w)

    def of_words(self, rows: list[dict], field: str, kind: str) -> np.ndarray:
        """What the shards say of the chunk's words, each of its own in their order."""
        got = np.concatenate([_unpack(r[field], kind) for r in sorted(rows, key=lambda r: r["shard"])])
        out = np.empty_like(got)
        out[np.argsort(self.word_shard, kind="stable")] = got
        return out

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: places of the pairs that it is asked for, by code, and of split contexts (by id)."""
        order = np.lexsort((self.pair, self.shard))
        starts = np.searchsorted(self.shard[order], np.arange(self.shard.max(initial=0) + 2))
        for s in sorted({*np.unique(self.shard).tolist(), *self.split}):
            at = order[starts[s] : starts[s + 1]] if s + 1 < len(starts) else order[:0]
            split = np.array(self.split.get(s, []), np.int64)
            yield s, at, split[np.argsort(self.word[split])]


def _contexts(pairs: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The contexts that a shard answers a chunk for, sorted."""
    return np.union1d(pairs >> np.uint64(32), split)


# --- pairs


class _Shard:
    """A shard's pairs with their counts, and their restaurants."""

    def __init__(self, asks: list[dict], seed: int):
        self.asks = asks
        self.pairs = [_unpack_sorted(r["a"]) for r in asks]
        every, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        c = np.bincount(at, np.concatenate([_unpack(r["b"], "<u4") for r in asks]), len(every)).astype(np.int64)
        self.code, self.c = every[c > 0], c[c > 0]
        self.splits = [_unpack(r["c"], "<u8").reshape(-1, 3) for r in asks]  # context, its tokens, its parts
        told = np.unique(np.concatenate(self.splits), axis=0)
        self.context, of = np.unique(self.code >> np.uint64(32), return_inverse=True)
        customers, share = np.bincount(of, self.c, len(self.context)).astype(np.int64), np.ones(len(self.context))
        at, there = _find(self.context, told[:, 0])
        customers[at[there]], share[at[there]] = told[there, 1], told[there, 2]
        self.seats = Restaurants(np.random.default_rng([SEED, seed]), of, self.c, len(self.context), share, customers)
        self.words, self.of_word = np.unique(self.code & np.uint64(0xFFFFFFFF), return_inverse=True)


def _tables(t: pa.Table, shards: int) -> pa.Table:
    """Seats a shard's pairs over the chances that it sees, and tells the shards of words their tables (b) of words (a: places)."""
    rows = t.to_pylist()
    s = _Shard(rows, rows[0]["shard"])
    seen = np.bincount(s.of_word, minlength=len(s.words)).astype(np.float64)
    p = (seen / max(1.0, seen.sum()))[s.of_word]
    for _ in range(BURN_IN):
        s.seats.sweep(p)
    tables = np.bincount(s.of_word, s.seats.t, len(s.words)).astype(np.int64)
    home, out = s.words % np.uint64(shards), []
    for w in np.unique(home).tolist():
        of = home == w
        out.append({"shard": w, "kind": "tables", "other": rows[0]["shard"], "a": _pack_sorted(s.words[of] // np.uint64(shards)), "b": _pack(tables[of], "<u4"), "doc_id": [int(tables[of].sum())]})
    return _table(out)


def _answers(t: pa.Table, shards: int) -> pa.Table:
    """Seats a shard's pairs over the chances of words, and tells each chunk what its pairs (a) and contexts (b) get."""
    kinds = _rows(t)
    if "pairs" not in kinds:
        return _table([])
    shard = kinds["pairs"][0]["shard"]
    s = _Shard(kinds["pairs"], shard)
    home, p = s.words % np.uint64(shards), np.zeros(len(s.words))
    for r in kinds.get("chances", []):
        p[home == r["other"]] = _unpack(r["b"], "<f4")
    seen, rest = sampled(s.seats, p[s.of_word], BURN_IN, SAMPLES)
    out = []
    for r, pairs, split in zip(s.asks, s.pairs, s.splits, strict=True):
        at, there = _find(s.code, pairs)
        mine = np.zeros(len(pairs), np.float32)
        mine[there] = seen[at[there]]
        contexts = _contexts(pairs, split[:, 0])
        at, there = _find(s.context, contexts)
        left = np.zeros(len(contexts), np.float32)
        left[there] = rest[at[there]]
        out.append({"chunk": r["chunk"], "shard": shard, "kind": "seen", "a": _pack(mine, "<f4"), "b": _pack(left, "<f4")})
    return _table(out)


# --- words


def _word_seats(kinds: dict[str, list[dict]], share: float, customers: int) -> tuple[list[bytes], np.ndarray, Restaurants]:
    """A shard's words, which of them have customers, and their restaurant."""
    row = kinds["vocabulary"][0]
    words = _unwords(row["a"])
    m = np.zeros(len(words), np.int64)
    for r in kinds.get("tables", []):
        m[_unpack_sorted(r["a"]).astype(np.int64)] += _unpack(r["b"], "<u4")
    on = np.flatnonzero(m)
    seats = Restaurants(np.random.default_rng([SEED, row["shard"], 1]), np.zeros(len(on), np.int64), m[on], 1, np.array([share]), np.array([customers]))
    return words, on, seats


def _plainly(words: list[bytes]) -> np.ndarray:
    """Log10 of what words get by their lengths alone."""
    return -1.5 * (np.fromiter(map(len, words), np.float64, len(words)) + 1)


def score(docs: DataFrame, held_out, chunk: int = CHUNK, shards: int | None = None, pair_shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document.

    docs: doc_id, text, and whatever else (ignored); held_out: a column, true for documents that nothing is learned from
    (null: false). A null or empty text is its end alone; a very long text is read whole, and is one chunk if need be, a
    very long word is spelled whole; rows that repeat are documents of their own; ties play no part; an empty table gives
    an empty result; where nothing is learned, words are spelled by uniform bytes. Words too many
    for ids of 32 bits are an error. Tables of what is no longer needed are removed on the way.
    """
    spark = docs.sparkSession
    shards = shards or max(LEAST_SHARDS, -(-docs.count() // SHARD_DOCS))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    chunks = chunked(rows, shards, chunk)
    of = lambda df, kind: df.where(F.col("kind") == kind)
    known = _written(of(chunks, "words").groupBy("shard").applyInArrow(lean(_gathered), _ROW), "lm-words")
    _gone(chunks, "words")
    sizes = np.zeros((3, shards), np.int64)
    for r in of(known, "vocabulary").select("shard", "other", F.col("lengths")[0].alias("types"), F.col("doc_id")[0].alias("tokens")).collect():  # rows: shards
        sizes[:, r["shard"]] = r["other"], r["types"], r["tokens"]
    types, tokens = int(sizes[1].sum()), int(sizes[2].sum())
    if (sizes[0].max() + 1) * shards >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    pair_shards = pair_shards or max(LEAST_PAIR_SHARDS, -(-tokens // PAIR_TOKENS))

    def ask(t: pa.Table) -> pa.Table:
        x = _Tokens(_rows(t), shards, pair_shards)
        learn = np.bincount(x.of, np.repeat(~np.array(x.held, bool), x.lengths), len(x.pair)).astype(np.int64)
        out = []
        for s, at, split in x.asked():
            told = np.stack([x.word[split], x.count[split].astype(np.uint64), np.clip(-(-x.count[split] // SPLIT), 1, pair_shards).astype(np.uint64)], 1)
            out.append({"chunk": x_name(t), "shard": s, "kind": "pairs", "a": _pack_sorted(x.pair[at]), "b": _pack(learn[at], "<u4"), "c": _pack(told.ravel(), "<u8")})
        return _table(out)

    def x_name(t: pa.Table) -> str:
        return t["chunk"][0].as_py()

    own = of(chunks, "chunk").unionByName(of(known, "codes"))
    asks = materialise(own.groupBy("chunk").applyInArrow(lean(lambda t: ask(t)), _ROW), "lm-pairs")
    tables = materialise(asks.groupBy("shard").applyInArrow(lean(lambda t: _tables(t, shards)), _ROW), "lm-tables")
    customers = tables.agg(F.sum(F.col("doc_id")[0])).first()[0] or 0
    vocabulary = of(known, "vocabulary").select("chunk", "shard", F.lit("vocabulary").alias("kind"), *[F.col(c) for c in list(_TYPES)[3:]])

    def seats(t: pa.Table):
        kinds = _rows(t)
        shard = kinds["vocabulary"][0]["shard"]
        words, on, r = _word_seats(kinds, types / max(1, int(sizes[1][shard])), customers)
        return kinds, shard, words, on, r

    def spell(t: pa.Table) -> pa.Table:
        _, _, words, on, r = seats(t)
        if len(on):
            names = [words[i] for i in on.tolist()]
            for _ in range(BURN_IN):
                r.sweep(10.0 ** np.maximum(_plainly(names), -300))
            code, begin = _spelled(names)
            grams, at = np.unique(code, return_inverse=True)
            n = np.bincount(at, np.repeat(r.t, np.diff(np.append(begin, len(code)))), len(grams)).astype(np.int64)
            return pa.table({"code": pa.array(grams), "n": pa.array(n)})
        return pa.table({"code": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    by_shard = vocabulary.unionByName(tables).groupBy("shard")
    grams = by_shard.applyInArrow(lean(lambda t: spell(t)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    grams = grams.orderBy("code").toArrow()  # rows: byte contexts times bytes, bounded by the order
    spelling = Spelling.fit(grams["code"].to_numpy(), grams["n"].to_numpy()) if grams.num_rows else Spelling([])
    sent = spark.sparkContext.broadcast(spelling)

    def unigram(t: pa.Table) -> pa.Table:
        _, shard, words, on, r = seats(t)
        spelled = sent.value.log10(words)
        seen = np.zeros(len(words))
        rest = 0.0
        if len(on):
            mine, left = sampled(r, 10.0 ** np.maximum(spelled[on], -300), BURN_IN, SAMPLES)
            seen[on], rest = mine, float(left[0])
        return _table([{"shard": shard, "kind": "unigram", "a": _pack(seen, "<f8"), "b": _pack(spelled, "<f8"), "c": _pack([rest], "<f8")}])

    unigrams = materialise(by_shard.applyInArrow(lean(lambda t: unigram(t)), _ROW), "lm-unigrams")
    rest = sum(float(_unpack(bytes(r["c"]), "<f8")[0]) for r in unigrams.select("c").collect()) if customers else 1.0  # rows: shards

    def chances(t: pa.Table) -> pa.Table:
        """Log10 probabilities of words to the chunks that hold them, probabilities to the shards of pairs."""
        kinds = _rows(t)
        row = kinds["unigram"][0]
        seen, spelled = _unpack(row["a"], "<f8"), _unpack(row["b"], "<f8")
        fresh = spelled + np.log10(rest)  # also where it is too small for a double
        log = np.where(seen > 0, np.log10(np.maximum(seen + 10.0 ** np.maximum(fresh, -300), 1e-300)), fresh)
        out = [{"chunk": r["chunk"], "shard": row["shard"], "kind": "log", "a": _pack(log[_unpack(r["a"], "<u4")], "<f4")} for r in kinds.get("codes", [])]
        for r in kinds.get("tables", []):
            at = _unpack_sorted(r["a"]).astype(np.int64)
            out.append({"shard": r["other"], "kind": "chances", "other": row["shard"], "b": _pack(np.maximum(10.0 ** log[at], 1e-37), "<f4")})
        return _table(out)

    told = _written(unigrams.unionByName(of(known, "codes").drop("b").withColumn("b", F.lit(None).cast("binary"))).unionByName(tables).groupBy("shard").applyInArrow(lean(lambda t: chances(t)), _ROW), "lm-chances")
    _gone(known, "vocabulary")
    _gone(tables)
    _gone(unigrams)
    answered = asks.unionByName(of(told, "chances")).groupBy("shard").applyInArrow(lean(lambda t: _answers(t, shards)), _ROW)

    def finish(t: pa.Table) -> pa.Table:
        kinds = _rows(t)
        x = _Tokens(kinds, shards, pair_shards)
        log = x.of_words(kinds["log"], "a", "<f4").astype(np.float64)
        seen, left = np.zeros(len(x.pair)), np.zeros(len(x.word))
        of_shard = {r["shard"]: r for r in kinds.get("seen", [])}
        by_id = np.argsort(x.word)
        for s, at, split in x.asked():
            seen[at] = _unpack(of_shard[s]["a"], "<f4")
            contexts = _contexts(x.pair[at], x.word[split])
            left[by_id[np.searchsorted(x.word[by_id], contexts)]] += _unpack(of_shard[s]["b"], "<f4")
        back = np.where(x.count > 0, left, 1.0)  # what is no context in training has no restaurant
        fresh = log[x.word_at] + np.log10(np.maximum(back[x.context_at], 1e-300))
        pair = np.where(seen > 0, np.log10(np.maximum(seen + 10.0 ** np.maximum(fresh, -300), 1e-300)), fresh)
        base = np.log10((x.count + 0.5) / (tokens + 0.5 * (types + 1)))
        begin = np.cumsum(x.lengths) - x.lengths
        total = lambda v: np.add.reduceat(v, begin)
        score = total(pair[x.of])
        return pa.table(
            {
                "doc_id": pa.array(x.doc_id, pa.int64()), "held_out": pa.array(x.held, pa.bool_()), "n_tokens": pa.array(x.lengths),
                "n_known": pa.array(total((x.count[x.ids] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(begin), tokens, np.int64)),
                "base_score": pa.array(total(base[x.ids])), "score": pa.array(score), "perplexity": pa.array(10.0 ** np.minimum(-score / x.lengths, 300)),
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return own.unionByName(of(told, "log")).unionByName(answered).groupBy("chunk").applyInArrow(lean(lambda t: finish(t)), out)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
