"""Byte-level BPE by a lexicon of frequent words, with exact merges for the rest.

The most frequent words of the corpus are compiled, with their ids, into a minimal acyclic transducer: states with
equal futures are one, and the numbers on a word's path add up to its place in a table of id sequences. Workers map
that file into memory and look up all distinct words of a batch in step with one another. Words that it lacks are
merged by the tokenizer's rules, so the lexicon's size changes nothing but the time taken.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import fresh_path, least_count, mapped, materialise, table, write_bytes

#: Words of the lexicon, at most; with all that share the least count left out.
LEXICON_WORDS = 100_000
#: Longer words (bytes) are merged.
LONGEST = 48
#: Distinct words that a task counts before it hands them on, and that it keeps the ids of.
FLUSH = 400_000
CACHE = 200_000
#: Characters whose words are looked up together.
TOGETHER = 2_000_000
#: Words longer than this are merged with a heap; words up to so many bytes are merged in step.
SHORT, TOGETHER_BYTES = 24, 64
_NONE = 2**62

#: Fixed: how byte-level BPE of this vocabulary splits text, white space by its Unicode property.
SPLIT = regex.compile(r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of Latin letters and punctuation in which the quicker library means the same by its classes: they
#: have no numbers but digits, and no separators of information.
PLAIN_SPLIT = re.compile(r" ?[^\W\d_]++| ?\d++|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def split(text: str) -> list[str]:
    """The words of a text without special tokens."""
    return (SPLIT if _NOT_PLAIN.search(text) else PLAIN_SPLIT).findall(text)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary and rules of a byte-level BPE tokenizer."""

    def __init__(self, spec: dict):
        byte_of = _byte_of()
        model = spec["model"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        as_bytes = lambda t: bytes(byte_of[c] for c in t)
        self.token: dict[int, bytes] = {i: as_bytes(t) for t, i in model["vocab"].items() if t not in self.specials}
        self.token |= {i: s.encode() for s, i in self.specials.items()}
        ids = {t: i for i, t in self.token.items() if i not in self.specials.values()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.rules: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = as_bytes(a), as_bytes(b)
            self.rules.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        self.tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self._table = None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)

    def _hashed(self) -> None:
        """The rules as an open table of keys, with rank and product in one number."""
        keys = np.fromiter(self.rules, np.uint64, len(self.rules))
        value = np.array([r << 32 | made for r, made in self.rules.values()], np.int64)
        self._bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self._table, self._value = np.full(1 << self._bits, 2**64 - 1, np.uint64), np.full(1 << self._bits, _NONE, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # of those that want a free slot, the first takes it
            free = todo[self._table[at[todo]] == np.uint64(2**64 - 1)]
            slots, first = np.unique(at[free], return_index=True)
            self._table[slots], self._value[slots] = keys[free[first]], value[free[first]]
            todo = np.setdiff1d(todo, free[first], assume_unique=True)
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64((1 << self._bits) - 1)

    def _rule(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and product of pairs, or _NONE."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at, out, todo = self._slot(key), np.full(len(key), _NONE, np.int64), np.arange(len(key))
        while len(todo):
            there = self._table[at[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self._value[at[todo[hit]]]
            todo = todo[~hit & (there != np.uint64(2**64 - 1))]
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64((1 << self._bits) - 1)
        return out

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words as little-endian unsigned 32-bit integers. Words of one length merge in step: each turn takes
        the best pair of every word that has one."""
        if self._table is None:
            self._hashed()
        out: list = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        of_byte = np.array(self.of_byte, np.int64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            if n > TOGETHER_BYTES or len(at) < 4:
                for i in at.tolist():
                    ids = self.merge(words[i])
                    out[i] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            ids = of_byte[np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, n)]
            rule = self._rule(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(at), n - 1) if n > 1 else np.zeros((len(at), 0), np.int64)
            while len(at):
                width = rule.shape[1]
                best = rule.argmin(1) if width else np.zeros(len(at), np.int64)
                made = rule[np.arange(len(at)), best] if width else np.full(len(at), _NONE)
                done = made == _NONE
                if done.any():
                    raw = ids[done].astype("<u4")
                    for i, x in zip(at[done].tolist(), raw, strict=True):
                        out[i] = x.tobytes()
                    at, ids, rule, best, made = at[~done], ids[~done], rule[~done], best[~done], made[~done]
                    if not len(at):
                        break
                rows, cols = np.arange(len(at)), np.arange(width)
                ids[rows, best] = made & 0xFFFFFFFF
                ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
                rule = np.take_along_axis(rule, cols[:-1] + (cols[:-1] >= best[:, None]), 1)
                for side in (best - 1, best):  # the pairs with the new token
                    ok = (side >= 0) & (side < width - 1)
                    rule[rows[ok], side[ok]] = self._rule(ids[rows[ok], side[ok]], ids[rows[ok], side[ok] + 1])
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the adjacent pair of the lowest rank is merged, leftmost first, until none has a rule."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rules = self.rules
        while len(ids) > 1:
            best, at = None, 0
            for i, (a, b) in enumerate(pairwise(ids)):
                r = rules.get(a << 32 | b)
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rules.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (r[0], i, ids[i], ids[j], r[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


class Transducer:
    """Compiled words: arcs sorted by state and byte, each with its target and the number it adds to the word's place."""

    _ARRAYS = (("arc", "<i8"), ("target", "<i4"), ("adds", "<i4"), ("final", "<u1"), ("start", "<i4"), ("ids", "<u4"))

    def __init__(self, buffer):
        sizes = struct.unpack_from("<6q", buffer)
        at = 48
        for (name, kind), n in zip(self._ARRAYS, sizes, strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compiled(cls, words: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """The file of these (word, ids), in the words' byte order. States are made minimal as soon as no word goes on from them."""
        ids, start = [], [0]
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # finality, ((byte, state), ...)
        path: list[list] = [[False, []]]  # of the word at hand: finality and arcs of each state, the last arc open
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], register[key]))

        for word, of in words:
            if word <= last and start[-1:] != [0]:
                raise ValueError("the words aren't in order")
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            last = word
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            ids += of
            start.append(len(ids))
        close(0)
        root = len(states)
        states.append((path[0][0], tuple(path[0][1])))
        below: list[int] = []  # words that can follow; targets come before their sources
        arcs, target, adds = [], [], []
        for s, (final, out) in enumerate(states):
            n = int(final)
            for byte, to in out:
                arcs.append(s << 8 | byte)
                target.append(to)
                adds.append(n)
                n += below[to]
            below.append(n)
        final = [int(f) for f, _ in states]
        assert root == len(states) - 1
        blob = struct.pack("<6q", len(arcs), len(target), len(adds), len(final), len(start), len(ids))
        for (_, kind), values in zip(cls._ARRAYS, (arcs, target, adds, final, start, ids), strict=True):
            raw = np.array(values, kind).tobytes()
            blob += raw + b"\0" * (-len(raw) % 8)
        return blob

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in byte order, or -1. All words take their next byte together."""
        n = len(words)
        if not n or not len(self.arc):
            return np.full(n, -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        offset = np.cumsum(size) - size
        state, place = np.full(n, len(self.final) - 1, np.int64), np.zeros(n, np.int64)
        state[size > LONGEST] = -1
        for step in range(LONGEST):
            on = np.flatnonzero((state >= 0) & (size > step))
            if not len(on):
                break
            key = state[on] << 8 | flat[offset[on] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[at] == key
            state[on] = np.where(ok, self.target[at], -1)
            place[on] += np.where(ok, self.adds[at], 0)
        found = (state >= 0) & (size > 0)
        found[found] = self.final[state[found]] == 1
        return np.where(found, place, -1)


def word_counts(docs: DataFrame, specials: list[str]) -> DataFrame:
    """word (binary), n: all pre-tokens of all whole texts. Tasks count before the shuffle."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in it:
            for text in batch.column("text"):
                for part in _parts(text.as_py() or "", specials):
                    seen.update(split(part))
                if len(seen) >= FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return mapped(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _parts(text: str, specials: list[str]) -> list[str]:
    """The text between special tokens."""
    parts = [text]
    for s in specials:
        parts = [y for x in parts for y in x.split(s)]
    return parts


class Tokenizer:
    """The rules of a vocabulary, and a lexicon compiled for all workers: a file that Spark hands to each of them once."""

    def __init__(self, path: str, lexicon: bytes):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        if self.spec.get("normalizer") or self.spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a byte-level BPE tokenizer of the supported kind")
        self.lexicon = lexicon
        self.sent = None

    def shipped(self, spark: SparkSession):
        """A broadcast of the rules, and the name under which workers find the lexicon's file."""
        if self.sent is None:
            path = fresh_path(spark, "bpe-lexicon")
            write_bytes(spark, path, self.lexicon)
            spark.sparkContext.addFile(path)
            self.sent = spark.sparkContext.broadcast(self.spec), path.rpartition("/")[2]
        return self.sent


def fit(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> Tokenizer:
    """Counts all words of docs and compiles the most frequent."""
    path = path or vocabulary_path()
    tokenizer = Tokenizer(path, b"")
    rules = Merges(tokenizer.spec)
    counts = materialise(word_counts(docs, list(rules.specials)).where(F.length("word") <= LONGEST), "bpe-words")
    least = least_count(counts, "n", words)
    kept = [] if least is None else sorted(bytes(r["word"]) for r in counts.where(F.col("n") >= least).select("word").collect())
    tokenizer.lexicon = Transducer.compiled((w, rules.merge(w)) for w in kept)
    return tokenizer


#: What this process has parsed and mapped, by the lexicon's name; the last one alone, as workers serve many tasks.
_parsed: dict[str, tuple[Merges, Transducer]] = {}


def _tools(sent) -> tuple[Merges, Transducer]:
    spec, name = sent
    if name not in _parsed:
        _parsed.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _parsed[name] = Merges(spec.value), Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _parsed[name]


class _Worker:
    """What a task needs of a tokenizer: the rules, the mapped lexicon, and the ids of words met lately."""

    def __init__(self, sent):
        self.rules, self.lexicon = _tools(sent)
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        lex = self.lexicon
        place = lex.places(raw)
        found, lacking = np.flatnonzero(place >= 0), np.flatnonzero(place < 0).tolist()
        ids = lex.ids.tobytes()
        begin, end = (4 * lex.start[place[found]]).tolist(), (4 * lex.start[place[found] + 1]).tolist()
        for i, a, b in zip(found.tolist(), begin, end, strict=True):
            self.known[new[i]] = ids[a:b]
        for i, b in zip(lacking, self.rules.merge_all([raw[i] for i in lacking]), strict=True):
            self.known[new[i]] = b

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        specials = self.rules.specials
        cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else lambda x: [x]
        cuts = [[(p, specials.get(p)) if p in specials else (split(p), None) for p in cut(t) if p] for t in texts]
        words = set().union(*(found for parts in cuts for found, special in parts if special is None))
        self.learn(words)
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, found)) if special is None else struct.pack("<I", special) for found, special in parts) for parts in cuts]


def _encoding(sent, carry: tuple[str, ...]):
    """The encoder on batches with text and carry, by a broadcast tokenizer."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = None
        for batch in it:
            worker = worker or _Worker(sent)
            a, column = 0, batch.column("text")
            while a < batch.num_rows:
                texts, chars, b = [], 0, a
                while b < batch.num_rows and chars < TOGETHER:
                    texts.append(column[b].as_py() or "")
                    chars += len(texts[-1])
                    b += 1
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(worker.encode(texts), pa.binary())], names=[*carry, "ids"])
                a = b

    return run


def _decoding(sent):
    """The decoder on batches with ids: adds decoded."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in it:
            tokens = tokens or _tools(sent)[0].tokens
            get, top, texts = tokens.__getitem__, len(tokens), []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), "<u4") if raw.is_valid else np.empty(0, "<u4")
                texts.append(b"".join(map(get, ids[ids < top].tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def _with_text(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(*carry, *(["text"] if "text" not in carry else []))


def encode(docs: DataFrame, tokenizer: Tokenizer, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry..., ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    docs: text and the columns of `carry`; others are ignored, whatever their names. A null or empty text has no ids;
    the strings of special tokens become those tokens; repeated rows are encoded alike; a very long text is encoded whole,
    a very long word by a heap of its pairs; words that tie at the lexicon's end are all left out of it, which changes no
    id; an empty table gives an empty result.
    """
    sent = tokenizer.shipped(docs.sparkSession)
    return mapped(_with_text(docs, carry), _encoding(sent, carry), docs.select(*carry).schema.add("ids", "binary"))


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The same rows with decoded (string), special tokens kept; ids without a token are skipped, bytes that aren't UTF-8 replaced."""
    sent = tokenizer.shipped(encoded.sparkSession)
    return mapped(encoded, _decoding(sent), encoded.select("*").schema.add("decoded", "string"))


def token_digests(docs: DataFrame, tokenizer: Tokenizer, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry..., n_tokens, ids_sha256, decoded_sha256: encoded and decoded by one worker."""
    sent = tokenizer.shipped(docs.sparkSession)
    there, back = _encoding(sent, carry), _decoding(sent)
    both = mapped(_with_text(docs, carry), lambda it: back(there(it)), docs.select(*carry).schema.add("ids", "binary").add("decoded", "string"))
    return both.select(*carry, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs, fit(docs))
