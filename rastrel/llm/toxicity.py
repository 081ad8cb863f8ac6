"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and starts of words that mark labelled documents) is learned from a bounded sample of labelled
rows, in which equal texts (but for case and white space) count once. Features are made in folds, each from the lexicon
of the others, so that trees see densities as they are on unseen text; the calibration is fitted to predictions made in
the same way. Near copies mostly share the least hash of their word triples, and with it their fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import mapped, materialise, table

#: Labelled rows that are learned from, at most; those whose ids' hashes are least.
SAMPLE = 20_000
FOLDS = 3
#: Starts of words, in characters.
STARTS = range(4, 9)
#: Entries of a lexicon stand in this share of the toxic documents, and in 3 of them, at least.
LEAST_SHARE = 0.008
#: Natural log of how much likelier an entry is in a toxic document: strong and mild entries.
STRONG, MILD = 3.8, 2.5
ENTRIES = 4000
#: Longer words (characters) are no entries; their starts can be.
LONGEST = 48
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32

#: Fixed: second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Fixed: characters that stand for letters.
DISGUISE = str.maketrans("@$013457!", "asoieasti")

_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[*@$!0-9._-]++[^\W\d_]++)+")  # from a word's first letter, without going back: linear
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}+\b")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")

FEATURES = (
    "strong_density strong_log mild_density mild_log distinct_log second_density nearness near_share "
    "capitals capital_words exclamations questions punctuation disguised disguised_hits repeated words_log"
).split()


@dataclass
class Lexicon:
    """Tiers (2 strong, 1 mild) of words, and of starts of words."""

    words: dict[str, int]
    starts: dict[str, int]

    def __post_init__(self):
        self.heads = {w[:3] for w in (*self.words, *self.starts)}

    def tier(self, w: str) -> int:
        if w[:3] not in self.heads:
            return 0
        return max(self.words.get(w, 0), max((self.starts.get(w[:k], 0) for k in STARTS if k < len(w)), default=0))


def units(text: str) -> set[str]:
    """Words, and starts of words with a dash behind."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) <= LONGEST} | {w[:k] + "-" for w in words for k in STARTS if k < len(w)}


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    words = _WORD.findall(text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    distinct = set(words)
    tier = {w: t for w in distinct if (t := lexicon.tier(w))}
    at = [i for i, w in enumerate(words) if w in tier] if tier else []
    strong = sum(tier[words[i]] == 2 for i in at)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if distinct & SECOND_PERSON else []
    nearness = near = 0.0
    if at and second:
        s, a = np.array(second), np.array(at)
        k = np.searchsorted(s, a)
        gap = np.minimum(np.abs(a - s[np.minimum(k, len(s) - 1)]), np.abs(a - s[np.maximum(k - 1, 0)]))
        nearness, near = float(np.exp(-gap.min() / 5)), float((gap <= 5).mean())
    disguised = _DISGUISED.findall(text)
    opened = sum(bool(lexicon.tier(re.sub(r"[*._-]", "", x.lower().translate(DISGUISE)))) for x in disguised)
    return [
        100 * strong / n, math.log1p(strong), 100 * (len(at) - strong) / n, math.log1p(len(at) - strong), math.log1p(len(tier)),
        100 * len(second) / n, nearness, near, len(_UPPER.findall(text)) / chars, len(_CAPITALS.findall(text)) / n,
        100 * text.count("!") / chars, 100 * text.count("?") / chars, len(_PUNCTUATION.findall(text)) / chars,
        len(disguised) / n, math.log1p(opened), len(_REPEATED.findall(text)) / n, math.log1p(len(words)),
    ]


class Trees:
    """Newton boosting of complete binary trees on binned features, for the logistic loss."""

    def __init__(self, base: float, nodes: np.ndarray, limits: np.ndarray, leaves: np.ndarray):
        self.base, self.nodes, self.limits, self.leaves = base, nodes, limits, leaves

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = 1.0) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)  # of bin b: above edge b - 1, up to edge b
        rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = math.log(rate_of / (1 - rate_of))
        raw = np.full(n, base)
        nodes, limits, leaves = np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            at = np.zeros(n, int)  # node within its level
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                best, pick, limit = np.zeros(width), np.zeros(width, int), np.full(width, np.inf)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    k = len(edges[j]) + 1
                    cell = at * k + code[:, j]
                    sg = np.bincount(cell, g, width * k).reshape(width, k).cumsum(1)
                    sh = np.bincount(cell, h, width * k).reshape(width, k).cumsum(1)
                    gl, hl, gt, ht = sg[:, :-1], sh[:, :-1], sg[:, -1:], sh[:, -1:]
                    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best + 1e-9
                    best[better], pick[better], limit[better] = gain[np.arange(width), top][better], j, edges[j][top][better]
                nodes[t, first : first + width], limits[t, first : first + width] = pick, limit
                at = 2 * at + (x[np.arange(n), pick[at]] > limit[at])
            sg, sh = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
            leaves[t] = rate * sg / (sh + l2)
            raw += leaves[t][at]
        return cls(base, nodes, limits, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for node, limit, leaf in zip(self.nodes, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            while (at < len(node)).all():
                at = 2 * at + 1 + (x[rows, node[at]] > limit[at])
            out += leaf[at - len(node)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing function of x, the means of the pools at their mean places."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        if pools and pools[-1][2] / pools[-1][1] == a:  # ties are one
            pools[-1] = [pools[-1][0] + b, pools[-1][1] + 1, pools[-1][2] + a]
        else:
            pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], p[:, 0] / p[:, 1]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.knots[1][0])
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, *self.knots)
        # Within a pool of equal scores the trees' order stays visible, in the last thousandth.
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _lexicon(rows, folds: list[int]) -> Lexicon:
    """From units' document counts in these folds, as {unit: [[clean, toxic] of each fold]}, under '' those of all."""
    total = [sum(rows[""][f][k] for f in folds) for k in (0, 1)]
    found = []
    for u, of in rows.items():
        c, t = (sum(of[f][k] for f in folds) for k in (0, 1))
        if u and t >= max(3, LEAST_SHARE * total[1]):
            odds = math.log((t + 0.5) / (total[1] + 1)) - math.log((c + 0.5) / (total[0] + 1))
            # A strong entry is sure of itself, too: few labelled rows make none stronger than they can tell.
            least = min(STRONG, math.log(2 * total[0] + 2) - 1.0)
            if odds >= MILD:
                found.append((odds, u, 2 if odds >= least else 1))
    found = sorted(found, key=lambda x: (-x[0], x[1]))[:ENTRIES]
    return Lexicon({u: t for _, u, t in found if u[-1] != "-"}, {u[:-1]: t for _, u, t in found if u[-1] == "-"})


def sketch(text: str) -> int:
    """The least hash of a text's word triples; near copies mostly have it in common, other texts hardly ever."""
    w = text.lower().encode().split()
    return min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic, fold, digest: of at most `sample` labelled documents, each different text of each label once."""
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(told), "doc_id").select("text", "toxic")
    rows = rows.withColumn("digest", F.md5(F.btrim(F.regexp_replace(F.lower("text"), r"\s+", " ")).cast("binary")))
    rows = rows.groupBy("digest", "toxic").agg(F.min("text").alias("text"))

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            folds = [sketch(x.as_py()) % FOLDS for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folds, pa.int32())], names=["digest", "toxic", "text", "fold"])

    return materialise(mapped(rows, fold, "digest string, toxic int, text string, fold int"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled documents. labels: doc_id, toxic (0 or 1; null: not labelled).

    Rows of one doc_id are each a text of that label; where labels of one id differ, toxic wins. Labels without a
    document, and documents without a label, teach nothing.
    """
    spark = docs.sparkSession
    rows = sampled(docs, labels, sample)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in it:
            for text, cell in zip(batch.column("text").to_pylist(), zip(batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(), strict=True), strict=True):
                seen.update((u, *cell) for u in units(text))
                seen["", *cell] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([2 * k[1] + k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["unit", "cell", "n"])

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    toxic = sum((F.col(f"c{2 * f + 1}") for f in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"c{2 * f}") for f in range(FOLDS)), F.lit(0))
    counted = materialise(mapped(rows, count, "unit string, cell int, n long").groupBy("unit").agg(*cells), "toxic-units")
    of_folds = lambda r: [[r[f"c{2 * f}"], r[f"c{2 * f + 1}"]] for f in range(FOLDS)]
    # No unit in fewer toxic documents can be an entry of any fold; so what comes to the driver is bounded by their mean length.
    told = [of_folds(r) for r in counted.where("unit = ''").collect()]
    least = max(3.0, LEAST_SHARE * (sum(of[1] for of in told[0]) - max(of[1] for of in told[0]))) if told else 3.0
    found = {r["unit"]: of_folds(r) for r in counted.where((F.col("unit") == "") | ((toxic >= least) & (toxic * 2 >= clean))).collect()}
    if not found or not all(sum(of[k] for of in found[""]) for k in (0, 1)):
        only = sum(of[1] for of in found[""]) > 0 if found else None
        return Model(Lexicon({}, {}), None, (np.zeros(1), np.array([0.0 if only is None else float(only)])))
    by_fold = [_lexicon(found, [f for f in range(FOLDS) if f != out]) for out in range(FOLDS)]
    sent = spark.sparkContext.broadcast(by_fold)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = [features(t, sent.value[f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("fold"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["digest", "fold", "toxic", "x"])

    got = mapped(rows, measure, "digest string, fold int, toxic int, x array<double>").orderBy("digest", "toxic").collect()
    x, y, fold = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got])
    out = np.zeros(len(y))
    for f in range(FOLDS):
        seen = fold != f
        out[~seen] = (Trees.fit(x[seen], y[seen]) if seen.any() else Trees.fit(x, y)).raw(x[~seen])
    return Model(_lexicon(found, list(range(FOLDS))), Trees.fit(x, y), isotonic(out, y))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry..., score (0 to 1), predicted (score >= THRESHOLD) of every whole text.

    docs: text and the columns of `carry`; others are ignored, whatever their names. A null text is an empty one and
    gets what the trees give a text without words; rows alike are scored alike; a very long text, also of one word, is
    read whole, in time in proportion to its length; an empty table gives an empty result.
    Without labels of both kinds, all scores are the kind there is, or 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([features(t.as_py() or "", sent.value.lexicon) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
            s = sent.value.score(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*carry, "score", "predicted"])

    return mapped(docs.select(*carry, *(["text"] if "text" not in carry else [])), run, docs.select(*carry).schema.add("score", "double").add("predicted", "integer"))


def held_out(doc_id, folds: int = 3):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
