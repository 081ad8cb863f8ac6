"""Operators on documents against brute force, with the odd cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, clashing, docs, rows, words

from rastrel.llm import bpe, line_dedup, mixing, pitman_yor, quality_rules, restaurants, simhash, toxicity
from rastrel.llm.common import table


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- op3: quality rules


def base(text):
    w = words(text)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_rules_odd_cases(spark, empty):
    d = clashing(docs(spark), "host", "t", "w", "n", "lines", "kept", "n_words", "hit")
    for limit, long in ((quality_rules.BROADCAST_LINES, quality_rules.LONG_LINES), (quality_rules.BROADCAST_LINES, 2), (0, 5)):
        got = quality_rules.judge(d, broadcast_lines=limit, long_lines=long).collect()
        assert len(got) == len(rows())
        want = Counter((r[0], *base(r[1])) for r in rows())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept) for r in got)
    assert quality_rules.judge(empty).count() == 0


def test_boilerplate_goes_and_copies_stay(spark):
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(60))
    boiler = [(i, f"{body(i)}\nSubscribe now\n{body(1000 + i)}", "en", "h", 1) for i in range(30)]
    thin = [(100 + i, f"s{i} z\nSubscribe now\nt{i} y" + "\n" + " ".join("Subscribe now".split() * 30) if i < 25 else body(i), "en", "h", 1) for i in range(30)]
    copies = [(200 + i, f"{body(7)}\nline two of it {body(8)}\nline three {body(9)}", "en", "h", 1) for i in range(50)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(boiler + thin + copies, SCHEMA), texts=True).collect()}
    assert all(got[i].kept and "Subscribe" not in got[i].kept_text and got[i].n_kept_words == 120 for i in range(30))
    assert all(got[200 + i].kept and got[200 + i].n_kept_words == got[200 + i].n_words for i in range(50))


def test_boilerplate_of_several_lines_goes(spark):
    head, foot = ([" ".join(f"{k}{i}x{j}" for j in range(10)) for i in range(6)] for k in ("header", "footer"))
    own = lambda i: " ".join(f"o{i}x{k}" for k in range(8))
    pages = [(i, "\n".join([*head, own(i), *foot]), "en", "h", 1) for i in range(30)]
    copies = [(100 + i, "\n".join(f"line {k} of one text that is copied, {' '.join(f'c{k}x{j}' for j in range(10))}" for k in range(6)), "en", "h", 1) for i in range(50)]
    for long in (quality_rules.LONG_LINES, 8):
        got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(pages + copies, SCHEMA), texts=True, long_lines=long).collect()}
        assert all(got[i].kept_text == own(i) for i in range(30))
    assert all(got[i].kept_text == own(i) and got[i].n_kept_words == 8 and not got[i].base_failed and not got[i].kept for i in range(30))
    assert all(got[100 + i].n_kept_words == got[100 + i].n_words and got[100 + i].kept for i in range(50))


def test_depleted_documents_are_rejected(spark):
    line = "a long line of navigation that every page of this host repeats word for word at its top and at its foot"
    d = [(i, "\n".join([f"own{i} " + " ".join(f"o{i}x{k}" for k in range(20 if i % 2 else 90)), line, f"end{i}", line.upper() + " "]), "en", "h", 1) for i in range(40)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(d, SCHEMA)).collect()}
    assert all(got[i].n_kept_words == got[i].n_words - 2 * len(line.split()) for i in range(40))
    assert all(got[i].kept == (not got[i].base_failed and 2 * got[i].n_kept_words >= got[i].n_words) for i in range(40))
    assert not any(got[i].kept for i in range(1, 40, 2)) and any(got[i].kept for i in range(0, 40, 2))


# --- op8: line dedup


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def lines_dropped(texts, least=10):
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_odd_cases(spark, empty):
    d = clashing(docs(spark), "shard", "h1", "n", "n_lines", "gone", "rid", "sure")
    index = line_dedup.build(d, shard_keys=10_000)
    assert index.shards > 1
    want = Counter((r[0], *x) for r, x in zip(rows(), lines_dropped([r[1] for r in rows()]), strict=True))
    for limit, room in ((line_dedup.BROADCAST_KEYS, line_dedup.FILTER_BYTES), (1, line_dedup.FILTER_BYTES), (0, 64)):
        got = line_dedup.drop_lines(index, d, broadcast_keys=limit, filter_bytes=room)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want
    assert line_dedup.drop_lines(line_dedup.build(empty), empty).count() == 0


def test_line_index_is_reversible(spark):
    d = docs(spark)
    more = spark.createDataFrame([(500 + i, f"fresh line {i % 3}\nthe same line here", "en", "a", 1) for i in range(40)], SCHEMA)
    first = line_dedup.build(d, shard_keys=10)
    assert first.shards > 1
    grown = line_dedup.change(first, added=more)
    both = d.unionByName(more)
    assert Counter(map(tuple, grown.counts.drop("shard").collect())) == Counter(map(tuple, line_dedup.key_counts(both).collect()))
    pick = lambda i, x: Counter((r.doc_id, r.text) for r in line_dedup.drop_lines(i, x).collect())
    assert pick(grown, both) == pick(line_dedup.build(both), both)
    back = line_dedup.change(grown, removed=more)
    assert Counter(map(tuple, back.counts.collect())) == Counter(map(tuple, first.counts.collect()))
    assert pick(back, d) == pick(first, d)
    swapped = line_dedup.change(first, added=more, removed=d)
    assert pick(swapped, more) == pick(line_dedup.build(more), more)


def test_cuckoo_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    f = line_dedup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.01
    for k in keys[:2500]:
        f.delete(int(k))
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.02


# --- op6: SimHash


def print_of(text, size=3):
    w = [key(x) for x in words(text)]
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(items, near):
    """Smallest id reachable for each of (id, value)."""
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i][1], items[j][1]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(items):
        if d is not None and (least[root(i)] is None or d < least[root(i)]):
            least[root(i)] = d
    return [(d, v, least[root(i)]) for i, (d, v) in enumerate(items)]


def test_simhash_odd_cases(spark, empty):
    d = clashing(docs(spark), "fp", "least", "root", "component_id", "bits", "far")
    got = simhash.near_duplicates(d).collect()
    want = linked([(r[0], print_of(r[1])) for r in rows()], lambda a, b: (a ^ b).bit_count() <= 3)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter(want)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [8, 4096])
def test_links_of_many_fingerprints(spark, crowded):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:6].tolist():  # clouds of near copies, and chains that wander off
        x = b
        for _ in range(60):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)))
            x ^= sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
            fps.add(x)
    signed = sorted(x - 2**64 if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    known = simhash.pivot_table(nodes)
    found = simhash.components(simhash.links(simhash.block_keys(nodes, len(signed)), known, 3, crowded))
    got = {r.fp: r.root for r in nodes.join(found, F.col("fp") == F.col("node"), "left").collect()}
    want = {v: c for _, v, c in linked([(x, x) for x in signed], lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)}
    assert {k: v if v is not None else k for k, v in got.items()} == want


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 400, dtype=np.uint64)
    refs = np.array(simhash.pivots(), np.int64).view(np.uint64)
    for k in range(4):
        other = fp.copy()
        for b in range(k):
            other ^= np.uint64(1) << np.uint64(7 * b + 3)
        far = [np.bitwise_count(x[:, None] ^ refs[None, :]).astype(int) for x in (fp, other)]
        assert np.abs(far[0] - far[1]).max() <= k


def test_similarity_links_catch_copies(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    out, source, n = [], {}, 0
    for size in (12, 30, 80, 200, 600, 2500):
        for _ in range(25):
            w = list(rng.choice(vocabulary, size))
            out.append((n, " ".join(w), "en", "a", 1))
            source[n] = n
            first, n = n, n + 1
            for _ in range(2):  # changed so that five words in a row are shared by over 0.8
                c = list(w)
                shingles = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
                for at in rng.permutation(size):
                    trial = [*c[:at], "changed" + str(rng.integers(1e9)), *c[at + 1 :]]
                    a, b = shingles(w), shingles(trial)
                    if len(a & b) / len(a | b) < 0.82:
                        break
                    c = trial
                out.append((n, " ".join(c), "en", "a", 1))
                source[n], n = first, n + 1
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(out, SCHEMA), shingle=5, similarity=0.8).collect()}
    copies = [d for d in source if source[d] != d]
    assert np.mean([got[d] == source[d] for d in copies]) > 0.97
    assert all(source[got[d]] == source[d] for d in source)


def test_similarity_links_are_those_of_the_sets(spark):
    """Near copies on both sides of 0.8, short and long, against all pairs; few per group, so that no chain helps."""
    rng = np.random.default_rng(3)
    out = []
    for size in (22, 28, 54, 100, 170, 300, 700):
        for g in range(12):
            w = [f"g{size}x{g}w{i}" for i in range(size)]
            out.append((len(out), " ".join(w)))
            low = (0.62, 0.72, 0.81)[g % 3]
            c, n = list(w), size - 4
            for at in rng.permutation(size):
                trial = [*c[:at], "changed", *c[at + 1 :]]
                a, b = ({tuple(x[i : i + 5]) for i in range(n)} for x in (w, trial))
                if len(a & b) / len(a | b) < low:
                    break
                c = trial
            out.append((len(out), " ".join(c)))
    line = " ".join(f"menu{i}" for i in range(30))
    out += [(len(out), "\n".join([line] * 40)), (len(out) + 1, "\n".join([line] * 2)), (len(out) + 2, None), (len(out) + 3, " ")]
    sets = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words((t or "").lower())) else {()}
    want = linked([(d, sets(t)) for d, t in out], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    d = spark.createDataFrame(out, "doc_id long, text string")
    for crowded in (2, 4096):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(d, shingle=5, similarity=0.8, crowded=crowded).collect()}
        assert got == {i: c for i, _, c in want}


# --- op9: BPE


def test_bpe_odd_cases(spark, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_padding()
    lib.no_truncation()
    d = clashing(docs(spark), "ids", "word", "n", "decoded")
    for size in (0, 40, bpe.LEXICON_WORDS):
        t = bpe.fit(d, words=size)
        got = bpe.decode(bpe.encode(d, t), t).collect()
        want = Counter((r[0], tuple(lib.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in rows())
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got) == want
    assert bpe.token_digests(empty, bpe.fit(empty)).count() == 0


def test_merges_and_splits_equal_the_library():
    import random
    import sys

    from tokenizers import Tokenizer

    lib, rules = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Merges(bpe.Tokenizer(bpe.vocabulary_path(), b"").spec)
    rnd = random.Random(7)
    pool = [chr(c) for c in range(32, 0x250)] + list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0     ’“”–…€²¼ªº٣Ⅷ漢字ไทย\U0001f600é́") + list("'s't're've'm'll'd")
    pool = [c for c in pool if c not in "\x00"] + [chr(c) for c in rnd.sample(range(0x250, 0x3000), 200)]
    for _ in range(400):
        text = "".join(rnd.choices(pool, k=rnd.randint(1, 120)))
        if "<|endoftext|>" in text or any(0xD800 <= ord(c) < 0xE000 for c in text):
            continue
        ids = b"".join(rules.merge_all([w.encode() for w in bpe.split(text)]))
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
    word = "".join(rnd.choices("abcdefghinorst", k=5000))
    assert rules.merge(word.encode()) == lib.encode(word, add_special_tokens=False).ids
    assert sys.maxunicode > 0


def test_transducer_is_minimal_and_exact():
    words = sorted({w.encode() for w in "walk walks walked talk talks talked stalk a an ant".split()})
    t = bpe.Transducer(bpe.Transducer.compiled((w, [i, i * i]) for i, w in enumerate(words)))
    assert t.places(words).tolist() == list(range(len(words)))
    assert t.places([b"wal", b"walkss", b"", b"b", b"x" * 100]).tolist() == [-1] * 5
    # walk, talk and stalk share their suffixes: no two states have the same future.
    future = {}
    for s in range(len(t.final)):
        arcs = [(int(a) & 255, int(to)) for a, to in zip(t.arc, t.target, strict=True) if int(a) >> 8 == s]
        future.setdefault((int(t.final[s]), tuple(arcs)), []).append(s)
    assert all(len(x) == 1 for x in future.values())


# --- op10: mixing


def brute_mix(items):
    """(id, text, source) rows to [(id, size, source_size, target, taken)]."""
    group = defaultdict(list)
    for d, t, s in items:
        group["1" if s is None else "0" + s].append((d, t or ""))
    size = {s: sum(len(words(t)) for _, t in x) for s, x in group.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(group))}
    total, goal, open_ = 1.5 * sum(size.values()), {}, set(group)
    while open_:
        share = (total - sum(goal.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= 2 * size[s]}
        if not full:
            goal |= {s: weight[s] * share for s in open_}
            break
        goal |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    out = []
    for s, x in group.items():
        epochs = math.floor(goal[s] / size[s]) if size[s] else 0
        rest, at = goal[s] - epochs * size[s], 0

        def place(d, t):
            w, tie = words(t), hashlib.md5(t.encode()).hexdigest()
            q = 1 / (1 + abs(sum(map(len, w)) / len(w) - 5) / 5) if w else 1.0
            u = (int(hashlib.md5(f"mix1:{'' if d is None else d}:{tie}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / q, -1 if d is None else d, tie

        order, last = sorted(x, key=lambda r: place(*r)), -1
        for i, (_, t) in enumerate(order):
            if at + len(words(t)) / 2 <= rest:
                last = i
            at += len(words(t))
        for i, (d, t) in enumerate(order):  # of rows that tie, it doesn't matter which are taken
            n = len(words(t))
            out.append((d, n, size[s], round(goal[s], 6), n * (epochs + (i <= last))))
    return out


def test_mixing_odd_cases(spark, empty):
    ties = [(200, "a b c d e f g h i j", "en", "tied", 1)] * 300 + [(201, "one two three", "en", "tied too", 1)] * 50
    d = clashing(docs(spark, ties), "src", "size", "target", "bucket", "key", "tie", "edge", "cut", "_0", "_size")
    want = Counter(brute_mix([(r[0], r[1], r[3]) for r in [*rows(), *ties]]))
    for limit, edge in ((mixing.BROADCAST_SOURCES, mixing.EDGE_ROWS), (0, 20)):
        got = mixing.mix(d, broadcast_sources=limit, edge_rows=edge).collect()
        assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs(spark).where("doc_id in (100, 101, 102)")).agg({"taken": "sum"}).first()[0] == 0


def test_mix_comes_near_its_targets(spark, sf_dir):
    got = mixing.mix(table(spark, sf_dir, "documents")).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    source = {r.doc_id: r.source for r in table(spark, sf_dir, "documents").select("doc_id", "source").collect()}
    by = got.assign(source=got.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most / 2 + 1).all()


def test_rows_that_tie_are_taken_one_by_one(spark):
    d = spark.createDataFrame([(1, "w " * 10, "en", "a", 1)] * 1000 + [(2, "x " * 10, "en", "b", 1)] * 1000, SCHEMA)
    by = {r.doc_id: r for r in mixing.mix(d).groupBy("doc_id").agg({"taken": "sum", "target": "max"}).collect()}
    assert all(abs(by[i]["sum(taken)"] - by[i]["max(target)"]) <= 10 for i in (1, 2))


# --- op1: toxicity


def brute_features(text, lexicon):
    """The features word by word and letter by letter."""
    letters, words, cur = lambda c: c.isalnum() and not c.isdigit() and not c.isnumeric() and c != "_", [], ""
    for c in text.lower() + " ":
        if letters(c):
            cur += c
        elif cur:
            words.append(cur)
            cur = ""
    tier = lambda w: max([lexicon.words.get(w, 0)] + [t for x, t in lexicon.starts.items() if w.startswith(x) and len(x) < len(w)])
    t = [tier(w) for w in words]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    gaps = [min(abs(i - j) for j in second) for i, x in enumerate(t) if x and second]
    n, chars, strong = max(1, len(words)), max(1, len(text)), sum(x == 2 for x in t)
    return [100 * strong / n, math.log1p(strong), 100 * sum(x == 1 for x in t) / n, math.log1p(sum(x == 1 for x in t)), math.log1p(len({w for w, x in zip(words, t, strict=True) if x})),
            100 * len(second) / n, math.exp(-min(gaps) / 5) if gaps else 0, sum(g <= 5 for g in gaps) / len(gaps) if gaps else 0]


def test_features_equal_brute_force():
    lexicon = toxicity.Lexicon({"vile": 2, "meh": 1}, {"scum": 2, "dunc": 1})
    for text in ("", "You vile scumbag, you! meh", "nothing here", "vile " * 9 + "duncery du Dunce", "scum SCUMMY YOU", "meh_meh vile2vile"):
        got = toxicity.features(text, lexicon)
        assert got[:8] == pytest.approx(brute_features(text, lexicon)) and got[16] == pytest.approx(math.log1p(len(toxicity._WORD.findall(text.lower()))))
    got = dict(zip(toxicity.FEATURES, toxicity.features("You v!l3 s.c.u.m ABC!!! sooo? d-o-g", toxicity.Lexicon({"scum": 2, "vile": 2}, {})), strict=True))
    n, chars = 10, len("You v!l3 s.c.u.m ABC!!! sooo? d-o-g")
    assert got["exclamations"] == pytest.approx(100 * 4 / chars) and got["questions"] == pytest.approx(100 / chars) and got["capitals"] == pytest.approx(4 / chars)
    assert got["capital_words"] * 12 == pytest.approx(1) and got["repeated"] * 12 == pytest.approx(1) and got["disguised_hits"] == pytest.approx(math.log1p(1)) and n


def test_trees_split_as_brute_force_does():
    """One tree of one split: the best of all limits by the gain of Newton steps."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
    y[x[:, 1] > 2] = 1
    t = toxicity.Trees.fit(x, y, trees=1, depth=1, rate=1.0)
    p = y.mean()
    g, h = y - p, np.full(60, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, j] <= k) + gain(x[:, j] > k), -j, -k) for j in range(3) for k in range(5) if min(h[x[:, j] <= k].sum(), h[x[:, j] > k].sum()) >= 0.5)
    low = x[:, -best[1]] <= -best[2]
    assert (t.raw(x)[low] - math.log(p / (1 - p))) == pytest.approx(g[low].sum() / (h[low].sum() + 1))
    assert (t.raw(x)[~low] - math.log(p / (1 - p))) == pytest.approx(g[~low].sum() / (h[~low].sum() + 1))


def test_isotonic_equals_the_formula():
    """The isotonic fit at i is the greatest, over beginnings, of the least mean up to an end, around i."""
    rng = np.random.default_rng(8)
    x, y = np.arange(40.0), rng.random(40)
    knots = toxicity.isotonic(x, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    pools = [i for i in range(40) if i == 0 or want[i] - want[i - 1] > 1e-12]
    assert knots[1] == pytest.approx([want[i] for i in pools])


def test_all_different_labelled_texts_are_learned_from(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    told = {(" ".join((r.text or "").lower().split()), r.toxic != 0) for r in d.join(labels, "doc_id").where("toxic is not null").collect()}
    assert abs(toxicity.sampled(d, labels).count() - len(told)) <= 2
    again = toxicity.sampled(d.unionByName(d), labels)
    assert again.count() == toxicity.sampled(d, labels).count()


def test_toxicity_odd_cases(spark, empty):
    from pyspark.sql import functions as F

    d = clashing(docs(spark), "score", "toxic", "fold", "sketch", "predicted")
    labels = d.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") == 104, None).otherwise(F.col("doc_id") % 2).cast("int").alias("toxic"))
    for told in (labels, labels.where("toxic = 1"), labels.limit(0)):
        got = toxicity.score(d, toxicity.fit(d, told)).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d = toxicity.op1_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    pos, neg = d[d.toxic == 1], d[d.toxic == 0]
    auc = np.mean([(neg.score < s).mean() + (neg.score == s).mean() / 2 for s in pos.score])
    assert auc > 0.97 and pos.predicted.mean() > 0.85 and neg.predicted.mean() < 0.01


def test_isotonic_is_monotone_and_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    t = toxicity.Trees.fit(x[:2000], y[:2000])
    assert ((t.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    knots = toxicity.isotonic(t.raw(x[2000:]), y[2000:])
    assert (np.diff(knots[0]) > 0).all() and (np.diff(knots[1]) > 0).all() and knots[1].min() >= 0 and knots[1].max() <= 1


# --- op4: Pitman-Yor


def test_pitman_yor_odd_cases(spark, empty):
    from pyspark.sql import functions as F

    d = clashing(docs(spark), "chunk", "words", "held_out", "n_tokens", "shard")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = pitman_yor.score(d.drop("held_out"), held, chunk=200).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    low = lambda t: (t or "").encode().lower().split()
    c = Counter(w for r in rows() if not out(r[0]) for w in low(r[1]))
    c["END"] = sum(not out(r[0]) for r in rows())
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows():
        t = [*low(r[1]), "END"]
        want[r[0], out(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.score(empty, held).count() == 0
    assert all(math.isfinite(r.score) for r in pitman_yor.score(d.limit(5), F.lit(True)).collect())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_pitman_yor_predicts_held_out_text(spark, sf):
    got = pitman_yor.op4_pitman_yor(spark, f"/root/testdata/{sf}").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_split_contexts_and_many_shards_score_alike(spark, sf_dir, monkeypatch):
    """A context dealt to many shards has the same chances, but for sampling."""
    from pyspark.sql import functions as F

    d, held = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    total = lambda **k: pitman_yor.score(d, held, **k).groupBy("held_out").agg(F.sum("score").alias("s")).orderBy("held_out").collect()
    one = total(pair_shards=1)
    monkeypatch.setattr(pitman_yor, "SPLIT", 500)
    many = total(chunk=20_000, shards=7, pair_shards=9)
    assert all(a.s == pytest.approx(b.s, rel=0.02) for a, b in zip(one, many, strict=True))


def test_spelling_sums_to_one():
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(300)]
    code, _ = pitman_yor._spelled(words)
    grams, n = np.unique(code, return_counts=True)
    s = pitman_yor.Spelling.fit(grams, n)
    for before in (0, ord("a") << 9, ord("b") << 17 | ord("c") << 9, ord("z") << 17 | ord("z") << 9, ord("z") << 17 | ord("a") << 9):
        assert s.chances(before | np.arange(pitman_yor.BYTES)).sum() == pytest.approx(1, abs=1e-9)
    assert s.log10([b"abca"])[0] > s.log10([b"zzzz"])[0] and math.isfinite(s.log10([b""])[0])


class BruteHierarchy:
    """Restaurants customer by customer: contexts of two bytes, one, none, and a uniform base."""

    def __init__(self, rng, d, theta):
        self.rng, self.d, self.theta, self.seats = rng, d, theta, defaultdict(lambda: defaultdict(list))

    def shorter(self, ctx):
        return (len(ctx) - 1, ctx[1:]) if ctx else None

    def p(self, ctx, dish):
        if ctx is None:
            return 1 / pitman_yor.BYTES
        r = self.seats[ctx]
        n, t = sum(map(sum, r.values())), sum(map(len, r.values()))
        below = self.p(ctx[1:] if ctx else None, dish)
        return (sum(r[dish]) - self.d * len(r[dish]) + (self.theta + self.d * t) * below) / (self.theta + n)

    def add(self, ctx, dish):
        if ctx is None:
            return
        r = self.seats[ctx]
        new = (self.theta + self.d * sum(map(len, r.values()))) * self.p(ctx[1:] if ctx else None, dish)
        w = np.array([*[x - self.d for x in r[dish]], new])
        at = self.rng.choice(len(w), p=w / w.sum())
        if at == len(r[dish]):
            r[dish].append(1)
            self.add(ctx[1:] if ctx else None, dish)
        else:
            r[dish][at] += 1

    def remove(self, ctx, dish):
        if ctx is None:
            return
        x = self.seats[ctx][dish]
        at = self.rng.choice(len(x), p=np.array(x) / sum(x))
        x[at] -= 1
        if not x[at]:
            x.pop(at)
            self.remove(ctx[1:] if ctx else None, dish)


def test_spelling_equals_sequential_gibbs(monkeypatch):
    """With fixed discount and strength, averaged predictions of three levels against single customers taken up and seated."""
    d, theta = 0.5, 1.0
    words = [b"ab", b"abc", b"abab", b"cab", b"b", b"abba", b"ab", b"ca", b"cc", b"bab"]
    customers = [((*([0, 0, *w][i : i + 2]),), (*w, 256)[i]) for w in words for i in range(len(w) + 1)]
    rng = np.random.default_rng(2)
    brute = BruteHierarchy(rng, d, theta)
    for c in customers:
        brute.add(*c)
    asked = sorted(set(customers)) + [((0, 0), ord("z")), ((ord("b"), ord("b")), ord("b"))]
    total, turns = np.zeros(len(asked)), 0
    for turn in range(160):
        for c in customers:
            brute.remove(*c)
            brute.add(*c)
        if turn >= 20:
            total += [brute.p(*a) for a in asked]
            turns += 1
    monkeypatch.setattr(restaurants.Restaurants, "_parameters", lambda self: (setattr(self, "k", 9), setattr(self, "theta", theta)))
    monkeypatch.setattr(pitman_yor, "SAMPLES", 150)
    monkeypatch.setattr(pitman_yor, "BURN_IN", 20)
    monkeypatch.setattr(restaurants.Restaurants, "d", property(lambda self: d))
    code, _ = pitman_yor._spelled(words)
    s = pitman_yor.Spelling.fit(*np.unique(code, return_counts=True))
    got = s.chances(np.array([x | b << 9 | a << 17 for (a, b), x in asked]))
    assert np.abs(np.log(got) - np.log(total / turns)).max() < 0.12


def test_tables_are_drawn_from_their_conditional():
    """Of one restaurant, against single customers taken up and seated; large dishes by Metropolis-Hastings agree with exact draws."""
    rng, c, p, d, theta = np.random.default_rng(0), [5, 9, 2, 14], [0.3, 0.2, 0.1, 0.05], 0.5, 3.0
    tables, total = [[k] for k in c], []
    for turn in range(500):
        for i, n in enumerate(c):
            for _ in range(n):
                x = tables[i]
                at = rng.choice(len(x), p=np.array(x) / sum(x))
                x[at] -= 1
                if not x[at]:
                    x.pop(at)
                w = np.array([*[y - d for y in x], (theta + d * sum(map(len, tables))) * p[i]])
                at = rng.choice(len(w), p=w / w.sum())
                if at == len(x):
                    x.append(1)
                else:
                    x[at] += 1
        if turn >= 20:
            total.append([len(x) for x in tables])
    r = restaurants.Restaurants(rng, np.zeros(4, int), np.array(c), 1)
    r._parameters, r.k, r.theta = (lambda: None), 9, theta
    got = []
    for _ in range(6000):
        r.sweep(np.array(p))
        got.append(r.t.copy())
    assert np.mean(got, 0) == pytest.approx(np.mean(total, 0), abs=0.2)
    seen, rest = r.shares()
    assert seen.sum() + rest[0] == pytest.approx(1, abs=1e-12)


def test_stirling_numbers_of_large_dishes():
    for k in (1, 9, 13, 17):
        d, exact = float(restaurants.DISCOUNTS[k]), restaurants.stirling()[k]
        t = np.array([1, 2, 5, 12, 30, 80, 150, 250])
        assert restaurants.log_stirling(np.full(len(t), 256), t, d) == pytest.approx(exact[256, t], abs=0.06)
    assert np.exp(restaurants.stirling()[9][3, 1:4]) == pytest.approx([0.5 * 1.5, 3 * 0.5, 1])


def test_parts_of_a_restaurant_sum_to_one():
    rng = np.random.default_rng(3)
    at, c = rng.integers(0, 5, 400), rng.zipf(1.8, 400)
    whole = np.bincount(at, c, 5).astype(int)
    parts = np.arange(400) % 3
    total = np.zeros(5)
    for part in range(3):
        m = parts == part
        r = restaurants.Restaurants(rng, at[m], c[m], 5, np.full(5, 3.0), whole)
        seen, rest = restaurants.sampled(r, np.full(m.sum(), 1 / 400), 2, 3)
        total += np.bincount(at[m], seen, 5) + rest
    assert total == pytest.approx(1, abs=1e-9)
