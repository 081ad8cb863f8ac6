"""Top-k, WARC, URL filter and the pipeline, with the odd cases."""

import base64
import hashlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, clashing, docs, words

from rastrel.llm import bpe, url_filter, vector_topk, warc
from rastrel.llm.common import table

# --- op2: exact top-k


def brute_top(rows, k=5, every=50):
    """Of every query row, among all rows but itself; scores beyond a long as the nearest."""
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for a, (i, x) in enumerate(v):
        if i is not None and i % every == 0:
            s = sorted((-sum(m * n for m, n in zip(x, y, strict=True)), j is None, j or 0) for b, (j, y) in enumerate(v) if b != a and len(y) == len(x))
            out.update((i, r, None if none else j, max(-(2**63), min(2**63 - 1, -n))) for r, (n, none, j) in enumerate(s[:k], 1))
    return out


KIND = "vec_id long, embedding array<float>"


def test_top_k_odd_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(2000, None), (2050, [None] * 6), (2100, [float("nan")] + [0.1] * 5), (2150, [float("inf")] * 6), (None, [0.1] * 6), (2200, [0.25, 0.5]), (2201, [1.0, -0.5]), (2250, []), (2251, [])]
    rows += rows[:120]  # ids that repeat are rows of their own
    rows += [(3000 + i, rng.normal(0, 10.0 ** (i % 39), 6).astype(np.float32).tolist()) for i in range(117)]  # up to what a float holds
    d = clashing(spark.createDataFrame(rows, KIND), "label", "v", "dim", "score", "rank", "query_id", "rid", "block")
    for options in ({}, {"pivots": 2, "sample": 3}):
        assert Counter(map(tuple, vector_topk.top_k(d, **options).collect())) == brute_top(rows)
    large = [(0, [300000.0, 1.0]), (1, [1.0, 1.0]), (2, [1e6, -1e6]), (50, [1.0, 0.5])]
    assert Counter(map(tuple, vector_topk.top_k(spark.createDataFrame(large, KIND)).collect())) == brute_top(large)
    long = [(i * 25, rng.normal(0, 1, 20_000).astype(np.float32).tolist()) for i in range(6)]
    assert Counter(map(tuple, vector_topk.top_k(spark.createDataFrame(long, KIND)).collect())) == brute_top(long)
    assert vector_topk.top_k(spark.createDataFrame([], KIND)).count() == 0
    assert vector_topk.top_k(spark.createDataFrame([(0, [0.5])], KIND)).count() == 0


def test_top_k_over_many_blocks_and_slabs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3, (5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.2, 8)).astype(np.float32).tolist()) for i in range(900)]
    d = spark.createDataFrame(rows, KIND)
    assert Counter(map(tuple, vector_topk.top_k(d, vector_block=60, query_block=3, slab=7).collect())) == brute_top(rows)


# --- op7: WARC

PAGES = "page_id long, url string, html string"


def brute_warc(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    return out


def test_warc_odd_cases(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>\r\n\r\nWARC/1.0\r\n") for i in range(40)]
    rows += [(50, None, None), (51, "http://x/\r\nEvil: 1", ""), (52, "é", "é" * 200_000), (53, "u", None), (None, "n", "lone"), (None, "n", "<p>page 1</p>\r\n\r\nWARC/1.0\r\n"), (54, "u", "tie"), (54, "u", "tie")]
    d = clashing(spark.createDataFrame(rows, PAGES), "digest", "first", "refers_to", "archive", "n")
    for size in (warc.ARCHIVE_BYTES, 500):
        assert Counter(map(tuple, warc.read(warc.archive(d, archive_bytes=size)).collect())) == brute_warc(rows)
    assert warc.read(warc.archive(spark.createDataFrame([], PAGES))).count() == 0


def test_warc_short_payloads_are_responses(spark):
    d = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES)
    got = {r.page_id: r.record_type for r in warc.read(warc.archive(d, min_bytes=4)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_normaliser_reads_streams_and_refuses_broken_ones():
    raw = b"".join(warc.record(i, "u", b"x" * i, warc.digest_of(b"x" * i)) for i in range(50))
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = whole.compress(raw) + whole.flush()
    assert [int(f["content-length"]) for f, _ in warc.records(warc.inflated(io.BytesIO(one)))] == [int(f["content-length"]) for f, _ in warc.records(iter([raw]))]
    assert b"".join(r for _, r in warc.records(warc.inflated(io.BytesIO(one + one)))) == raw + raw
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(one[:-20]))))


def test_index_finds_single_members(spark, tmp_path):
    import json

    done = warc.archive(table(spark, "/root/testdata/sf0.001", "pages"))
    r = done.first()
    fs, name = warc._open(r["archive"])
    with fs.open_input_file(name) as f, fs.open_input_stream(name + ".idx") as g:
        members = [json.loads(x) for x in g.read().splitlines()]
        m = members[len(members) // 2]
        f.seek(m["offset"])
        (fields, _), *rest = warc.records(iter([zlib.decompress(f.read(m["length"]), 31)]))
    assert fields["warc-record-id"] == m["id"] and not rest and r["records"] == len(members)


# --- op5: URL filter


def brute_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[at:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), path[:cut]


def brute_rule(host, path):
    best = None
    for v, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_urls_odd_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?q#f", "http://example.net", "http://a.net?x/y", "http://notnet/", "http://net/", "http://x.org/fr/1", "http://x.org/fr", "http://example.com/de/", "http://sub.example.com/de/a#b", "a://b://c/d", "http://ÄÖ.org/fr/é\n"]
    urls += [f"http://site{i}.example.{'net' if i % 2 else 'org'}/{'fr' if i % 3 else 'de'}/{i}" for i in range(200)] + ["http://s.example.com/en/1"] * 3
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://q.info/a", None)]
    d = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "host", "path", "s", "told", "score", "g", "of")
    for limit in (url_filter.BROADCAST_GRAMS, 0):
        got = url_filter.judge(d, broadcast_grams=limit).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute_parse(u), (brute_rule(*brute_parse(u)) or (None,))[0]) for i, u, _ in rows)
        for r in got:
            told = brute_rule(r.host, r.path)
            assert r.verdict in ("allow", "block") and (told is None or (r.verdict == told[1] and r.score is None))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame([(1, "http://q.info/a")], "page_id long, url string")).collect()} == {"allow"}


def brute_scores(urls):
    """Scores of the URLs without a rule, and the limit, by plain counting over whole URLs."""
    k, count = url_filter.ORDER, {"allow": Counter(), "block": Counter()}
    told = lambda u: (brute_rule(*brute_parse(u)) or (None, None))[1]
    fold = lambda u: int(hashlib.md5((u or "").encode()).hexdigest()[:8], 16) % url_filter.FOLDS
    grams = lambda s: [("\x02" * k + (s or "") + "\x03")[i : i + k + 1] for i in range(len(s or "") + 1)]
    for u in urls:
        if told(u) and fold(u):
            count[told(u)].update(grams(u))
    after = {v: {} for v in count}  # by context, how often each character follows
    for v, c in count.items():
        for x, n in c.items():
            for o in range(k + 1):
                after[v].setdefault((o, x[k - o : k]), Counter())[x[k]] += n

    def p(v, g):
        out = 1 / url_filter.ALPHABET
        for o in range(k + 1):
            if at := after[v].get((o, g[k - o : k])):
                out = (at[g[k]] + len(at) * out) / (at.total() + len(at))
        return out

    llr = lambda g: math.log(p("allow", g) / p("block", g))
    score = lambda u: np.mean([llr(g) for g in grams(u)])
    known = {v: [score(u) for u in urls if told(u) == v and not fold(u)] for v in count}
    (ma, da), (mb, db) = ((np.mean(known[v]), max(np.std(known[v]), 1e-6)) for v in ("allow", "block"))
    return {u: score(u) for u in urls if told(u) is None}, (ma * db + mb * da) / (da + db)


def test_url_models_need_both_sides(spark):
    """With URLs of one side to learn from alone, all that no rule fits is allowed."""
    folds = lambda u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % url_filter.FOLDS
    net, org = ([f"http://s{i}.{h}" for i in range(60)] for h in ("net/x", "org/fr/x"))
    urls = [u for u in net if not folds(u)] + org + ["http://other.info/a", "x" * 20_000, "http://long.info/" + "y" * 50_000]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.verdict for r in got if r.rule is None} == {"allow"} and len(got) == len(urls)


def test_url_scores_equal_brute_force(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    scores, limit = brute_scores([r.url for r in pages.collect()])
    n = 0
    for r in url_filter.judge(pages, broadcast_grams=400).join(pages.select("page_id", "url"), "page_id").collect():
        if r.rule is None:
            assert r.score == pytest.approx(scores[r.url], abs=1e-9)
            assert r.verdict == ("block" if scores[r.url] < limit else "allow") or abs(scores[r.url] - limit) < 1e-9
            n += 1
    assert n > 20


# --- the pipeline


def brute_quality(rows):
    """doc_id and left text of the rows that stay: 20 distinct documents of a source may hold a line, half of the words must stay."""
    from test_documents import base

    keys_of = {}
    for i, r in enumerate(rows):
        keys_of[i] = [x.lower().strip(" \t\n\x0b\x0c\r") for x in (r.text or "").split("\n")]
    seen = {}
    for i, r in enumerate(rows):
        for k in set(keys_of[i]) - {""}:
            seen.setdefault((r.source, k), set()).add(tuple(x for x in keys_of[i] if x))
    out = []
    for i, r in enumerate(rows):
        n, _, _, _, repeated = base(r.text)
        lines = [x for x, k in zip((r.text or "").split("\n"), keys_of[i], strict=True) if not k or len(seen[r.source, k]) <= 20]
        if n >= 50 and 100 * repeated <= 50 * n and 2 * sum(len(words(x)) for x in lines) >= n:
            out.append((r.doc_id, "\n".join(lines)))
    return out


def brute_near(texts, least=0.8):
    """Classes of ids whose sets of five-word shingles are linked at that similarity; {id: least id of its class}."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() for w in [t.encode().lower().split()]}
    holders, root = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    for d, s in sets.items():
        common = Counter(e for x in s for e in holders[x] if e < d)
        for e, n in common.items():
            if n >= least * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d in sets}


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Every stage on the small tables, and the whole, by plain Python."""
    import corpus_pipeline as p
    from test_documents import brute_mix, lines_dropped

    all_docs = table(spark, sf_dir, "documents")
    kept = p.quality_stage(spark, all_docs, sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(brute_quality(all_docs.collect())) and kept[0].asDict().keys() == set(p.COLUMNS)
    step1 = spark.createDataFrame(kept, all_docs.schema)
    step2 = p.line_stage(spark, step1, sf_dir).collect()
    want = {r.doc_id: x[2] for r, x in zip(kept, lines_dropped([r.text for r in kept]), strict=True)}
    assert {r.doc_id: r.text for r in step2} == want and all(r.n_chars == len(r.text) for r in step2)
    step3 = p.near_dedup_stage(spark, spark.createDataFrame(step2, all_docs.schema), sf_dir).collect()
    classes, left = brute_near({r.doc_id: r.text for r in step2}), {r.doc_id for r in step3}
    copies = {d for d, c in classes.items() if d != c}
    assert copies and not (set(classes) - left) - copies  # nothing goes that has no near copy
    assert len(copies - left) >= 0.95 * len(copies)  # slices of long texts may lose a pair
    step4 = p.mixing_stage(spark, spark.createDataFrame(step3, all_docs.schema), sf_dir).collect()
    times = {d: t // n for d, n, _, _, t in brute_mix([(r.doc_id, r.text, r.source) for r in step3]) if n}
    assert Counter(r.doc_id for r in step4) == Counter({d: t for d, t in times.items() if t})
    step5 = p.bpe_stage(spark, spark.createDataFrame(step4, all_docs.schema), sf_dir).collect()
    from tokenizers import Tokenizer

    lib, text = Tokenizer.from_file(bpe.vocabulary_path()), {r.doc_id: r.text for r in step4}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    told = {d: lib.encode(t, add_special_tokens=False).ids for d, t in text.items()}
    for r in step5:
        ids = told[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(lib.decode(ids, skip_special_tokens=False).encode()))
    run = Counter(map(tuple, p.run(spark, sf_dir).collect()))
    assert run == Counter(map(tuple, step5))


def test_pipeline_stages_odd_cases(spark, sf_dir):
    import corpus_pipeline as p

    empty = spark.createDataFrame([], SCHEMA)
    for odd in (docs(spark), clashing(docs(spark), "tie", "kept", "text2", "src", "times", "fp"), empty):
        for name, stage in p.STAGES:
            out = stage(spark, odd, sf_dir)
            if stage is not p.bpe_stage:
                assert out.columns == list(p.COLUMNS), name
            assert out.count() >= 0
    assert Counter(r.doc_id for r in p.near_dedup_stage(spark, docs(spark), sf_dir).collect())[104] <= 2


def test_near_dedup_keeps_unlike_texts_without_ids_or_with_one_id(spark, sf_dir):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"t{k}x{i}" for i in range(60))
    odd = spark.createDataFrame([(i, text(k), "en", "a", 1) for k, i in enumerate((None, None, None, 7, 7))] + [(None, text(0), "de", "b", 1), (8, text(3), "en", "a", 1)], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in p.near_dedup_stage(spark, odd, sf_dir).collect())
    assert got == Counter({(None, text(0)): 1, (None, text(1)): 1, (None, text(2)): 1, (7, text(3)): 1, (7, text(4)): 1})
