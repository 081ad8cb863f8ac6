"""URL filter: rules on host and path, and for what no rule fits, the ratio of two character Markov models.

Models of variable order (contexts of up to `ORDER` characters, as far as they were seen) for the URLs that rules
accept and reject, smoothed by Witten-Bell interpolation from each order to the one below. They read whole URLs, query
and fragment too. A URL's score is the log-likelihood difference by its length; the threshold is calibrated on
rule-judged URLs that the models didn't see.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import ascii_lower, least_count, materialise, table

#: (verdict, host, start of the path); the rule's name is host and path together.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 5
#: URLs whose md5's first 8 digits are divisible by 5 calibrate, the others train.
FOLDS = 5
#: Characters that smoothing gives a share to.
ALPHABET = 256
#: So many scored n-grams (about 40 bytes each), the most frequent, are broadcast; URLs meet the others by shuffle.
BROADCAST_GRAMS = 200_000


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of name and verdict; else null. A rule fits its host and all subdomains."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    made = lambda r: F.struct(F.lit(r[1] + r[2]).alias("name"), F.lit(r[0]).alias("verdict"))
    return reduce(lambda rest, r: F.when(fits(r), made(r)).otherwise(rest), reversed(longest), F.lit(None).cast("struct<name:string,verdict:string>"))


def _grams(df: DataFrame) -> DataFrame:
    """One row for each character of `s`, with the ORDER characters before it; starts are padded, one end is added."""
    padded = F.split(F.concat(F.lit("\x02" * ORDER), "s", F.lit("\x03")), "")
    d = df.withColumn("p", padded)
    gram = F.transform(F.sequence(F.lit(0), F.size("p") - ORDER - 1), lambda i: F.concat(*[F.col("p")[i + k] for k in range(ORDER + 1)]))
    # No array is empty; the plain explode would be filtered by its size first, with the split made anew for each n-gram.
    return d.withColumn("gs", gram).drop("p", "s").withColumn("g", F.explode_outer("gs")).drop("gs")


def model(full: DataFrame, scored: DataFrame) -> DataFrame:
    """g, n, llr: log-likelihood difference of the last character of each n-gram of `scored` (g, n).

    full: g, good, n, the n-grams of the accepted and rejected URLs. Each order's counts are sums of the full n-grams'.
    """
    counts = full.groupBy("g").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("r"))
    counts = materialise(counts, "url-counts")
    out = scored.groupBy("g").agg(F.sum("n").alias("n")).withColumns({"pa": F.lit(1.0 / ALPHABET), "pr": F.lit(1.0 / ALPHABET)})
    for k in range(ORDER + 1):
        tail, before = F.substr("g", F.lit(ORDER + 1 - k)), F.substr("g", F.lit(ORDER + 1 - k), F.lit(k))
        at = counts.groupBy(tail.alias("gk")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        ctx = at.groupBy(F.substr("gk", F.lit(1), F.lit(k)).alias("ck")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        out = out.withColumns({"gk": tail, "ck": before}).join(at, "gk", "left").join(ctx, "ck", "left")
        step = lambda p, n, c, t: F.expr(f"if(coalesce({c}, 0) > 0, (coalesce({n}, 0) + {t} * {p}) / ({c} + {t}), {p})")
        out = out.select("g", "n", step("pa", "a", "ca", "ta").alias("pa"), step("pr", "r", "cr", "tr").alias("pr"))
    return out.select("g", "n", F.log(F.col("pa") / F.col("pr")).alias("llr"))


def _scores(grams: DataFrame, llr: DataFrame, broadcast_grams: int) -> DataFrame:
    """uid, score (mean llr) of grams (uid, g). Frequent n-grams are broadcast, so what is shuffled by n-gram has no hot key."""
    least = least_count(llr, "n", broadcast_grams)
    often = llr.where(F.col("n") >= least).select("g", "llr") if least is not None else llr.limit(0).select("g", "llr")
    met = grams.join(F.broadcast(often), "g", "left")
    near = met.where("llr is not null").groupBy("uid").agg(F.sum("llr").alias("x"), F.count("*").alias("n"))
    if llr.agg(F.min("n")).first()[0] != least:
        rest = llr.where(F.col("n") < least) if least is not None else llr
        far = met.where("llr is null").select("uid", "g").join(rest.select("g", "llr"), "g").groupBy("uid").agg(F.sum("llr").alias("x"), F.count("*").alias("n"))
        near = near.unionByName(far).groupBy("uid").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return near.select("uid", (F.col("x") / F.col("n")).alias("score"))


def judge(pages: DataFrame, rules=RULES, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """page_id, host, path, rule, score (null where a rule fits), verdict of every page.

    pages: page_id, url, and whatever else (ignored). A null url, or one without ://, has an empty host and path; a null
    one is scored as an empty text, others as they are written. Repeated rows are judged alike; a score at the threshold
    is allowed; a very long URL is read whole, in time in proportion; an empty table gives an empty result. Where rules
    judge no URL to train one of the models, or none to calibrate one side, all others are allowed.
    """
    host, path = parse(F.col("url"))
    d = pages.select("page_id", F.coalesce("url", F.lit("")).alias("s"), host.alias("host"), path.alias("path"))
    d = d.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    d = d.select("page_id", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("told"), "s", (F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS == 0).alias("calibrates"))
    d = materialise(d, "urls")
    # What is alike is modelled and scored once.
    kinds = d.groupBy("s", "told", "calibrates").agg(F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id())
    kinds = materialise(kinds, "url-kinds")
    learn = kinds.where("told is not null and not calibrates").select("s", (F.col("told") == "allow").alias("good"), "copies")
    sides = {r["good"] for r in learn.select("good").distinct().collect()}
    full = _grams(learn).groupBy("g", "good").agg(F.sum("copies").alias("n"))
    scored = kinds.where("told is null or calibrates").select("uid", "s")
    grams = _grams(scored)
    llr = materialise(model(full, grams.groupBy("g").agg(F.count("*").alias("n"))), "url-grams")
    per_s = materialise(kinds.select("uid", "s", "told", "calibrates", "copies").join(_scores(grams, llr, broadcast_grams), "uid"), "url-scores")
    known = per_s.where("told is not null")
    moments = lambda v, c: F.sum(F.when(F.col("told") == v, c))
    n, x, xx = F.col("copies"), F.col("copies") * F.col("score"), F.col("copies") * F.col("score") * F.col("score")
    cal = known.agg(*[moments(v, c).alias(f"{k}{v[0]}") for v in ("allow", "block") for k, c in (("n", n), ("x", x), ("xx", xx))])
    # Where two normal curves of the scores, one each, have their means the same number of deviations away.
    cal = cal.select(*[(F.col(f"x{v}") / F.col(f"n{v}")).alias(f"m{v}") for v in "ab"], *[F.sqrt(F.greatest(F.col(f"xx{v}") / F.col(f"n{v}") - F.pow(F.col(f"x{v}") / F.col(f"n{v}"), 2), F.lit(1e-12))).alias(f"d{v}") for v in "ab"])
    cal = cal.select(((F.col("ma") * F.col("db") + F.col("mb") * F.col("da")) / (F.col("da") + F.col("db"))).alias("limit"))
    limit = cal.first()["limit"] if sides == {True, False} else None
    by_model = F.lit("allow") if limit is None else F.when(F.col("score") < limit, "block").otherwise("allow")
    # Only pages that no rule fits need their scores.
    judged = d.where("told is not null").withColumn("score", F.lit(None).cast("double"))
    open_ = d.where("told is null").join(per_s.where("told is null").select("s", "score"), "s")
    return judged.unionByName(open_).select("page_id", "host", "path", "rule", "score", F.coalesce("told", by_model).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """The query in SQL, order by order."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    out = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {low}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
ru(verdict, rhost, rpath) AS (VALUES {rules}),
fit AS (SELECT h.*, rhost || rpath AS rule, verdict AS told, row_number() OVER (PARTITION BY page_id, h.url ORDER BY length(rhost || rpath) DESC NULLS LAST) AS place
        FROM h LEFT JOIN ru ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
d AS (SELECT page_id, host, path, rule, told, url AS s, ('0x' || substr(md5(url), 1, 8))::BIGINT % {FOLDS} = 0 AS calibrates FROM fit WHERE place = 1),
q AS (SELECT *, repeat(chr(2), {ORDER}) || s || chr(3) AS padded FROM d),
g AS (SELECT page_id, s, told, calibrates, substr(padded, i, {ORDER + 1}) AS g FROM (SELECT *, unnest(range(1, length(padded) - {ORDER} + 1)) AS i FROM q)),
full_counts AS (SELECT g, count(*) FILTER (told = 'allow') AS a, count(*) FILTER (told = 'block') AS r FROM g WHERE told IS NOT NULL AND NOT calibrates GROUP BY g),
m0 AS (SELECT DISTINCT g, 1.0::DOUBLE / {ALPHABET} AS pa, 1.0::DOUBLE / {ALPHABET} AS pr FROM g WHERE told IS NULL OR calibrates)"""
    for k in range(ORDER + 1):
        out += f""",
at{k} AS (SELECT substr(g, {ORDER + 1 - k}) AS gk, sum(a) AS a, sum(r) AS r FROM full_counts GROUP BY 1),
ctx{k} AS (SELECT substr(gk, 1, {k}) AS ck, sum(a) AS ca, sum(r) AS cr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM at{k} GROUP BY 1),
m{k + 1} AS (SELECT g, CASE WHEN coalesce(ca, 0) > 0 THEN (coalesce(a, 0) + ta * pa) / (ca + ta) ELSE pa END AS pa, CASE WHEN coalesce(cr, 0) > 0 THEN (coalesce(r, 0) + tr * pr) / (cr + tr) ELSE pr END AS pr
        FROM m{k} LEFT JOIN at{k} ON gk = substr(g, {ORDER + 1 - k}) LEFT JOIN ctx{k} ON ck = substr(g, {ORDER + 1 - k}, {k}))"""
    return out + f""",
score AS (SELECT s, avg(ln(pa / pr)) AS score FROM (SELECT DISTINCT s, padded FROM q) u, unnest(range(1, length(padded) - {ORDER} + 1)) t(i) JOIN m{ORDER + 1} m ON m.g = substr(padded, i, {ORDER + 1}) GROUP BY s),
side AS (SELECT told, avg(score) AS m, greatest(stddev_pop(score), 1e-6) AS d FROM d JOIN score USING (s) WHERE told IS NOT NULL AND calibrates GROUP BY told),
lim AS (SELECT (a.m * b.d + b.m * a.d) / (a.d + b.d) AS cut FROM side a, side b WHERE a.told = 'allow' AND b.told = 'block'
        AND (SELECT count(DISTINCT told) FROM d WHERE told IS NOT NULL AND NOT calibrates) = 2)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN score.score < (SELECT cut FROM lim) THEN 'block' ELSE 'allow' END) AS verdict FROM d LEFT JOIN score USING (s)"""


OP5_SQL = _oracle()
