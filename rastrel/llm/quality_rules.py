"""Quality rules on cross-document line frequency, in DataFrame functions alone.

Lines are normalised and hashed; for each host (here: the source) the distinct documents that hold a line are counted. A
line in more of them than the limit is removed. Documents with the same lines in the same order are one, so a group of
copies doesn't make its own lines boilerplate.
A document that loses too many of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import WS, materialise, table, words

MIN_WORDS = 50
#: A line in more distinct documents of a host than this is removed.
MAX_DOCS = 20
#: A document that keeps less than this share of its words is rejected.
LEAST_KEPT = 0.5
#: Up to so many frequent lines (16 bytes each) are broadcast, and documents of up to so many lines look theirs up in place;
#: beyond either, lines meet them as rows.
BROADCAST_LINES, LONG_LINES = 20_000, 1000
#: Keys that a frequent line is spread over in that shuffle.
SALT = 32


def host_of() -> Column:
    """The source, told from none."""
    return F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))


def _runs(w: Column, n: Column, bits: Column) -> Column:
    """Each 3-word window as a long: its hash's lower bits above its position in the lower `bits`."""
    at = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", at(i), bits).bitwiseOR(i.cast("long")))).otherwise(F.array().cast("array<long>"))


def base_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry..., host, raw (lines), and the counts of the base rules for each document. No shuffle.

    n_repeat_words: windows are packed with their positions and sorted as plain longs, so equal ones come together; those
    whose hash bits occur twice are then sorted by their words, which decide.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*carry, host_of().alias("host"), text.alias("t"), words(F.col("text")).alias("w"))
    d = d.withColumn("n", F.size("w")).withColumn("bits", F.ceil(F.log2(F.col("n") + 2)).cast("int"))
    d = d.withColumn("run", F.sort_array(_runs(F.col("w"), F.col("n"), F.col("bits"))))
    d = d.select(
        *carry,
        "host",
        "t",
        "w",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as long)").alias("n_symbols"),
        F.split("t", "\n").alias("raw"),
        # Window starts whose hash bits a neighbour in the sorted array has too.
        F.expr(
            "transform(filter(run, (x, i) -> (i > 0 and shiftright(run[i - 1], bits) = shiftright(x, bits))"
            " or (i + 1 < size(run) and shiftright(run[i + 1], bits) = shiftright(x, bits))), x -> cast(x & (shiftleft(1L, bits) - 1) as int))"
        ).alias("alike"),
    )
    spelled = F.expr("if(size(alike) = 0, cast(array() as array<struct<g:string,p:int>>), sort_array(transform(alike, p -> struct(concat_ws(' ', w[p], w[p + 1], w[p + 2]) as g, p as p))))")
    d = d.withColumn("spelled", spelled).drop("w", "alike")
    twice = F.expr("sort_array(transform(filter(spelled, (x, i) -> (i > 0 and spelled[i - 1].g = x.g) or (i + 1 < size(spelled) and spelled[i + 1].g = x.g)), x -> x.p))")
    d = d.withColumn("twice", twice).drop("spelled")
    worded = F.filter("raw", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("worded", worded).select(
        *carry,
        "host",
        "raw",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(twice, (x, i) -> if(i + 1 < size(twice), least(3, twice[i + 1] - x), 3)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def line_key(line: Column) -> Column:
    """Hash of a line, lower-cased and without white space at its ends; null for lines without a word."""
    key = F.btrim(F.lower(line), F.lit(WS))
    return F.when(key != "", F.xxhash64(key))


def _lines(raw: Column) -> Column:
    return F.transform(raw, lambda x: F.struct(line_key(x).alias("h"), F.size(words(x)).alias("n")))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, h: lines that more than max_docs distinct documents of a host (the source) hold.

    A line counts once a document, and documents with the same lines (but for blank ones) in the same order are one.
    """
    d = docs.select(host_of().alias("host"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key).alias("h"))
    d = d.select("host", F.xxhash64("h").alias("copy"), F.array_distinct("h").alias("keys"))  # so that no row of explode carries the lines
    seen = d.select("host", "copy", F.explode_outer("keys").alias("h")).where("h is not null").distinct()
    return seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("host", "h")


def _in_place(d: DataFrame, often: DataFrame) -> DataFrame:
    """base_rules' rows with gone (words of frequent lines) and kept_text; each host's frequent lines are broadcast."""
    per_host = often.groupBy("host").agg(F.collect_set("h").alias("often"))
    d = d.withColumn("lines", _lines(F.col("raw"))).join(F.broadcast(per_host), "host", "left")
    d = d.withColumn("hit", F.when(F.col("often").isNotNull(), F.array_intersect("lines.h", "often")).otherwise(F.array().cast("array<long>"))).drop("often")
    gone = F.expr("if(size(hit) = 0, 0L, aggregate(filter(lines, x -> x.h is not null and array_contains(hit, x.h)), 0L, (a, x) -> a + x.n))")
    left = F.expr("array_join(if(size(hit) = 0, raw, transform(filter(arrays_zip(raw, lines), z -> z.lines.h is null or not array_contains(hit, z.lines.h)), z -> z.raw)), '\n')")
    # The number of the row keeps a caller's filter above: pushed below, it would have arrays made anew for each element.
    return d.withColumns({"gone": gone, "kept_text": left, "_row": F.monotonically_increasing_id()}).where("_row >= 0").drop("lines", "hit", "raw", "host", "_row")


def _as_rows(d: DataFrame, often: DataFrame, few: bool, texts: bool) -> DataFrame:
    """The same for any number of frequent lines, and documents of any number of lines, which meet them as rows."""
    d = materialise(d.withColumn("lines", _lines(F.col("raw"))).withColumn("rid", F.monotonically_increasing_id()), "quality-lines")

    def hits(lines: DataFrame) -> DataFrame:
        """The rows of lines (host, h, rid, ...) that are frequent. A line of a third of all documents is one broadcast row, or SALT keys."""
        if few:
            return lines.join(F.broadcast(often), ["host", "h"], "left_semi")
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        return lines.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALT)).cast("int")).join(salted, ["host", "h", "salt"], "left_semi").drop("salt")

    lines = d.select("rid", "host", F.posexplode(F.arrays_zip(F.col("raw"), F.col("lines"))).alias("i", "x")).select("rid", "host", "i", F.col("x.raw").alias("raw"), F.col("x.lines.h").alias("h"), F.col("x.lines.n").alias("n"))
    struck = materialise(hits(lines.where("h is not null").select("rid", "host", "h", "i", "n")).select("rid", "i", "n"), "quality-struck")
    gone = struck.groupBy("rid").agg(F.sum("n").alias("gone"))
    out = d.drop("lines", "host").join(gone, "rid", "left")
    if not texts:
        return out.drop("rid", "raw").withColumns({"gone": F.coalesce("gone", F.lit(0)), "kept_text": F.lit(None).cast("string")})
    # Texts that lose a line are put together again from their other lines; the rest stay as they are.
    at = lines.join(gone.select("rid"), "rid", "left_semi").select("rid", "i", "raw")
    left = at.join(struck.select("rid", "i"), ["rid", "i"], "left_anti").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("i", "raw"))).alias("left"))
    out = out.join(left, "rid", "left")
    text = F.when(F.col("gone").isNull(), F.array_join("raw", "\n")).otherwise(F.coalesce(F.array_join("left.raw", "\n"), F.lit("")))
    return out.withColumns({"kept_text": text, "gone": F.coalesce("gone", F.lit(0))}).drop("rid", "raw", "left")


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), max_docs: int = MAX_DOCS, least_kept: float = LEAST_KEPT, broadcast_lines: int = BROADCAST_LINES, texts: bool = False, long_lines: int = LONG_LINES) -> DataFrame:
    """base_rules' counts with n_kept_words and kept, for each document (and kept_text, with `texts`).

    docs: text, source and the columns of `carry`; others are ignored, whatever their names. A null text has no word
    and fails the base rules; a null source is a host of its own; each row is judged, also one that repeats another; an
    empty table gives an empty result. Very long texts, of many lines or of one long word, cost time in proportion (and
    the sorting of their windows). A line in exactly max_docs documents stays, and a document that keeps exactly
    least_kept of its words does. Lines are counted over all documents, those with the same lines (but for blank ones) in
    the same order once.
    """
    own = [f"_{i}" for i in range(len(carry))]
    d = docs.select(*[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)], "text", "source")
    often = materialise(frequent_lines(d, max_docs), "quality-often")
    few = often.count() <= broadcast_lines
    is_long = F.size(F.split(F.coalesce("text", F.lit("")), "\n")) > (long_lines if few else -1)
    out = _as_rows(base_rules(d.where(is_long), tuple(own)), often, few, texts)
    if few:
        out = _in_place(base_rules(d.where(~is_long), tuple(own)), often).unionByName(out)
    out = out.withColumn("n_kept_words", F.col("n_words") - F.col("gone").cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_kept_words") >= least_kept * F.col("n_words"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words"]
    return out.select(*[F.col(o).alias(c) for c, o in zip(carry, own, strict=True)], *measures, kept.alias("kept"), *(["kept_text"] if texts else []))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '~null') AS host, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
win AS (SELECT rid, pos, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM word WINDOW o AS (PARTITION BY rid ORDER BY pos)),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT pos + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
line AS (SELECT rid, host, unnest(raw) AS x, generate_subscripts(raw, 1) AS pos FROM d),
norm AS (SELECT rid, host, pos, x, nullif(trim(lower(x), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') AS k,
                len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS nw FROM line),
copy AS (SELECT rid, md5(coalesce(string_agg(k, chr(10) ORDER BY pos), '')) AS copy FROM norm GROUP BY rid),
often AS (SELECT host, k FROM norm JOIN copy USING (rid) WHERE k IS NOT NULL GROUP BY host, k HAVING count(DISTINCT copy) > 20),
left_words AS (SELECT rid, sum(CASE WHEN often.k IS NULL THEN nw ELSE 0 END) AS n FROM norm LEFT JOIN often ON norm.host = often.host AND norm.k = often.k GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM norm WHERE nw > 0 GROUP BY rid),
m AS (SELECT rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
       coalesce(cover.n, 0)::BIGINT AS n_repeat_words, n_words < 50 OR 100 * coalesce(cover.n, 0) > 50 * n_words AS base_failed, left_words.n::BIGINT AS n_kept_words,
       NOT (n_words < 50 OR 100 * coalesce(cover.n, 0) > 50 * n_words) AND left_words.n >= 0.5 * n_words AS kept
FROM m LEFT JOIN dup USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN left_words USING (rid)
"""
