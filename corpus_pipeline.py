"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`. Every row is a document of its own, also one that repeats another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import bpe, line_dedup, mixing, quality_rules, simhash
from rastrel.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that more than 20 distinct documents of their source hold.

    Null, empty and blank texts fail the base rules and go; a null source is one source, null ids and other columns stay as
    they are; repeated rows are judged alike; a line in exactly 20 documents stays; texts of any length are read whole; an
    empty table stays empty.
    """
    judged = quality_rules.judge(docs, carry=("doc_id", "lang", "source"), texts=True)
    return judged.where("kept").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that 10 and more share.

    A null or empty text is one empty line and becomes an empty text; a document whose lines all go stays, with an empty
    text; a line in exactly 10 documents goes; repeated rows count as documents; texts and lines of any length are read
    whole; an empty table stays empty.
    """
    kept = line_dedup.drop_lines(line_dedup.build(docs), docs, carry=("doc_id", "lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest id, of rows that share it the least by hash.

    Five words a shingle, and a similarity of 0.8 or more. Rows equal in all columns are one. Null, empty and blank texts
    are alike; texts of under five words have one shingle; a null id comes after all others, and unlike texts without id, or
    with one id, all stay; texts of any length are read whole; an empty table stays empty.
    """
    tie = F.xxhash64(*COLUMNS)
    found = materialise(simhash.near_duplicates(docs.withColumn("tie", tie), carry=("doc_id", "tie"), shingle=5, similarity=0.8), "pipeline-near")
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("s")).select("s.doc_id", "s.tie")
    rows = found.groupBy(F.col("doc_id").alias("id"), F.col("tie").alias("t")).agg(F.count("*").alias("rows"))
    stays = materialise(stays.join(rows, stays["doc_id"].eqNullSafe(rows["id"]) & (stays["tie"] == rows["t"])).select("id", "t", "rows"), "pipeline-stays")
    keyed = docs.select(*COLUMNS, tie.alias("tie"))
    at = lambda s: keyed.join(s, keyed["doc_id"].eqNullSafe(s["id"]) & (keyed["tie"] == s["t"]), "left_semi").select(*COLUMNS)
    out, again = at(stays.where("rows = 1")), stays.where("rows > 1")
    return out.unionByName(at(again).distinct()) if again.limit(1).count() else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken.

    Texts without words (null, empty, blank) are never taken; a null source is one source, the last; rows that repeat are
    taken one by one; a text of any length is taken whole or not; an empty table stays empty.
    """
    return mixing.mixed(docs, carry=COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 of each document of the mix.

    A null or empty text has no tokens; rows that repeat are encoded alike; texts of any length are encoded whole; an empty
    table stays empty.
    """
    return bpe.token_digests(docs, bpe.fit(docs), carry=("doc_id", "source"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]

#: BPE ids aren't for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
