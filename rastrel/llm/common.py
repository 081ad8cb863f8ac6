"""What the operators of this package share: tables, the shared folder, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, [\x20\x09-\x0D], as a literal set and as a Java pattern.
WS = " \t\n\x0b\x0c\r"
WS_BYTES = WS.encode()
WS_PATTERN = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a local
    master (tests); a cluster without it is an error, as its executors would write to folders that no other reads."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(told)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rastrel-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rastrel/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in the shared folder, written by the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()


def words(text: Column) -> Column:
    """The runs of characters outside [\\x20\\x09-\\x0D], as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_PATTERN))


def ascii_lower(s: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(s, UPPER, LOWER)


def least_count(counts: DataFrame, n: str, most: int) -> int | None:
    """The least value of n such that no more than `most` rows have it or a larger one; null where not even the largest is that rare."""
    total, least = 0, None
    for r in counts.groupBy(F.col(n).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
        total += r["rows"]
        if total > most:
            break
        least = r["n"]
    return least


#: Rows of an Arrow batch, so that long texts don't pile up in a worker.
BATCH = 1000


def tidy() -> None:
    """Gives back the memory that a worker has freed; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for applyInArrow, by workers that tidy up behind each group."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        tidy()
        return out

    return run


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(f, schema) in short batches, by workers that tidy up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(it)
        tidy()

    return df.mapInArrow(run, schema)
