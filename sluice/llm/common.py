"""Tables, the shared folder, and Arrow helpers that the operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGE_TEXT = 1 << 22
#: Bytes of a record batch between the JVM and Python; Spark's own 64 MB stand in both at once, for each task.
LOT_BYTES = 1 << 22
#: Spark removes the shuffle files of a query as it ends.
SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_lots(spark: SparkSession) -> None:
    """Rows reach Python in record batches of some megabytes (a longer row stands alone)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(LOT_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_lots(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, what: str, by: list[str] | None = None, spent: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so that a lost executor costs no recomputation. With `spent`, the shuffle files of this
    write go as it ends: nothing else may count on them."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(SPENT, "false")
    spark.conf.set(SPENT, str(spent or before == "true").lower())
    try:
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        spark.conf.set(SPENT, before)
    return spark.read.schema(df.schema).parquet(path)


def given_up(df: DataFrame) -> None:
    """Delete the folder of a table made by `written` that nothing reads any more. Other tables stay."""
    spark, files = df.sparkSession, df.inputFiles()
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    base = path(shared_dir(spark)).toUri().getPath().rstrip("/") + "/"
    for name in files[:1]:
        at = path(name)
        while at is not None and at.getParent() is not None and at.getParent().toUri().getPath().rstrip("/") + "/" != base:
            at = at.getParent()
        if at is not None and at.getParent() is not None:
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table, to be broadcast if it has at most `most` (narrow) rows; beyond, Spark joins it as any other."""
    return F.broadcast(df) if df.count() <= most else df


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go when the driver collects its garbage; after a large shuffle, now."""
    spark._jvm.System.gc()


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long and the named string columns; missing ids stay null, other columns are left behind."""
    small_lots(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in columns])


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], most: int = LARGE_TEXT, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = size = 0
        for i, n in enumerate(sizes):
            if i > begin and size + n > most:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        yield batch.slice(begin)
    give_back()


def give_back() -> None:
    """A worker lives on after its task: memory that its allocators hold but nothing uses goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
