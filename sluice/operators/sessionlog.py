"""A log of session events in numbered commits, laid out by hash of the session.

Events are written as Parquet files by bucket of the session's hash, with a Bloom filter on session_id, in a folder of their own; a commit file
that holds the folder's name, and whose own is the next version, makes them part of the log. It is created only if it is not there yet, so of two writers that began
from the same version one is refused and may read again and retry. What no commit names is no part of the log, so a write that failed leaves nothing behind that is read.
Readers of one session open the files of its bucket alone.

Columns: those of `sessions` events; session_id is a string. Defined cases: events with a null session_id are of bucket 0; a log without commits is empty.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import sessions

SCHEMA = "session_id string, seq long, kind string, snapshot_id string, action_id string, plan string, success boolean"
BUCKETS = 64


class StaleVersion(RuntimeError):
    """Another writer has committed since the version that a commit was based on."""


def bucket_of(session: Column, buckets: int = BUCKETS) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(session), F.lit(buckets)), F.lit(0)).cast("int")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Version and folder of each commit, in order. One whose file is still empty is not there yet (or never will be: its writer died), and has no folder."""
    fs, at = _fs(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    found = []
    for f in fs.listStatus(at):
        if f.getPath().getName().isdigit():
            stream = fs.open(f.getPath())
            found.append((int(f.getPath().getName()), spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return sorted(found)


def version(spark: SparkSession, path: str) -> int:
    """The number of the last commit; 0 of an empty log."""
    return max((v for v, _ in commits(spark, path)), default=0)


def commit(events: DataFrame, path: str, based_on: int, buckets: int = BUCKETS) -> int:
    """Write events and make them the version after `based_on`, which is returned; StaleVersion if that is there already."""
    spark, folder = events.sparkSession, uuid.uuid4().hex
    rows = events.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in SCHEMA.split(", "))]).withColumn("bucket", bucket_of(F.col("session_id"), buckets))
    # One task writes a bucket unless it is large; within a file sessions lie together.
    laid = rows.repartition("bucket", F.pmod(F.xxhash64("session_id", "seq"), F.lit(4))).sortWithinPartitions("bucket", "session_id", "seq")
    laid.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#session_id", "true").parquet(f"{path}/data/{folder}")
    fs, at = _fs(spark, f"{path}/commits")
    fs.mkdirs(at)
    try:
        if version(spark, path) != based_on:
            raise StaleVersion(f"the log is at version {version(spark, path)}, not {based_on}")
        try:
            out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{based_on + 1:012}"), False)  # not over another
        except Py4JJavaError as e:
            raise StaleVersion(f"version {based_on + 1} is another writer's") from e
    except StaleVersion:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{folder}"), True)
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    return based_on + 1


def _read(spark: SparkSession):
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true")


def folders(spark: SparkSession, path: str, bucket: int | None = None, as_of: int | None = None) -> list[str]:
    """The folders that a reader opens: of all buckets, or those of one, up to a version."""
    kept = [f"{path}/data/{f}" for v, f in commits(spark, path) if f and (as_of is None or v <= as_of)]
    if bucket is None:
        return kept
    own = [f"{f}/bucket={bucket}" for f in kept]
    return [f for f in own if _fs(spark, f)[0].exists(_fs(spark, f)[1])]


def events(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """All events of the log, up to a version."""
    found = folders(spark, path, as_of=as_of)
    return _read(spark).parquet(*found) if found else spark.createDataFrame([], SCHEMA)


def session_events(spark: SparkSession, path: str, session_id: str, as_of: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The events of one session: files of other buckets are not opened, and of its own those whose Bloom filter rules it out are passed over."""
    bucket = spark.range(1).select(bucket_of(F.lit(session_id), buckets)).first()[0]
    found = folders(spark, path, bucket, as_of)
    rows = _read(spark).parquet(*found) if found else spark.createDataFrame([], SCHEMA)
    return rows.filter(F.col("session_id") == session_id)


def lookup(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """session_id, state and pending_action_id after the session's last event; no row if it is unknown."""
    return sessions.lookup(session_events(spark, path, session_id), session_id)


def create(starts: DataFrame, path: str, based_on: int, buckets: int = BUCKETS) -> tuple[int, DataFrame]:
    """Commit the START events of sessions that the log does not know (of several of one session, that of the least seq); the version, and the refused events.
    Only the buckets of the new sessions are read. A writer in between is a StaleVersion, so no session is ever made twice."""
    spark = starts.sparkSession
    asked = starts.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in SCHEMA.split(", "))]).filter("kind = 'START' and session_id is not null")
    touched = sorted(r[0] for r in asked.select(bucket_of(F.col("session_id"), buckets).alias("b")).distinct().collect())  # at most `buckets`
    found = [f for b in touched for f in folders(spark, path, b, based_on)]
    known = _read(spark).parquet(*found) if found else spark.createDataFrame([], SCHEMA)
    first = asked.groupBy("session_id").agg(F.min(F.struct(*[c for c in asked.columns if c != "session_id"])).alias("e")).select("session_id", "e.*")
    new = first.join(known.select("session_id").distinct(), "session_id", "left_anti").select(*asked.columns)
    after = commit(new, path, based_on, buckets)
    taken = _read(spark).parquet(folders(spark, path, as_of=after)[-1]).select("session_id", "seq").distinct()
    return after, asked.join(taken, ["session_id", "seq"], "left_anti").select(*asked.columns)
