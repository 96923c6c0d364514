"""Sharding: documents in order of a Hilbert curve over metadata dimensions, cut into runs of equal count.

Size, language and source of a document are quantised to `bits` bits each and give its place on the curve: size by its
logarithm between the least and the largest, language and source by their rank among all distinct values, so that near cells hold near values and the least
and largest value of a file say something. Rows go by curve index, then by text hash and doc_id, so that copies of a text, which take the least language and source of their
group, stay neighbours. Run i of n holds the places p with floor(p * shards / n) = i: counts differ by one at most.

Defined cases: a null text has size 16 and crc32 of the empty text; null language, source or doc_id come first in
their dimension; repeated rows and rows without an id get a slot each; an empty table gives no rows; `shards` ignores other
columns, `write_shards` writes every column of every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sluice.llm.common import written


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of an (n, dimensions) array of unsigned integers below 2^bits
    (Skilling's transposition, 2004)."""
    x = points.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _indexed(bits: int, place: int):
    """The column `curve` at the given place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("d0", "d1", "d2")], axis=1) if batch.num_rows else np.zeros((0, 3), np.int64)
            batch = batch.drop_columns(["d0", "d1", "d2"])
            yield batch.add_column(place, "curve", pa.array(hilbert_index(points, bits), pa.int64()))

    return run


def _ordered(df: DataFrame, order: list[str], what: str) -> tuple[DataFrame, int]:
    """The rows, written in this order, with their `rank`; and their number. One number for each partition comes to the driver."""
    # monotonically_increasing_id: the partition above bit 33, below it the place in the sorted partition.
    done = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), what)
    counts = done.groupBy(F.shiftright("at_", 33).alias("of_")).count().orderBy("of_").collect()
    begin, offsets = 0, []
    for r in counts:
        offsets.append((r["of_"], begin))
        begin += r["count"]
    offset = df.sparkSession.createDataFrame(offsets, "of_ long, begin_ long")
    rank = F.col("begin_") + F.col("at_").bitwiseAND((1 << 33) - 1)
    return done.join(F.broadcast(offset), F.shiftright("at_", 33) == F.col("of_")).withColumn("rank", rank).drop("at_", "of_", "begin_"), begin


def _quantised(rows: DataFrame, column: str, into: str, top: int) -> DataFrame:
    """Adds the place of a value among all values, 1 to `top` (0: null). The values are written, so that Spark can see
    whether they are few, and can split the join of a value that many rows hold."""
    values, n = _ordered(rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("value_")).distinct(), ["value_"], f"values-{into}")
    place = F.expr(f"rank * {top} div {max(n, 1)}") + 1  # few values lie far apart, as the curve's first turns part the halves
    values = written(values.select("value_", place.cast("long").alias(into)), f"places-{into}")
    return rows.join(values, rows[column] == F.col("value_"), "left").drop("value_").withColumn(into, F.coalesce(into, F.lit(0).cast("long")))


def _placed(docs: DataFrame, n_shards: int, bits: int, whole: bool) -> tuple[DataFrame, int]:
    """The documents by curve with rank and shard, all their columns in `row_` if `whole`; and their number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    top = (1 << bits) - 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("text_hash"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        *([F.struct(*docs.columns).alias("row_")] if whole else []),
    )
    # Copies share the least metadata of their group. The groups are written, so that Spark can split the join of a large one.
    groups = rows.groupBy("text_hash").agg(F.min("lang").alias("group_lang"), F.min("source").alias("group_source"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    rows = rows.join(written(groups, "copies"), "text_hash", "left").withColumn("lang", F.coalesce("group_lang", "lang")).withColumn("source", F.coalesce("group_source", "source"))
    rows = _quantised(_quantised(rows, "lang", "d1", top), "source", "d2", top)
    least, most = docs.agg(F.min(F.octet_length(text)), F.max(F.octet_length(text))).collect()[0]
    low = math.log2((least or 0) + 16)
    step = max(math.log2((most or 0) + 16) - low, 1e-9) / (top + 1)
    size = F.greatest(F.least(F.floor((F.log2(F.col("size")) - low) / step), F.lit(top)), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "size", "text_crc32", "text_hash", *(["row_"] if whole else []), size.alias("d0"), "d1", "d2")
    thin = rows.drop("d0", "d1", "d2").schema
    thin = StructType([*thin.fields[:4], StructField("curve", LongType()), *thin.fields[4:]])
    ranked, n = _ordered(rows.mapInArrow(_indexed(bits, 4), thin), ["curve", "text_hash", "doc_id"], "shards")
    return ranked.withColumn("shard", F.expr(f"rank * {n_shards} div {max(n, 1)}").cast("int")), n


def shards(docs: DataFrame, n_shards: int = 40, bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every document."""
    ranked, n = _placed(docs, n_shards, bits, False)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("rank") - F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, bits: int = 6) -> None:
    """Write the documents, one folder for each shard, rows by curve; Parquet statistics then prune files on every dimension.
    Tasks hold ranges of the curve, so a large shard is written by several."""
    ranked, _ = _placed(docs, n_shards, bits, True)
    ranked.repartitionByRange("rank").sortWithinPartitions("rank").select("row_.*", "shard").write.partitionBy("shard").parquet(path)
