"""Line dedup: range-partitioned line hashes, streamed in order of document and position, and keep bitmaps as result.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased. Keys of at least `min_chars`
code points found in at least `min_docs` documents keep their lines only in the largest doc_id that holds them.

Defined cases: null or empty text is one empty line and loses nothing; rows that repeat a doc_id count as one document
when lines are counted, and each row gets its own bitmap (rows alike in doc_id and text lose the same lines); a null doc_id
counts as the smallest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import chunks, keyed, written

BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, None if the key is short."""
    line = line.strip(BLANKS)
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= min_chars else None


def text_hash(docs: DataFrame) -> Column:
    """With its doc_id, what stands for a row: rows that share an id have positions of their own."""
    return F.xxhash64(docs["text"].cast("string"))


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            keys, docs, at, rows = [], [], [], []
            for doc, text, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_hash")), strict=True):
                doc = NO_ID if doc is None else doc
                for i, line in enumerate((text or "").split("\n")):
                    if len(line) >= min_chars and (key := line_key(line, min_chars)):
                        keys.append(key), docs.append(doc), at.append(i), rows.append(row)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(rows, pa.int64())], ["key", "doc", "pos", "text_hash"])

    return run


def _streamed(min_docs: int):
    """Rows come sorted by key, document from the largest, and position. A key's run that touches neither end of the
    partition is decided at once. The first and last runs may go on in a neighbour: their rows go out as pending, with
    a summary of each run: its first document and position, number of documents, and last document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = last_doc = None
        run_no = n_docs = 0
        most = begin = None
        held: list[tuple[int, int, int]] = []  # rows of the run that are not yet decided
        pending = True

        def close(edge: bool) -> None:
            if key is None:
                return
            if edge:
                out.append(("run", key, most, begin, None, n_docs, last_doc))
                out.extend(("pending", key, d, p, h, 0, None) for d, p, h in held)
            elif n_docs >= min_docs:
                out.extend(("drop", None, d, p, h, 0, None) for d, p, h in held)
            held.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["kind", "key", "doc", "pos", "text_hash", "n", "last"])

        for batch in batches:
            for k, d, p, h in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "pos", "text_hash")), strict=True):
                if k != key:
                    close(edge=run_no == 1)
                    key, last_doc, most, begin, n_docs, run_no = k, None, d, p, 0, run_no + 1
                    pending = run_no == 1
                if d != last_doc:
                    n_docs, last_doc = n_docs + 1, d
                if pending:  # the first run keeps every row for a later decision, streamed out as it comes
                    out.append(("pending", k, d, p, h, 0, None))
                elif d != most:
                    held.append((d, p, h))
                    if n_docs >= min_docs:
                        out.extend(("drop", None, x, y, z, 0, None) for x, y, z in held)
                        held.clear()
                if len(out) >= 50_000:
                    yield flush()
        # The last run is an edge too: those of its rows that are not yet dropped wait for the neighbour's summary.
        close(edge=True)
        if out:
            yield flush()

    return run


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_hash, n_dropped and keep_bitmap (zlib of packed bits, first line first) of each row that loses a line."""
    rows = keyed(docs, "text")
    # Written, as a range partitioning reads its input twice: once for the bounds.
    lines = written(rows.withColumn("text_hash", text_hash(rows)).mapInArrow(_lines(min_chars), "key binary, doc long, pos int, text_hash long"), "all-lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.col("doc").desc(), F.col("pos")]
    found = written(
        lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_streamed(min_docs), "kind string, key binary, doc long, pos int, text_hash long, n long, last long"),
        "lines",
    )
    # A partition has at most two edge runs, so there are at most twice as many summaries as partitions.
    # A document whose lines of a key go on in the next run is counted in both: once too often.
    again = F.coalesce(F.lag("last").over(Window.partitionBy("key").orderBy(F.desc("doc"), "pos")) == F.col("doc"), F.lit(False)).cast("long")
    runs = found.filter("kind = 'run'").withColumn("again", again).groupBy("key").agg(F.sum(F.col("n") - F.col("again")).alias("docs"), F.max("doc").alias("most"))
    late = found.filter("kind = 'pending'").join(F.broadcast(runs.filter(F.col("docs") >= min_docs)), "key").filter("doc != most")
    dropped = found.filter("kind = 'drop'").select("doc", "text_hash", "pos").unionByName(late.select("doc", "text_hash", "pos"))
    return (
        dropped.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .mapInArrow(_packed, "doc_id long, text_hash long, n_dropped long, keep_bitmap binary")
    )


def pack(gone: list[int]) -> bytes:
    """Bits from line 0 to the last dropped one, 1: keep; later lines are kept."""
    keep = np.ones((gone[-1] // 8 + 1) * 8, bool)  # whole bytes: later lines read as kept
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether to keep each of n lines."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column("gone").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array([len(g) for g in gone], pa.int64()), pa.array([pack(g) for g in gone], pa.binary())], ["doc_id", "text_hash", "n_dropped", "keep_bitmap"])


def with_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents, every column kept, with the column keep_bitmap_ (null: keep all)."""
    found = line_bitmaps(docs, min_chars, min_docs)
    maps = found.select(F.col("doc_id").alias("bitmap_doc_"), F.col("text_hash").alias("bitmap_text_"), F.col("keep_bitmap").alias("keep_bitmap_")).hint("merge")  # they grow with the documents
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("bitmap_doc_")) & (text_hash(docs) == F.col("bitmap_text_"))
    return docs.join(maps, same, "left").drop("bitmap_doc_", "bitmap_text_")


def applied(text: str | None, bitmap: bytes | None) -> str | None:
    """The text without its dropped lines; null stays null."""
    if text is None or not bitmap:
        return text
    lines = text.split("\n")
    return "\n".join(line for line, keep in zip(lines, unpack(bitmap, len(lines)), strict=True) if keep)


def line_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lines, dropped, sha = [], [], []
            for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap_").to_pylist(), strict=True):
                parts = (text or "").split("\n")
                keep = unpack(bitmap, len(parts))
                lines.append(len(parts))
                dropped.append(len(parts) - int(keep.sum()))
                kept = parts if not dropped[-1] else [p for p, k in zip(parts, keep, strict=True) if k]
                sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(keyed(docs, "text"), min_chars, min_docs).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with repeated lines removed from text; every other column as it was."""
    marked, columns = with_bitmaps(docs, min_chars, min_docs), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            place = batch.schema.get_field_index("text")
            kind = batch.schema.field(place)
            bitmaps = batch.column("keep_bitmap_").to_pylist()
            if any(bitmaps):
                batch = batch.set_column(place, kind, pa.array([applied(t, b) for t, b in zip(batch.column(place).to_pylist(), bitmaps, strict=True)], kind.type))
            yield batch.select(columns)

    return marked.mapInArrow(run, docs.schema)
