"""Documents staged as batches of some megabytes, and compressed arrays that batches and hash buckets exchange.

An operator that looks up something for every word or byte sends arrays, not rows: each batch cuts its sorted hashes
into buckets by their leading bits, a bucket answers with an array in the same order, and the answers meet the staged
batch again. Spark partitions and shuffles both ways; a bucket or a batch is the largest thing a task holds.

Defined cases: null texts are empty, null ids the least number; an empty table has no batch; a text longer than a batch is one by itself.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel
from sluice.llm.common import keyed, utf8, written

NO_ID = -(1 << 63)
BATCH_BYTES = 1 << 22
LEAST_LOT = 1 << 16
#: Bytes of arrays up to which they are compressed in one piece.
SMALL_LOT = 1 << 14
STAGED = "batch long, ids binary, sizes binary, bytes long, blob binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, bytes of equal weight side by side and each weight compressed by itself."""
    pack = zstandard.ZstdCompressor(1).compress
    planes = [(a.dtype.str, [pack(p.tobytes()) for p in np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T]) for a in arrays]
    return pickle.dumps(planes, protocol=5)


def packed(*arrays: np.ndarray) -> bytes:
    """As `squeeze`, but small lots are compressed in one piece, which takes less time and room where pieces would be a few bytes."""
    if sum(a.nbytes for a in arrays) > SMALL_LOT:
        return squeeze(*arrays)
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return pickle.dumps({"kinds": [(a.dtype.str, len(a)) for a in arrays], "planes": zstandard.ZstdCompressor(1).compress(planes)}, protocol=5)


def joined(*packed: bytes) -> bytes:
    """Several squeezed lots as one."""
    return pickle.dumps(packed, protocol=5)


def unsqueeze(packed: bytes) -> list[np.ndarray]:
    found = pickle.loads(packed)
    if isinstance(found, tuple):
        return [a for lot in found for a in unsqueeze(lot)]
    unpack = zstandard.ZstdDecompressor().decompress
    if isinstance(found, dict):
        planes, out, at = np.frombuffer(unpack(found["planes"]), np.uint8), [], 0
        for kind, n in found["kinds"]:
            weight = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(planes[at : at + n * weight].reshape(weight, n).T).view(kind).ravel())
            at += n * weight
        return out
    return [np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes], axis=1).view(kind).ravel() for kind, planes in found]


def deltas(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def undeltas(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


def cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of equal hash range begins (with the end as last)."""
    return np.append(np.searchsorted(sorted_hashes, kernel.even_bounds(buckets)), len(sorted_hashes))


def cut(docs: DataFrame, batch_bytes: int = BATCH_BYTES, level: int = 9) -> DataFrame:
    """The documents as batches of about `batch_bytes` bytes, compressed to `level`. Null texts are empty, null ids the least number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level).compress
        ids: list[int] = []
        texts: list[bytes] = []

        def packed() -> pa.RecordBatch:
            blob = b"".join(texts)
            # The name holds the content: if a lost executor's input comes back in another order, a batch meets no answers of another.
            row = (xxhash.xxh64_intdigest(blob, seed=at) >> 1, squeeze(np.array(ids, np.int64)), squeeze(np.array([len(t) for t in texts], np.uint32)), len(blob), pack(blob))
            ids.clear(), texts.clear()
            return as_batch([row], ["batch", "ids", "sizes", "bytes", "blob"], [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()])

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").fill_null(NO_ID).to_pylist(), utf8(batch.column("text")), strict=True):
                if texts and held + len(text) > batch_bytes:
                    yield packed()
                    at, held = at + 1, 0
                ids.append(doc), texts.append(text)
                held += len(text)
        if texts:
            yield packed()

    return keyed(docs, "text").mapInArrow(run, STAGED)


def stage(docs: DataFrame, what: str, batch_bytes: int = BATCH_BYTES, level: int = 9) -> tuple[DataFrame, int]:
    """The batches, written to the shared folder, and their bytes in all."""
    staged = written(cut(docs, batch_bytes, level), what)
    return staged, staged.agg(F.coalesce(F.sum("bytes"), F.lit(0))).collect()[0][0]


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).collect()[0][0]


def lot(total: int, at_one_gb: int, most: int) -> int:
    """Bytes of a batch or a bucket. They grow with the root of the input, so that the rows that batches and buckets exchange grow as the input does, up to
    `most`, which a task can hold; small inputs are cut small, so that every task has its share."""
    return max(LEAST_LOT, min(most, int(at_one_gb * math.sqrt(total / 1e9))))


def bucket_count(total: int, each: int) -> int:
    return max(8, -(-total // each))


def load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes with a line feed after each document, and where each document begins (with the end as last)."""
    (ids,), (sizes,) = unsqueeze(row["ids"]), unsqueeze(row["sizes"])
    blob = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["bytes"])) if row["bytes"] else b""
    ends = np.cumsum(sizes.astype(np.int64))
    return (ids, *kernel.joined([blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]))


def rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    names = table.schema.names
    for values in zip(*(table.column(c).to_pylist() for c in names), strict=True):
        yield dict(zip(names, values, strict=True))


def as_batch(values: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*values, strict=True)) if values else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
