"""Document fingerprints: bottom-k sketches of shingle hashes, mergeable, that estimate resemblance, containment and
the number of distinct shingles.

With k = 128 a resemblance r has a standard error of about sqrt(r * (1 - r) / 128), 0.044 at most.

A shingle is `words` consecutive words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer words is one shingle; a text
without words has none. A fingerprint is the base64 of the k least 48-bit hashes in ascending order.

Defined cases: null text is empty; two empty fingerprints resemble each other fully, an empty and another not at all;
documents go by doc_id (null first), rows that share one by text hash; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import kernel
from sluice.llm.common import LARGE_TEXT, chunks, keyed

K, WORDS = 128, 5
RANGE = float(1 << 48)
NO_ID = -(1 << 63)


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k least distinct shingle hashes (48 bits) of each text, ascending."""
    return [np.unique(u[: k + 8] >> np.uint64(16))[:k] for u in kernel.shingles(texts, words)]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: counted below k, estimated from the k-th least hash otherwise."""
    return float(len(a)) if len(a) < k else (k - 1) * RANGE / float(a[-1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's sketch that lies in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    shared = np.append(twice, False)[first][:k]  # of each distinct hash, whether it comes twice
    return float(shared.sum()) / len(shared)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(s) for s in sketches(texts, k, words)])], ["doc_id", "fingerprint"])

    return keyed(docs, "text").mapInArrow(run, "doc_id long, fingerprint string")


def merged(prints: DataFrame, by: list[str], k: int = K, salts: int = 64) -> DataFrame:
    """One fingerprint for each group: the sketch of all its documents' shingles together. Groups are cut by salt
    first, so that the last step has at most salts x k rows of a group."""
    parts = F.pandas_udf(lambda s: s.map(lambda f: [int(x) for x in decode(f or "")]), "array<long>")
    rows = prints.withColumn("salt_", F.pmod(F.xxhash64("fingerprint"), F.lit(salts))).select(*by, "salt_", F.explode(parts("fingerprint")).alias("hash_"))
    for keys in ([*by, "salt_"], by):
        w = Window.partitionBy(*keys).orderBy("hash_")
        rows = rows.select(*keys, "hash_").distinct().withColumn("place_", F.row_number().over(w)).filter(F.col("place_") <= k).drop("place_")
    joined = F.pandas_udf(lambda s: s.map(lambda x: encode(np.array(sorted(x), np.uint64))), "string")
    return rows.groupBy(*by).agg(F.collect_list("hash_").alias("hash_")).select(*by, joined("hash_").alias("fingerprint"))


def _packed(texts: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(3).compress
        return s.map(lambda t: pack((t or "").encode()))

    return run(texts)


def against_next(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (its last half replaced from the next document)
    and of the next document.

    Documents go to ranges of doc_id (of text hash, within an id that fills several ranges), one partition for each, sorted and
    streamed; the least document of a range goes to the range before it as well (the first to the last), so one shuffle brings every
    document beside its next.
    """
    spark = docs.sparkSession
    rows = keyed(docs, "text").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.sort(np.array(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts), np.int64))

    @F.pandas_udf("long")
    def part(ids: pd.Series, ties: pd.Series) -> pd.Series:
        """Ids equal to m > 1 cuts fill m ranges, by text hash."""
        low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
        share = np.minimum((ties.to_numpy() + float(1 << 63)) / float(1 << 64), 1 - 1e-9)
        return pd.Series(np.where(high > low + 1, low + 1 + np.floor(share * (high - low)).astype(np.int64), high))

    # One row for each range: its least document, for the range before it.
    least = sorted((*r["least"], r["part"]) for r in rows.groupBy(part("id", "tie").alias("part")).agg(F.min(F.struct("id", "tie")).alias("least")).collect())
    heads = spark.createDataFrame([(i, t, least[j - 1][2]) for j, (i, t, _) in enumerate(least)], "head long, head_tie long, before long")
    placed = rows.select("id", "tie", "doc_id", part("id", "tie").alias("part"), _packed(F.col("text")).alias("packed"))
    own = placed.join(F.broadcast(heads), (F.col("id") == F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    once = F.array(F.struct("part", F.lit(0).alias("extra")))
    copies = own.select("id", "tie", "doc_id", "packed", F.explode(F.when(F.col("head").isNull(), once).otherwise(F.concat(once, F.array(F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))))).alias("to"))
    laid = copies.select("to.part", "to.extra", "id", "doc_id", "packed", "tie").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "extra", "id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int | None, str]] = []  # consecutive documents of a range
        size, part, done = 0, None, False

        def flush(closed: bool) -> Iterator[pa.RecordBatch]:
            """Rows of all held documents that have a next one; the last stays, unless its range is over."""
            if len(held) > 1:
                texts = [t for _, t in held]
                prints = sketches([t.encode() for t in texts], k, words)
                edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts[:-1], texts[1:], strict=True)]
                raw = [t.encode() for t in edited]
                new = sketches(raw, k, words)
                columns = [
                    pa.array([d for d, _ in held[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                    pa.array([encode(s) for s in prints[:-1]]), pa.array([encode(s) for s in new]),
                    pa.array([resemblance(a, b, k) for a, b in zip(prints[:-1], new, strict=True)]), pa.array([resemblance(a, b, k) for a, b in zip(prints[:-1], prints[1:], strict=True)]),
                    pa.array([containment(a, b, k) for a, b in zip(prints[:-1], new, strict=True)]), pa.array([distinct(a, k) for a in prints[:-1]]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_edited", "n_shingles"])
            del held[: len(held) if closed else -1]

        for batch in batches:
            for p, extra, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "packed")), strict=True):
                if p != part:
                    yield from flush(closed=True)
                    part, size, done = p, 0, False
                if done:  # the range before needs only one row of the next
                    continue
                done = bool(extra)
                text = unpack(packed).decode()
                held.append((doc, text))
                size += len(text)
                if size > LARGE_TEXT // 2:
                    yield from flush(closed=False)
                    size = 0
        yield from flush(closed=True)

    return laid.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_edited double, n_shingles double")
