"""Filter interaction audit: what each of several filters removes in every order, from one small incidence matrix.

Every document fails some of five filters; these failures are a mask of five bits. Documents are counted once by part
and mask (all, of quality, toxic), which is all that any order of the filters can tell. The three histograms of a part are rows of 32 numbers,
and what a step of an order keeps, removes, finds removed already, and removes alone are columns of 32 by 600 matrices of
zeros and ones (120 orders of five steps): one integer product for each gives the whole audit.

Filters: A, fewer words (`[^\\x20\\x09-\\x0D]+`) than `least_words`; B, distinct words under `distinct_percent` of all;
C, `[A-Z]` over `capital_percent` of the code points; D, holds any of `[#$%&*|]`; E, equal to the text of a smaller doc_id.

Defined cases: null and empty texts are equal, have no words, fail A alone (and E, if not the first); a null lang is the part of the
empty string; rows that share a doc_id are judged one by one, and none is a smaller id than the other; a null doc_id is smaller than none
fails no E and has no label; several labels of a doc_id count once if any says so, null labels say nothing; an empty table has no parts; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import sized, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
_SPACE = " \t\n\x0b\x0c\r"
#: One bit for each filter that a document can fail, A the lowest.
HISTOGRAMS = ("n", "good", "toxic")
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words(text: Column) -> Column:
    """The maximal runs without space characters."""
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def failures(docs: DataFrame, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> DataFrame:
    """doc_id, part, text_key and mask of every row; E is bit 16 and added by `masks`, as it needs the other rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = rows.withColumn("words", words(F.col("text")))
    told = split.select(
        "doc_id", "part", F.struct(F.md5("text").alias("digest"), F.octet_length("text").alias("bytes")).alias("text_key"),
        F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"), F.length("text").alias("chars"), F.col("text").rlike(r"[#$%&*|]").alias("marked"),
    )
    n = lambda name: F.col(name).cast("long")
    bits = [n("n") < least_words, 100 * n("n_distinct") < distinct_percent * n("n"), 100 * n("capitals") > capital_percent * n("chars"), F.col("marked")]
    return told.select("doc_id", "part", "text_key", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)).alias("mask"))


def masks(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, part and mask of every row, all five filters. Texts of which there is one are told apart before any join; the others' least ids
    are written, so that Spark can split the join of a text that very many documents share."""
    rows = written(failures(docs, **limits), "failures")
    first = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    both = rows.join(sized(written(first, "first-texts")), "text_key", "left")
    return both.select("doc_id", "part", F.expr(f"mask + if(doc_id > first, {1 << FILTERS.index('E')}, 0)").alias("mask"))


def histograms(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: documents of each, of them with quality 1 and with toxic 1."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    told = told.filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    sums = [F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")]
    return masked.join(told, "doc_id", "left").groupBy("part", "mask").agg(*sums)


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def outcome_matrices() -> dict[str, np.ndarray]:
    """32 by 600 integers each: whether a mask (row) has the outcome at an order's step (column); for `shapley`, at how many orders the
    column's filter is the first that the mask fails."""
    fails = np.arange(MASKS)[:, None] >> np.arange(len(FILTERS)) & 1  # mask by filter
    order = np.array([[FILTERS.index(x) for x in o] for o in orders()])
    failed = fails[:, order]  # mask, order, step
    before = np.cumsum(failed, axis=2) - failed
    removed = failed * (before == 0)
    credit = np.zeros((MASKS, len(FILTERS)), np.int64)
    for f in range(len(FILTERS)):
        credit[:, f] = (removed * (order == f)).sum(axis=(1, 2))
    found = {
        "kept": (before + failed == 0).astype(np.int64), "removed": removed, "redundant": failed * (before > 0), "unique_fails": failed * (fails.sum(axis=1) == 1)[:, None, None], "shapley": credit[:, order],
    }
    return {k: v.reshape(MASKS, -1).astype(np.int64) for k, v in found.items()}


def audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """One row for each part, order and step."""
    counted = histograms(masks(docs, **limits), labels)
    # A part is one row of 3 x 32 sums from here on, however many documents it has.
    cells = [F.sum(F.when(F.col("mask") == m, F.col(h)).otherwise(0)).alias(f"{h}{m}") for h in HISTOGRAMS for m in range(MASKS)]
    wide = counted.groupBy("part").agg(*cells).select("part", *[F.array(*[f"{h}{m}" for m in range(MASKS)]).alias(h) for h in HISTOGRAMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, names = outcome_matrices(), orders()
        steps = len(names) * len(FILTERS)
        column = {"filter_order": np.repeat(np.array(names, object), len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names))}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                lot = batch.slice(at, 64)
                n, good, toxic = (np.array(lot.column(h).to_pylist(), np.int64).reshape(-1, MASKS) for h in HISTOGRAMS)
                made = {k: n @ m for k, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
                parts = np.repeat(np.array(lot.column("part").to_pylist(), object), steps)
                told = {"part": parts} | {k: np.tile(v, lot.num_rows) for k, v in column.items()} | {k: v.ravel() for k, v in made.items()}
                names_ = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
                yield pa.RecordBatch.from_arrays([pa.array(told[k]) if k not in ("part", "filter_order") else pa.array(told[k], pa.string()) for k in names_], names_)

    return wide.mapInArrow(run, AUDIT)
