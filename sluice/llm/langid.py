"""Language ID: Bayesian fusion of text likelihoods with the declared markup language, the address suffix and a
smoothed prior of the host.

log P(l | page) = weight * sum over trigrams log P(trigram | l) + log P(declared | l) + log P(suffix | l) + log P(l | host)
up to a constant. Trigram counts come from all labelled documents. The other tables are counted over all other pages by the
language that the text alone gives: a page's own count is left out, so that its text is not heard twice. A host's prior is smoothed
towards that of its parent domain, and so on up to the suffix and all pages:
P(l | node) = (n(l, node) + kappa * P(l | parent)) / (n(node) + kappa), and of the root (n(l) + 1) / (n + languages).

Defined cases: null html has no text and nothing declared; a null or unreadable url has the empty host, whose parent is the root;
without labelled documents the language is null; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import chunks, written

BITS = 15
#: Languages whose trigram tables are broadcast at a time; the pages are passed once for each such block.
BLOCK_LANGUAGES = 256
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.I | re.S)
_DECLARED = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible(html: str | None) -> str:
    """Text of a page without markup."""
    return _HIDDEN.sub(" ", html or "")


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text's UTF-8, white space and digits folded to one blank."""
    raw = np.frombuffer((" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return (((raw[:-2] * 0x9E3779B1) ^ (raw[1:-1] * 0x85EBCA6B) ^ (raw[2:] * 0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)).astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """Languages, and the trigram counts (lang, trigram, n) of every document with text and language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in chunks(batches, 1 << 20):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                counts[lang] = counts.get(lang, 0) + np.bincount(trigrams(" ".join(texts)), minlength=1 << BITS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "trigram", "n"])

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    sums = written(rows.mapInArrow(counted, "lang string, trigram int, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n")), "trigrams")
    return sorted(r["lang"] for r in sums.select("lang").distinct().collect()), sums


def table_of(sums: DataFrame, langs: list[str]) -> np.ndarray:
    """log P(trigram | language) of some languages, with add-one smoothing."""
    table = np.ones((len(langs), 1 << BITS))
    place = {x: i for i, x in enumerate(langs)}
    for r in sums.filter(F.col("lang").isin(langs)).groupBy("lang").agg(F.collect_list(F.struct("trigram", "n")).alias("c")).collect():  # at most 2^BITS entries each
        for t, n in r["c"]:
            table[place[r["lang"]], t] += n
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def nodes(host: str) -> list[str]:
    """A host and the domains above it, the suffix last."""
    parts = host.split(".") if host else []
    return [".".join(parts[i:]) for i in range(len(parts))]


def read_pages(pages: DataFrame, langs: list[str], sums: DataFrame, weight: float) -> DataFrame:
    """page_id, host, suffix, declared, ll (the tempered log likelihood of the text in each language) and best (the place of the largest)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"), F.array().cast("array<double>").alias("ll"))

    def scored(sent, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, column="html"):
                ll, declared = [], []
                for html, before in zip(batch.column("html").to_pylist(), batch.column("ll").to_pylist(), strict=True):
                    own = (weight * sent.value[:, trigrams(visible(html))].sum(axis=1, dtype=np.float64)).round(6).tolist()
                    m = _DECLARED.search(html or "")
                    ll.append(before + own), declared.append(m[1].lower() if m else "")
                cols = [batch.column("page_id"), batch.column("host"), batch.column("html"), pa.array(ll, pa.list_(pa.float64()))]
                if last:
                    cols[2:3] = [pa.array(declared, pa.string())]
                    cols.append(pa.array([int(np.argmax(x)) if x else None for x in ll], pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "declared", "ll", "best"] if last else ["page_id", "host", "html", "ll"])

        return run

    blocks = [langs[i : i + BLOCK_LANGUAGES] for i in range(0, len(langs), BLOCK_LANGUAGES)] or [[]]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        sent = pages.sparkSession.sparkContext.broadcast(table_of(sums, block))  # at most BLOCK_LANGUAGES x 2^BITS floats
        read = written(read.mapInArrow(scored(sent, last), "page_id long, host string, declared string, ll array<double>, best int" if last else "page_id long, host string, html string, ll array<double>"), "pages")
        sent.destroy()
    return read.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))


def identify(pages: DataFrame, docs: DataFrame, kappa: float = 8.0, weight: float = 0.25) -> DataFrame:
    """page_id, host, declared, suffix, text_lang, lang and confidence of every page.

    `weight` tempers the text's likelihood, as neighbouring trigrams are not independent.
    """
    langs, counts = train(docs)
    rows = read_pages(pages, langs, counts, weight)
    if not langs:
        return rows.select("page_id", "host", "declared", "suffix", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    n = len(langs)
    one_hot = [F.sum((F.col("best") == i).cast("long")).cast("double") for i in range(n)]
    of = lambda c: [F.sum(F.col(c)[i]) for i in range(n)]
    less = lambda c: F.transform(c, lambda x, i: x - (i == F.col("best")).cast("double"))

    # Partial sums come before each shuffle, so a host with a third of all pages costs one row a task. Every table of counts is
    # written, so that Spark sees whether it is small, and can split its join on a value that many pages have.
    by_host = written(rows.groupBy("host").agg(F.array(*one_hot).alias("c")), "hosts")
    tree = F.expr(r"filter(transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i)), x -> x != '')")
    # Node j of a host is its last j labels. Its own pages and those below count for it.
    above = by_host.select("host", "c", tree.alias("up"))
    sums = above.select(F.explode("up").alias("node"), "c").groupBy("node").agg(F.array(*of("c")).alias("nc"))
    whole = [float(x or 0) for x in by_host.agg(F.array(*of("c")).alias("c")).collect()[0]["c"]]
    root = F.transform(less(F.array(*[F.lit(x) for x in whole])), lambda x: (x + 1) / F.lit(sum(whole) - 1 + n))
    steps = above.select("host", F.posexplode_outer("up").alias("level", "node")).join(sums, "node", "left").groupBy("host").agg(F.array_compact(F.sort_array(F.collect_list(F.when(F.col("nc").isNotNull(), F.struct("level", "nc"))))).alias("path"))
    # A host has one prior for each language that one of its own pages has by its text: the page's own count is left out.
    own = by_host.select("host", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("c", i) > 0)).alias("best"))
    smooth = lambda p, s: F.transform(less(s["nc"]), lambda x, i: (x + F.lit(kappa) * F.element_at(p, i + 1)) / (F.aggregate(s["nc"], F.lit(0.0), lambda a, y: a + y) - 1 + F.lit(kappa)))
    priors = written(own.join(steps, "host").select("host", "best", F.aggregate("path", root, smooth).alias("prior")), "priors")

    def with_likelihood(df: DataFrame, column: str) -> DataFrame:
        """Adds log P(value | language), with add-one smoothing over the values seen and one more."""
        counts = written(rows.groupBy(column).agg(F.array(*one_hot).alias("c_")), f"counts-{column}")
        sums = counts.agg(F.array(*of("c_")).alias("s"), F.count("*").alias("v")).collect()[0]
        sizes = F.array(*[F.lit(float(x or 0) + sums["v"] + 1) for x in sums["s"] or [0] * n])
        part = F.transform(less(F.col("c_")), lambda x, i: F.log((x + 1) / (F.element_at(sizes, i + 1) - (i == F.col("best")).cast("double"))))
        return df.join(counts, column).withColumn(f"p_{column}", part).drop("c_")

    fused = with_likelihood(with_likelihood(rows.join(priors, ["host", "best"]), "declared"), "suffix")
    logs = F.transform("ll", lambda x, i: x + F.log(F.element_at("prior", i + 1)) + F.element_at("p_declared", i + 1) + F.element_at("p_suffix", i + 1))
    names = F.array(*[F.lit(x) for x in langs])
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    share = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return fused.select(
        "page_id", "host", "declared", "suffix", F.element_at(names, F.col("best") + 1).alias("text_lang"),
        F.element_at(names, F.array_position("logs", F.col("top")).cast("int")).alias("lang"), F.round(share, 6).alias("confidence"),
    )
