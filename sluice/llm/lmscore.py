"""LM scoring: Stupid-backoff scores from n-gram count tables partitioned by hash, joined to the documents' n-grams and
summed per document.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. An n-gram of two or more words is in the model if it occurs
`least` times or more in the whole corpus. A word's score is the share of its longest n-gram in the model among the occurrences of
the words before it, times `alpha` for each longer n-gram that the document has there and the model lacks; a word alone
scores its share of all words.

Defined cases: null and empty texts have no words and score 0 (per word: null); repeated rows count and are scored each;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import batches as bt
from sluice.llm import kernel
from sluice.llm.common import give_back, given_up, written

ASK = "bucket int, batch long, payload binary"


def batch_grams(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """ids, words of each document, distinct n-gram hashes of all orders, and for each order from 1 on the place of the
    n-gram that begins at each word and whether it lies in one document."""
    ids, buf, starts = bt.load(row)
    hashes, first = kernel.words(buf, starts)
    grams = [kernel.ngrams(hashes, first, n) for n in range(1, order + 1)]
    whole = np.concatenate([g[ok] for g, ok in grams])
    distinct, place = np.unique(whole, return_inverse=True)
    places, at = [], 0
    for g, ok in grams:
        p = np.zeros(len(hashes), np.int64)
        inside = np.zeros(len(hashes), bool)
        inside[: len(ok)] = ok
        p[inside] = place[at : at + int(ok.sum())]
        at += int(ok.sum())
        places.append(p)
    return ids, first, distinct, places, [np.append(ok, np.zeros(len(hashes) - len(ok), bool)) for _, ok in grams]


def scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, least: int = 2, batch_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_backed_off, log_score (natural, summed) and log_score_per_token of every document.

    A batch and a bucket exchange one row: unless given, both sizes grow with the root of the input, up to 6 MB. The batches are written, so that what a
    batch asks and what it scores are the same text even if executors are lost and the input comes back in another order; the answers too, so that what was
    asked needs no disk while documents are scored.
    """
    total = bt.text_bytes(docs)
    batch_bytes, bucket_bytes = batch_bytes or bt.lot(total, 5_000_000, 6 << 20), bucket_bytes or bt.lot(total, 5_000_000, 6 << 20)
    staged, _ = bt.stage(docs, "lmbatches", batch_bytes)
    buckets = bt.bucket_count(total, bucket_bytes)

    def asked(row: dict) -> list[tuple]:
        """For each bucket, the batch's distinct n-grams and how often it has each."""
        _, buf, starts = bt.load(row)
        hashes, first = kernel.words(buf, starts)
        del buf
        distinct, counts = np.unique(np.concatenate([g[ok] for g, ok in (kernel.ngrams(hashes, first, n) for n in range(1, order + 1))]), return_counts=True)
        cut = bt.cuts(distinct, buckets)
        return [(b, row["batch"], bt.squeeze(bt.deltas(distinct[x:y]), counts[x:y].astype(np.uint32))) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]

    def ask(parts):
        for part in parts:
            for row in bt.rows(part):
                yield bt.as_batch(asked(row), ["bucket", "batch", "payload"], [pa.int32(), pa.int64(), pa.binary()])
                give_back()

    def count(key: tuple, asked: pa.Table) -> pa.Table:
        """The bucket's count table, and each batch's share of it in the order asked."""
        each = [bt.unsqueeze(p) for p in asked.column("payload").to_pylist()]
        hashes = [bt.undeltas(h) for h, _ in each]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([c for _, c in each]), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])
        answers = [bt.squeeze(sums[place[e - len(h) : e]]) for h, e in zip(hashes, ends, strict=True)]
        return pa.table({"batch": asked.column("batch"), "bucket": pa.array([key[0].as_py()] * len(answers), pa.int32()), "payload": pa.array(answers, pa.binary())})

    def score(key: tuple, batch: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in bt.rows(batch):
            ids, first, distinct, places, inside = batch_grams(row, order)
            told = sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
            table = np.concatenate([bt.unsqueeze(p)[0] for _, p in told]) if told else np.zeros(0, np.int64)
            n = len(places[0])
            counts = [np.where(ok, table[p] if len(table) else 0, 0) for p, ok in zip(places, inside, strict=True)]
            log, done, backed = np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int64)
            for k in range(order, 0, -1):  # the k-gram that ends at each word begins k - 1 words before
                ends = np.zeros(n, bool)
                num, den = np.zeros(n), np.ones(n)
                if n >= k:
                    ends[k - 1 :] = inside[k - 1][: n - k + 1]
                    num[k - 1 :] = counts[k - 1][: n - k + 1]
                    if k > 1:
                        den[k - 1 :] = np.maximum(counts[k - 2][: n - k + 1], 1)
                use = ends & ~done & ((num >= least) | (k == 1))
                log[use] = np.log(num[use] / den[use]) + backed[use] * np.log(alpha)
                backed[ends & ~done & ~use] += 1
                done |= use
                if k == 1:
                    alone = use
            sizes = np.diff(first)
            of = np.repeat(np.arange(len(ids)), sizes)
            add = lambda x: np.bincount(of, weights=x, minlength=len(ids))  # noqa: E731, B023
            out += list(zip([None if i == bt.NO_ID else i for i in ids.tolist()], sizes.tolist(), add(backed > 0).astype(np.int64).tolist(), add(log).tolist(), add(alone).astype(np.int64).tolist(), strict=True))
        return pa.Table.from_batches([bt.as_batch(out, ["doc_id", "n_tokens", "n_backed_off", "log", "alone"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()])])

    answers = written(staged.mapInArrow(ask, ASK).groupBy("bucket").applyInArrow(count, "batch long, bucket int, payload binary"), "lmanswers", spent=True)
    scored = written(
        staged.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, "doc_id long, n_tokens long, n_backed_off long, log double, alone long"), "lmscores"
    )
    given_up(staged), given_up(answers)
    n = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).collect()[0][0]
    log = F.round(F.col("log") - F.col("alone") * float(np.log(max(n, 1))), 4)
    return scored.select("doc_id", "n_tokens", "n_backed_off", log.alias("log_score"), F.when(F.col("n_tokens") > 0, F.round((F.col("log") - F.col("alone") * float(np.log(max(n, 1)))) / F.col("n_tokens"), 4)).alias("log_score_per_token"))
