"""Toxicity: multiple-instance learning. Sentence scores are combined by noisy-or, trained from labels of whole
documents, and then point at the offending sentences.

A sentence's score is the logistic of a bias and the weights of its words; a word's weight is the sum of the weights
of its features, the word itself and its beginnings. score(document) = 1 - prod(1 - excess(sentence)), the excess being
what a sentence's score has above that of the bias alone: sentences without evidence say nothing, however many. Weak evidence adds up
with the number of sentences, so of the sum of -log(1 - excess) what clean sentences give by chance (mean and spread in the clean
documents of the sample) is taken off; the worst sentence counts whole in any case. Texts are read
whole. Labels train on a bounded sample of `sample` labelled documents, the least by hash of doc_id; of each, sentences alike in
their evidence come to the driver once, with their number.

Defined cases: null or empty text is one sentence without words; labels that are null are ignored, of repeated ones the
largest counts; without labels every document's score is 0 and every sentence's that of the bias alone; repeated rows are
scored one by one; other columns are kept by `reject` and ignored elsewhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import chunks, keyed, written

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")
BUCKETS, SLICES = 1 << 20, 64
PREFIXES = range(4, 9)


#: Words whose features or weights a Python worker keeps; then it begins anew.
KEPT_WORDS = 60_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word, distinct: itself, and its beginnings of four to eight letters."""
    return tuple({zlib.crc32(b"w" + word.encode()) % BUCKETS} | {zlib.crc32(b"p" + word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n})


@dataclass
class Model:
    """Weights of the selected feature buckets, the bias of a sentence, and mean and spread of a clean sentence's evidence."""

    weights: dict[int, float]
    bias: float
    mean: float = 0.0
    spread: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def sentences(self, text: str | None) -> np.ndarray:
        """Score of each sentence, those of no words included."""
        tokens = TOKEN.findall((text or "").lower())
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = np.nan if t in STOPS else self.word(t)
        values = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
        stops = np.isnan(values)
        values[stops] = 0
        total = np.bincount(np.cumsum(stops), weights=values, minlength=int(stops.sum()) + 1) if len(tokens) else np.zeros(1)
        used = np.bincount(np.cumsum(stops), weights=~stops, minlength=len(total)) > 0 if len(tokens) else np.zeros(1, bool)
        used[0] |= not used.any()
        return 1 / (1 + np.exp(-np.clip(total[used] + self.bias, -30, 30)))

    def combined(self, sentences: np.ndarray) -> float:
        """Score of a document from those of its sentences."""
        evidence, n = self.evidence(sentences), len(sentences)
        beyond = evidence.sum() - n * self.mean - 3 * self.spread * np.sqrt(n)
        return float(-np.expm1(-max(evidence.max(), beyond)))

    def evidence(self, sentences: np.ndarray) -> np.ndarray:
        """-log(1 - excess) of each sentence; noisy-or adds them up."""
        alone = 1 / (1 + np.exp(-np.clip(self.bias, -30, 30)))
        return -np.log1p(-np.minimum(np.maximum(sentences - alone, 0) / (1 - alone), 1 - 1e-12))

    def score(self, text: str | None) -> float:
        return self.combined(self.sentences(text))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-p).sum()))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _selected(sample: DataFrame, n_features: int, least: int) -> list[int]:
    """The feature buckets whose document counts differ most between the labels (likelihood ratio)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes, known = np.zeros((2, BUCKETS), np.int32), [0, 0], {}
        for batch in chunks(batches):
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found: set[int] = set()
                for word in set(TOKEN.findall((text or "").lower())) - STOPS:
                    if word not in known:
                        if len(known) > KEPT_WORDS:
                            known.clear()
                        known[word] = word_features(word)
                    found.update(known[word])
                counts[y, list(found)] += 1
                sizes[y] += 1
        width = BUCKETS // SLICES
        rows = [(i, zlib.compress(counts[:, i * width : (i + 1) * width].tobytes(), 1), *sizes) for i in range(SLICES)] if sum(sizes) else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["slice", "counts", "n0", "n1"])

    def chosen(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS // SLICES
        counts, n = np.zeros((2, width), np.int64), np.zeros(2)
        for batch in batches:
            for raw, n0, n1 in zip(*(batch.column(c).to_pylist() for c in ("counts", "n0", "n1")), strict=True):
                counts += np.frombuffer(zlib.decompress(raw), np.int32).reshape(2, width)
                n += (n0, n1)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = counts.sum(axis=0)
            gain = sum(np.nan_to_num(c * np.log(c / (total * n[y] / n.sum()))) + np.nan_to_num((n[y] - c) * np.log((n[y] - c) / ((n.sum() - total) * n[y] / n.sum()))) for y, c in enumerate(counts))
        gain[total < least] = 0
        top = np.argsort(-gain, kind="stable")[:n_features]
        top = top[gain[top] > 3]
        yield pa.RecordBatch.from_arrays([pa.array(top + key[0].as_py() * width, pa.int64()), pa.array(gain[top])], ["feature", "gain"])

    found = sample.mapInArrow(counted, "slice int, counts binary, n0 long, n1 long").groupBy("slice").applyInArrow(chosen, "feature long, gain double")
    return [r[0] for r in found.orderBy(F.desc("gain"), "feature").limit(n_features).collect()]


def _bags(sample: DataFrame, features: list[int]):
    """For each sampled document: label, number of sentences, and its distinct bags of selected features (those of each bag one after the other, as 16-bit
    places, with the bags' sizes) with the number of sentences that have each."""
    place = {f: i for i, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in chunks(batches):
            rows = []
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, bag, seen, any_word = 0, [], {}, False
                for t in [*TOKEN.findall((text or "").lower()), "."]:
                    if t in STOPS:
                        n += any_word
                        if bag:
                            key = tuple(sorted(bag))
                            seen[key] = seen.get(key, 0) + 1
                        bag, any_word = [], False
                        continue
                    any_word = True
                    if t not in known:
                        if len(known) > KEPT_WORDS:
                            known.clear()
                        known[t] = tuple(place[f] for f in word_features(t) if f in place)
                    bag += known[t]
                rows.append((y, max(n, 1), [f for b in seen for f in b], [len(b) for b in seen], list(seen.values())))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["toxic", "n", "feature", "size", "times"])

    return sample.mapInArrow(run, "toxic int, n long, feature array<short>, size array<int>, times array<int>").toArrow()


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, n_features: int = 2048, rounds: int = 150, ridge: float = 3e-5) -> Model:
    """Fit on at most `sample` labelled documents; sentences without a selected feature share one term a document."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    told = told.filter(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample's bound is the bound of the broadcast.
    rows = written(keyed(docs, "text").join(F.broadcast(told), "doc_id").select("toxic", "text"), "labelled")
    features = _selected(rows, min(n_features, 1 << 15), least=3)
    bags = _bags(rows, features)
    if not bags.num_rows:
        return Model({}, -3.0)
    y, n = bags.column("toxic").to_numpy(), bags.column("n").to_numpy()
    flat = lambda c: bags.column(c).combine_chunks().flatten().to_numpy()
    of = np.repeat(np.arange(len(y)), [len(x) for x in bags.column("size")])  # the document of each bag
    at, what, times = np.repeat(np.arange(len(of)), flat("size")), flat("feature").astype(np.int64), flat("times").astype(float)
    rest = n - np.bincount(of, weights=times, minlength=len(y))  # sentences of the bias alone
    w, b = np.zeros(len(features)), float(np.log(max(y.mean(), 1e-3) / max(n.mean(), 1)))
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(at, weights=w[what], minlength=len(of)) + b
        none = np.bincount(of, weights=times * np.logaddexp(0, z), minlength=len(y)) + rest * np.logaddexp(0, b)  # -log of no toxic sentence
        pull = np.where(y > 0, -1 / np.expm1(np.clip(none, 1e-9, 500)), 1.0) / len(y)
        dz = pull[of] * times / (1 + np.exp(-z))
        g = np.append(np.bincount(what, weights=dz[at], minlength=len(features)) + 2 * ridge * w, dz.sum() + (pull * rest).sum() / (1 + np.exp(-b)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    model = Model({f: float(x) for f, x in zip(features, w, strict=True) if abs(x) > 1e-6}, float(b))
    clean, sentences = y[of] == 0, n[y == 0].sum()
    if clean.any():  # evidence of a clean document's sentences by chance; those without a selected feature have none
        z = np.bincount(at, weights=w[what], minlength=len(of)) + b
        found = model.evidence(1 / (1 + np.exp(-np.clip(z[clean], -30, 30))))
        model.mean = float((found * times[clean]).sum() / sentences)
        model.spread = float(np.sqrt(max((found**2 * times[clean]).sum() / sentences - model.mean**2, 0)))
    return model


def scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_sentence (its place) and worst_score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            each = [model.sentences(t) for t in batch.column("text").to_pylist()]
            total = [model.combined(p) for p in each]
            columns = [
                batch.column("doc_id"), batch.column("held_out"), pa.array(total), pa.array([int(s >= threshold) for s in total], pa.int32()),
                pa.array([len(p) for p in each], pa.int32()), pa.array([int(p.argmax()) for p in each], pa.int32()), pa.array([float(p.max()) for p in each]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_sentence", "worst_score"])

    rows = keyed(docs, "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_sentences int, worst_sentence int, worst_score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def offending(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, stop (code points) and score of each sentence at or over the threshold. Null and empty texts have none; repeated
    rows are read one by one."""

    def spans(text: str) -> list[dict]:
        out, begin = [], 0
        for end in [m.end() for m in re.finditer(r"[.!?\n]+", text)] + [len(text)]:
            if end > begin and (p := model.score(text[begin:end])) >= threshold:
                out.append({"start": begin, "stop": end, "score": p})
            begin = end
        return out

    found = F.pandas_udf(lambda s: s.map(spans), "array<struct<start:int,stop:int,score:double>>")
    return keyed(docs, "text").select("doc_id", F.explode(found(F.coalesce("text", F.lit("")))).alias("s")).select("doc_id", "s.*")
