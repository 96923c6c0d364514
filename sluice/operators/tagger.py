"""A linear-chain tagger for contextual entities, trained on spans that detectors found.

Texts are cut into sentences of at most `MOST_TOKENS` tokens, tokens carry BIO labels, and hashed features of a token and its neighbours have a weight for
each label, pairs of labels one each. The best labels of many sentences are found at once, position by position (Viterbi over a time-major NumPy tensor). Training is the averaged
perceptron with iterative parameter mixing: in each round every partition learns from its own sentences, beginning with the mixed weights,
and the changes are averaged by feature; the weights, of a size that parameters bound, are all that the driver and the tasks share.

Key words that betray a span to a pattern can be hidden (`hide`), so that what is learned is the context and the form of values.

Defined cases: null and empty texts have no sentence; spans that are null, empty, beyond the text or across another are left out; without any span the tagger labels nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TOKENS = 128
TOKEN = re.compile(r"\w+(?:[@.'’_-]+\w+)*|[^\w\s]")
_TOKENS, _RUN, _STOPS = re.compile(f"({TOKEN.pattern})"), re.compile(r"(.)\1{2,}"), frozenset(".!?")
#: Features that depend on one word; characters of texts that are tagged at once.
_ONE = 11
LOT_CHARS = 1 << 20
SPAN = "array<struct<type:string,start:int,stop:int>>"


@dataclass(frozen=True)
class Model:
    """weights: features by labels; steps: label to label; hide: a pattern of words that the features do not see."""

    labels: tuple[str, ...]
    bits: int
    weights: np.ndarray
    steps: np.ndarray
    hide: str | None = None


def _cut(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The tokens of a text, (tokens, 2) their places, and where sentences begin among them, with their number at the end: lines, ends of sentences, and MOST_TOKENS cut."""
    parts = _TOKENS.split(text)  # what lies between tokens, and tokens, in turn
    words, gaps = parts[1::2], parts[:-1:2]
    if not words:
        return [], np.empty((0, 2), np.int64), np.zeros(1, np.int64)
    places = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[:-1].reshape(-1, 2)
    fresh = np.array(["\n" in gap for gap in gaps])
    fresh[1:] |= np.array([w in _STOPS for w in words[:-1]], bool) & (places[1:, 0] > places[:-1, 1])
    fresh[0] = True
    begins = np.flatnonzero(fresh)
    within = np.arange(len(words)) - begins[np.cumsum(fresh) - 1]
    return words, places, np.append(np.flatnonzero(within % MOST_TOKENS == 0), len(words))


def sentences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Places of the tokens of each sentence."""
    _, places, cuts = _cut(text)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield [tuple(x) for x in places[a:b].tolist()]


class _Shapes(dict):
    """Letters to X and x, ASCII digits to 9, for str.translate."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = out = ("X" if ch.isupper() else "x") if ch.isalnum() and not ch.isdecimal() else "9" if ch in "0123456789" else ch
        return out


_SHAPES = _Shapes()


def _shape(word: str) -> str:
    return _RUN.sub(r"\1\1", word.translate(_SHAPES))[:12]


class _Numbers(dict):
    """Numbers of texts, from 0 on, as they come."""

    def __missing__(self, text: str) -> int:
        self[text] = out = len(self)
        return out


class Features:
    """Places of tokens' features among 2**bits weights. What depends on one word is made once for each distinct word and kept for later texts, at most `most` words."""

    def __init__(self, bits: int, hide: re.Pattern | None = None, most: int = 1 << 17):
        self.mask, self.hide, self.most = (1 << bits) - 1, hide, most
        self.clear()

    def clear(self) -> None:
        self.words, self.lowers, self.shapes = _Numbers({"": 0}), _Numbers(), _Numbers()
        self.table = np.empty((_ONE + 2, 0), np.int64)
        self._add(["<edge>"], ["<edge>"])  # word 0: beyond a sentence

    def _at(self, told: list[str]) -> np.ndarray:
        return (np.fromiter(map(xxhash.xxh64_intdigest, told), np.uint64, len(told)) & np.uint64(self.mask)).astype(np.int64)

    def _add(self, lower: list[str], shape: list[str]) -> None:
        """Columns of words, in lower case and as shapes: features of a token, of its neighbours, and numbers of both."""
        told = (
            [f"w{w}" for w in lower], [f"s{s}" for s in shape], [f"p{w[:3]}" for w in lower], [f"e{w[-3:]}" for w in lower], [f"n{min(len(w), 20)}" for w in lower], [f"-w{w}" for w in lower],
            [f"+w{w}" for w in lower], [f"-s{s}" for s in shape], [f"+s{s}" for s in shape], [f"--w{w}" for w in lower], [f"++w{w}" for w in lower],
        )
        numbers = [np.array(list(map(known.__getitem__, own)), np.int64) for known, own in ((self.lowers, lower), (self.shapes, shape))]
        self.table = np.concatenate([self.table, np.stack([*map(self._at, told), *numbers])], axis=1)

    def _pairs(self, a: np.ndarray, b: np.ndarray, told: Callable[[int, int], str]) -> np.ndarray:
        """Places of the features of pairs of numbers, each pair looked up once."""
        each, back = np.unique(a << 32 | b, return_inverse=True)
        return self._at([told(x, y) for x, y in zip((each >> 32).tolist(), (each & 0xFFFFFFFF).tolist(), strict=True)])[back]

    def of(self, words: list[str], cuts: np.ndarray) -> np.ndarray:
        """(tokens, features) of the tokens of sentences, which begin at `cuts`."""
        if len(self.words) > self.most:
            self.clear()
        first = len(self.words)
        ids = np.array(list(map(self.words.__getitem__, words)), np.int64)
        seen = list(islice(self.words, first, None))
        if self.hide is not None:
            seen = ["<hidden>" if self.hide.fullmatch(w) else w for w in seen]
        self._add([w.lower()[:24] for w in seen], [_shape(w) for w in seen])
        n = len(words)
        length = np.diff(cuts)
        place = np.arange(n) - np.repeat(cuts[:-1], length)
        left = np.repeat(cuts[1:], length) - np.arange(n)  # tokens to the end of the sentence, this one included
        padded = np.concatenate([[0, 0], ids, [0, 0]])
        near = lambda k: np.where((place + k >= 0) & (left > k), padded[2 + k : 2 + k + n], 0)
        before, after, before2, after2 = near(-1), near(1), near(-2), near(2)
        table = self.table
        out = np.empty((3 + _ONE, n), np.int64)
        out[0] = self._at(["b"])
        for k, of in enumerate((ids, ids, ids, ids, ids, before, after, before, after, before2, after2)):
            out[1 + k] = table[k].take(of)
        low, shape = list(self.lowers), list(self.shapes)
        lower = table[_ONE]
        out[12] = self._pairs(lower.take(before2), lower.take(before), lambda x, y: f"-ww{low[x]} {low[y]}")
        out[13] = self._pairs(lower.take(before), table[_ONE + 1].take(ids), lambda x, y: f"-ws{low[x]} {shape[y]}")
        return out.T


def features(words: list[str], bits: int, hide: re.Pattern | None = None) -> np.ndarray:
    """(tokens, features): places of each token's features among the weights, for one sentence."""
    return Features(bits, hide).of(words, np.array([0, len(words)]))


def _scores(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """(tokens, labels): sums of the weights of each token's features, in their order."""
    out = weights.take(f[:, 0], axis=0)
    for k in range(1, f.shape[1]):
        out += weights.take(f[:, k], axis=0)
    return out


def gold(tokens: list[tuple[int, int]], spans: list[dict], labels: dict[str, int]) -> np.ndarray:
    """BIO labels of tokens: those that lie in a span, the first as its beginning."""
    out, k = np.zeros(len(tokens), np.int64), 0
    spans = sorted((s for s in spans or [] if s and s["start"] is not None and s["stop"] is not None and s["stop"] > s["start"] and f"B-{s['type']}" in labels), key=lambda s: (s["start"], s["stop"]))
    last = None
    for i, (a, b) in enumerate(tokens):
        while k < len(spans) and spans[k]["stop"] <= a:
            k += 1
        if k < len(spans) and spans[k]["start"] < b and spans[k]["stop"] > a:
            out[i] = labels[("I-" if last == k else "B-") + spans[k]["type"]]
            last = k
    return out


def best(scores: np.ndarray, steps: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The best labels (positions, sentences) for scores (positions, sentences, labels); of equal ones the first. With `lengths`, ascending, a sentence ends
    where its length says, and what stands beyond means nothing."""
    n, lanes, size = scores.shape
    back = np.zeros(scores.shape, np.int64)
    back[:] = np.arange(size)
    now = scores[0].astype(np.float64)
    for t in range(1, n):
        live = slice(0 if lengths is None else int(np.searchsorted(lengths, t, "right")), None)
        way = now[live, :, None] + steps
        back[t, live] = way.argmax(axis=1)
        now[live] = way.max(axis=1) + scores[t, live]
    out = np.empty((n, lanes), np.int64)
    out[-1] = now.argmax(axis=1)
    lane = np.arange(lanes)
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t][lane, out[t]]
    return out


def _labelled(scores: np.ndarray, cuts: np.ndarray, steps: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The best labels of tokens, by scores (tokens, labels) of sentences that begin at `cuts`. No sentence's labels depend on another's."""
    out, lengths = np.zeros(len(scores), np.int64), np.diff(cuts)
    if scores.shape[1] == 1:
        return out
    # A run of other labels in a sentence of label 0 gains at most what its tokens gain, a step in and out, and steps between: where each token loses more, label 0 is best.
    more = (steps - steps[0, 0]).clip(min=0)
    gain = scores[:, 1:].max(axis=1).astype(np.float64) - scores[:, 0] + max(more[0, 1:].max() + more[1:, 0].max(), more[1:, 1:].max())
    open_ = np.flatnonzero(np.maximum.reduceat(gain, cuts[:-1]) > -1e-6) if len(gain) else []
    order = open_[np.argsort(lengths[open_], kind="stable")] if len(open_) else []
    for at in range(0, len(order), 256):
        own = order[at : at + 256]
        size = lengths[own]
        t = np.arange(size[-1])[:, None]
        live = t < size
        token = np.where(live, cuts[own] + t, 0)
        some = scores[token].astype(np.float64)
        some[0][:, inside] = -1e9
        out[token[live]] = best(some, steps, size)[live]
    return out


def _allowed(labels: tuple[str, ...]) -> np.ndarray:
    """0 where a label may follow another, else minus infinity: an inside needs its own beginning or inside before it."""
    ok = [[not b.startswith("I-") or (a[:2] in ("B-", "I-") and a[2:] == b[2:]) for b in labels] for a in labels]
    return np.where(ok, 0.0, -1e9)


def tagged(model: Model, texts: list[str], seen: Features | None = None) -> list[list[dict]]:
    """Spans {type, start, stop} of each text, by start; `seen` keeps what is known of words from one call to the next."""
    seen = seen or Features(model.bits, re.compile(model.hide) if model.hide else None)
    out: list[list[dict]] = []
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text or "") > LOT_CHARS:
            out += _tagged(model, texts[begin:i], seen)
            begin, size = i, 0
        size += len(text or "")
    return out + _tagged(model, texts[begin:], seen)


def _tagged(model: Model, texts: list[str], seen: Features) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in texts]
    words, places, cuts, owners = [], [], [np.zeros(1, np.int64)], []
    for i, text in enumerate(texts):
        own, at, begins = _cut(text or "")
        cuts.append(begins[1:] + len(words))
        words += own
        places.append(at), owners.append(np.full(len(own), i))
    if not words:
        return out
    place, owner, cut = np.concatenate(places), np.concatenate(owners), np.concatenate(cuts)
    inside = np.array([x.startswith("I-") for x in model.labels])
    found = _labelled(_scores(model.weights, seen.of(words, cut)), cut, model.steps + _allowed(model.labels), inside)
    for k in np.flatnonzero(found).tolist():
        name, spans, (a, b) = model.labels[found[k]], out[owner[k]], place[k].tolist()
        if name.startswith("B-"):
            spans.append({"type": name[2:], "start": a, "stop": b})
        else:
            spans[-1]["stop"] = b
    return out


def _learned(parts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, steps: np.ndarray, allowed: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of the averaged perceptron over sentences (features, gold labels): the mean of the weights it had after each. Weights change only after a
    sentence that is labelled wrong, so those up to the next such one are labelled together, more of them the rarer they are."""
    total_w, total_s, n = np.zeros_like(weights), np.zeros_like(steps), len(parts)
    k, ahead = 0, 1
    while k < n:
        some = parts[k : k + ahead]
        cuts = np.cumsum([0, *(len(g) for _, g in some)])
        told_all, gold_all = _labelled(_scores(weights, np.concatenate([f for f, _ in some])), cuts, steps + allowed, inside), np.concatenate([g for _, g in some])
        differ = np.flatnonzero(told_all != gold_all)
        if not len(differ):
            k, ahead = k + len(some), min(2 * ahead, 256)
            continue
        at = int(np.searchsorted(cuts, differ[0], "right")) - 1
        k, ahead = k + at, max(1, min(ahead, 2 * at))
        (f, g), told = parts[k], told_all[cuts[at] : cuts[at + 1]]
        share = (n - k) / n  # the weights after this sentence count so often in the mean
        for i in np.flatnonzero(told != g).tolist():
            np.add.at(weights, (f[i], g[i]), 1.0)
            np.add.at(weights, (f[i], told[i]), -1.0)
            np.add.at(total_w, (f[i], g[i]), share)
            np.add.at(total_w, (f[i], told[i]), -share)
        for seq, sign in ((g, 1.0), (told, -1.0)):
            np.add.at(steps, (seq[:-1], seq[1:]), sign)
            np.add.at(total_s, (seq[:-1], seq[1:]), sign * share)
        k += 1
    return total_w, total_s


def train(docs: DataFrame, text: str, spans: str, rounds: int = 4, parts: int = 4, bits: int = 16, most_docs: int = 4000, hide: str | None = None, empty_share: int = 1, spanned: bool = False) -> Model:
    """A tagger of docs (a text column, and a column of SPAN). At most `most_docs` documents are learned from, those of least hash of their text, whichever
    they are, or with `spanned` whichever hold a span; of sentences without a span, one in `empty_share` is. The weights take 8 * 2**bits * labels bytes.
    Spans may be costly: they are made once for all documents, of which a hash and types are kept, and once more for those learned from."""
    told = docs.select(F.when(F.length(text) > 0, F.xxhash64(text)).alias("h"), F.array_distinct(F.transform(spans, lambda s: s["type"])).alias("types")).persist()
    try:
        types = sorted(r[0] for r in told.select(F.explode("types").alias("t")).distinct().filter("t is not null").limit(201).collect())
        last = told.filter(F.col("h").isNotNull() & ((F.size("types") > 0) | F.lit(not spanned))).select("h").orderBy("h").limit(most_docs).agg(F.max("h")).first()[0]
    finally:
        told.unpersist()
    if len(types) > 200:
        raise ValueError("a tagger of at most 200 types")
    labels = ("O", *(f"{b}-{t}" for t in types for b in "BI"))
    names, inside, allowed = {x: i for i, x in enumerate(labels)}, np.array([x.startswith("I-") for x in labels]), _allowed(labels)
    weights, steps = np.zeros((1 << bits, len(labels))), np.zeros((len(labels), len(labels)))
    rows = docs.select(F.col(text).alias("text"), F.col(spans).cast(SPAN).alias("spans")).filter(F.length("text") > 0)
    # The hash is tested first, so that spans are made of few texts.
    rows = rows.filter(F.xxhash64("text") <= F.lit(last).cast("long")).filter((F.size("spans") > 0) | F.lit(not spanned))
    hidden = re.compile(hide) if hide else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sentences as features and labels."""
        seen = Features(bits, hidden)
        for batch in batches:
            f_out, g_out, keys = [], [], []
            for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, places, cuts = _cut(t)
                if not words:
                    continue
                f, tokens = seen.of(words, cuts), [tuple(x) for x in places.tolist()]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    g = gold(tokens[a:b], s or [], names)
                    key = xxhash.xxh64_intdigest(" ".join(words[a:b]))
                    if g.any() or key % empty_share == 0:
                        f_out.append(f[a:b].ravel().tolist()), g_out.append(g.tolist()), keys.append(key >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(f_out, pa.list_(pa.int64())), pa.array(g_out, pa.list_(pa.int64()))], ["key", "f", "g"])

    sample = rows.orderBy(F.xxhash64("text"), "text").limit(most_docs)
    learned = sample.repartition(parts, F.xxhash64("text")).mapInArrow(cut, "key long, f array<long>, g array<long>").repartition(parts, "key").sortWithinPartitions("key", "g").persist()
    try:
        for _ in range(rounds if len(labels) > 1 else 0):
            shared = docs.sparkSession.sparkContext.broadcast((weights, steps))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                own = []
                for b in batches:
                    f, g = b.column("f").flatten().to_numpy().reshape(-1, 3 + _ONE), b.column("g").flatten().to_numpy()
                    ends = np.cumsum(pc.list_value_length(b.column("g")).to_numpy())[:-1]
                    own += zip(np.split(f, ends), np.split(g, ends), strict=True)
                w, s = (x.copy() for x in shared.value)
                dw, ds = _learned(own, w, s, allowed, inside)
                flat = np.concatenate([dw.ravel(), ds.ravel()])
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "by"])

            mixed = learned.mapInArrow(run, "at long, by double").groupBy("at").agg(F.sum("by").alias("by")).toPandas()
            change = np.zeros(weights.size + steps.size)
            change[mixed["at"].to_numpy(np.int64)] = mixed["by"].to_numpy() / parts
            weights, steps = weights + change[: weights.size].reshape(weights.shape), steps + change[weights.size :].reshape(steps.shape)
            shared.unpersist()
    finally:
        learned.unpersist()
    return Model(labels, bits, weights.astype(np.float32), steps, hide)


def tag(df: DataFrame, text: str, model: Model, into: str = "spans") -> DataFrame:
    """Adds the spans (SPAN) that the model finds in a text column; none in a null one."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    return df.withColumn(into, _iterator_udf(shared)(F.col(text)))


def _iterator_udf(shared) -> Callable:
    import pandas as pd

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        seen = Features(model.bits, re.compile(model.hide) if model.hide else None)
        for texts in parts:
            yield pd.Series(tagged(model, list(texts), seen))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, SPAN)


def scanner(model: Model) -> Callable[[list[str]], list[tuple[str, list[tuple[str, str]]]]]:
    """The model as a scanner for `tasks.protect`: values give way to placeholders [TYPE_n], one for each value."""

    def scan(texts: list[str]) -> list[tuple[str, list[tuple[str, str]]]]:
        out = []
        for text, spans in zip(texts, tagged(model, texts), strict=True):
            marks: dict[tuple[str, str], str] = {}
            counts: dict[str, int] = {}
            new, at = [], 0
            for s in spans:
                value = text[s["start"] : s["stop"]]
                if (s["type"], value) not in marks:
                    counts[s["type"]] = counts.get(s["type"], 0) + 1
                    marks[s["type"], value] = f"[{s['type']}_{counts[s['type']]}]"
                new += [text[at : s["start"]], marks[s["type"], value]]
                at = s["stop"]
            out.append(("".join([*new, text[at:]]), [(mark, value) for (_, value), mark in marks.items()]))
        return out

    return scan


def span_scores(df: DataFrame, expected: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, type, tp, fp, fn, precision and recall of whole spans: type, start and stop agree."""
    side = lambda name: F.transform(F.coalesce(F.col(name).cast(SPAN), F.array().cast(SPAN)), lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["stop"].alias("stop")))
    e, p = F.array_distinct(side(expected)), F.array_distinct(side(predicted))
    told = lambda spans, k: F.transform(spans, lambda s: F.struct(s["type"].alias("type"), F.lit(k).alias("k")))
    rows = df.select(*by, F.explode(F.concat(told(F.array_intersect(e, p), "tp"), told(F.array_except(p, e), "fp"), told(F.array_except(e, p), "fn"))).alias("x")).select(*by, "x.*")
    counts = rows.groupBy(*by, "type").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")])
    share = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 6)
    return counts.select(*by, "type", "tp", "fp", "fn", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
