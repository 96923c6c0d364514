"""Benchmark decontamination: a generalised suffix automaton of the benchmark's words, streamed over each document.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. A document word
inside any occurrence of a window is hit.

Defined cases: null texts have no words; an item without words has no window; repeated item ids count once; items without
an id hit as others do and count as one item, which the list of ids leaves out; an empty benchmark hits nothing; every row
of documents gives one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from sluice.llm.common import chunks, given_up, keyed, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Words of benchmark text in one automaton, which has at most twice as many states, of some 700 bytes each; a larger benchmark is cut
#: into blocks of whole items, each streamed in turn.
BLOCK_WORDS = 100_000
#: The automaton that a Python worker has built last, by the name of its block.
_BUILT: dict[str, Automaton] = {}
#: What the blocks before the last have hit: spans and items of each row.
HITS = "hits_"
HITS_TYPE = pa.struct({"begin": pa.list_(pa.int64()), "end": pa.list_(pa.int64()), "items": pa.list_(pa.string())})


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """Suffix automaton of several word sequences. A state holds the transitions, the length of its longest string and
    its suffix link; `ends` has the items with a window that ends at a state's strings of window length or, for items
    shorter than that, whose whole sequence is a string of the state."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, self.window = [-1], [0], window
        whole: dict[int, dict[int, set[str]]] = {}
        own: list[set[str]] = [set()]
        for item, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                own += [set() for _ in range(len(self.len) - len(own))]
            at = 0
            for word in sequence:
                at = self.next[at][word]
                own[at].add(item)
            if sequence and len(sequence) < window:
                whole.setdefault(at, {}).setdefault(len(sequence), set()).add(item)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        # Item sets go up the suffix links as far as the states that hold strings of window length.
        for v in reversed(order):
            if self.len[self.link[v]] >= window:
                own[self.link[v]] |= own[v]
        self.long: list[frozenset[str]] = [frozenset()] * len(self.len)
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.len)
        for v in order:
            up = self.link[v]
            if self.len[v] >= window:
                self.long[v] = frozenset(own[v]) if self.len[up] < window else self.long[up]
            mine = tuple((n, frozenset(i)) for n, i in whole.get(v, {}).items())
            self.short[v] = self.short[up] + mine

    def _extend(self, last: int, word: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(length)
        nxt.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q])), length.append(length[p] + 1), link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = link[p]
        return new

    def spans(self, sequence: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (first word, one past the last; merged, ascending) and the items with occurring windows."""
        nxt, link, length, window, short, long = self.next, self.link, self.len, self.window, self.short, self.long
        root, found, items = nxt[0], [], set()
        at = size = 0
        for i, word in enumerate(sequence):
            if not at:
                if word not in root:
                    continue
                at, size = root[word], 1
            else:
                step = nxt[at].get(word)
                while step is None and at:
                    at = link[at]
                    size = length[at]
                    step = nxt[at].get(word)
                if step is None:
                    size = 0
                    continue
                at, size = step, size + 1
            if size >= window:
                items |= long[at]
                begin = i + 1 - size
            else:
                begin = i + 1
            for n, which in short[at]:
                if n <= size:
                    items |= which
                    begin = min(begin, i + 1 - n)
            if begin <= i:
                while found and found[-1][1] >= begin:
                    begin = min(begin, found.pop()[0])
                found.append((begin, i + 1))
        return found, items


def automata(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[str]]]]:
    """The benchmark's items in blocks of at most `block_words` words (or one item), so that none is large."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).toLocalIterator():
        sequence = words_of(row["text"])
        if block and size + len(sequence) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item"], sequence))
        size += len(sequence)
    if block:
        yield block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that meet are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _hits(batch: pa.RecordBatch, machine: Automaton | None) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None]]]:
    """Number of words, merged spans and items of each row, those of earlier blocks included."""
    told = batch.column(HITS).to_pylist() if HITS in batch.schema.names else [None] * batch.num_rows
    for text, hits in zip(batch.column("text").to_pylist(), told, strict=True):
        sequence = words_of(text)
        spans, items = machine.spans(sequence) if machine else ([], set())
        if hits:
            spans, items = spans + list(zip(hits["begin"], hits["end"], strict=True)), items | set(hits["items"])
        yield len(sequence), _merged(spans), items


def _machine(name: str, block, window: int) -> Automaton:
    """The automaton of a broadcast block, built once in each Python worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(block.value, window)
    return _BUILT[name]


def _swept(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int):
    """The documents with the column of hits of all blocks but the last, and the broadcast of the last (None of none).

    Each block before the last is broadcast alone, for one pass that writes the documents with what was hit so far; then
    its broadcast and the pass before are given up. The driver holds two blocks at most, a Python worker one automaton."""
    spark, blocks, given = docs.sparkSession, automata(benchmark, window, block_words), docs
    block = next(blocks, None)
    for following in blocks:
        sent = spark.sparkContext.broadcast(block)
        swept = written(docs.mapInArrow(_sweep(sent, window), _with_hits(docs)), "swept")
        sent.destroy()
        if docs is not given:
            given_up(docs)
        docs, block = swept, following
    return docs, spark.sparkContext.broadcast(block) if block is not None else None


def _with_hits(docs: DataFrame) -> StructType:
    own = StructType([f for f in docs.schema.fields if f.name != HITS])
    return own.add(HITS, from_arrow_type(HITS_TYPE))


def _sweep(sent, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, sent, window)
        for batch in chunks(batches):
            hits = [{"begin": [a for a, _ in s], "end": [b for _, b in s], "items": list(i)} for _, s, i in _hits(batch, machine)]
            own = [c for c in batch.schema.names if c != HITS]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(hits, HITS_TYPE)], [*own, HITS])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    The automaton of a block of items is built once in each Python worker from a broadcast of at most `block_words`
    words. Blocks are streamed one after the other over the same documents; what they hit is merged per row.
    """
    swept, block = _swept(keyed(docs, "text"), benchmark, window, block_words)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, block, window) if block else None
        for batch in chunks(batches):
            rows = []
            for n_words, spans, items in _hits(batch, machine):
                hit = sum(b - a for a, b in spans)
                ids = sorted(i for i in items if i is not None)
                rows.append((n_words, hit, len(items), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return swept.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut_spans(text: str | None, merged: list[tuple[int, int]], max_words: int, max_share: float) -> str | None:
    """The text without its hit spans of at least `max_words` words; null if hits cover more than `max_share` of its words."""
    if not text or not merged:
        return text
    at = [(m.start(), m.end()) for m in WORD.finditer(text.translate(_LOWER))]
    if sum(b - a for a, b in merged) > max_share * len(at):
        return None
    out, end = [], 0
    for a, b in merged:
        if b - a >= max_words:
            out.append(text[end : at[a][0]])
            end = at[b - 1][1]
    return "".join([*out, text[end:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 10, max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns as they were, with benchmark spans of at least `max_words` words cut out of text;
    documents of which more than `max_share` of the words are hit go. A null text stays as it is."""
    swept, block = _swept(docs, benchmark, window, block_words)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, block, window) if block else None
        for batch in chunks(batches):
            old = batch.column("text").to_pylist()
            new = [cut_spans(t, spans, max_words, max_share) for t, (_, spans, _) in zip(old, _hits(batch, machine), strict=True)]
            place = batch.schema.get_field_index("text")
            stays = pa.array([n is not None or t is None for n, t in zip(new, old, strict=True)], pa.bool_())
            cut = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type)).filter(stays)
            yield cut.select([c for c in cut.schema.names if c != HITS])

    return swept.mapInArrow(run, docs.schema)
