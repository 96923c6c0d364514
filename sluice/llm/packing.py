"""Packing: repeat counts of shallow length combinations by non-negative least squares, residuals packed greedily.

Documents become token ids, an end id last. Each whole window of a document is a sequence of its own. The lengths that
remain go into bins of `unit` ids. Combinations of one or two bins, repeated so that they fill a window, are
enumerated; non-negative least squares finds how often to use each so that the histogram of lengths is used up, and the
counts are rounded down. What no combination takes is laid out on a tape and cut to fill the gaps that the bins leave,
then whole windows: only the last sequence is padded.

Defined cases: null or empty text is its end id alone; every row, repeated or not, is packed by itself; a null doc_id
stays null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import kernel
from sluice.llm.common import chunks, keyed, utf8, written

#: Words after which no more are kept.
CACHE = 500_000
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: ASCII punctuation; letters; continuation bytes that make a letter, and a capital, after the byte 0xC3 (Latin letters with marks).
_MARK, _LETTER, _LATIN, _CAPITAL = (np.zeros(256, bool) for _ in range(4))
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_CAPITAL[[b for b in range(0x80, 0x9F) if b != 0x97]] = True


def units(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and first byte and end of each unit of them. A unit is a run between ASCII white space; but of a run of letters (ASCII,
    or Latin letters after 0xC3) with ASCII punctuation after them, the letters in lower case are one unit and the punctuation another:
    these letters are the same after normalisation, and the tokenizer cuts before the punctuation."""
    edge = np.diff(kernel.NOT_SPACE[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return buf, begin, end
    lead = buf == 0xC3
    after = np.concatenate([[False], lead[:-1]])
    marked = after & _LATIN[buf]
    letter = _LETTER[buf] | marked | np.append(lead[:-1] & marked[1:], False)
    letters = np.concatenate([[0], np.cumsum(letter)])
    core = np.maximum.accumulate(np.where(_MARK[buf], -1, np.arange(len(buf))))[end - 1] + 1  # the end of what is before the last marks
    plain = (core > begin) & (letters[np.maximum(core, begin)] - letters[begin] == core - begin)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[begin[plain]] = 1
    inside[end[plain]] -= 1
    capital = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & (((buf >= 65) & (buf <= 90)) | (after & _CAPITAL[buf]))
    buf = buf + capital.astype(np.uint8) * np.uint8(32)
    cut = plain & (core < end)
    place = np.arange(len(begin)) + np.concatenate([[0], np.cumsum(cut)[:-1]])
    out = np.empty((2, len(begin) + int(cut.sum())), np.int64)
    out[:, place] = begin, np.where(cut, core, end)
    out[:, place[cut] + 1] = core[cut], end[cut]
    return buf, out[0], out[1]


class Encoder:
    """Ids of texts by a tokenizer that drops white space, so that each run of other characters is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Words of letters alone are encoded as one text and cut where a word's last id stands."""
        words = [t for t in texts if t.isalpha()]
        done: dict[str, bytes] = {}
        for i in range(0, len(words), 200):
            block = words[i : i + 200]
            ids = self._each([" ".join(block)])[0]
            cuts = [0, *(4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()]
            whole = len(cuts) == len(block) + 1 and cuts[-1] == len(ids)
            done.update(zip(block, [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)] if whole else self._each(block), strict=True))
        rest = [t for t in texts if t not in done]
        done.update(zip(rest, self._each(rest), strict=True))
        return [done[t] for t in texts]

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words, as little-endian 32-bit numbers."""
        new = [w for w in words if w not in self.known]
        fresh = dict(zip(new, self._encode([w.decode() for w in new]), strict=True))
        if len(self.known) < CACHE:
            self.known.update(fresh)
            return [self.known[w] for w in words]
        return [fresh[w] if w in fresh else self.known[w] for w in words]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin (with the end as last).

        Units of up to 16 bytes are told apart as two numbers, and a sum of both finds the distinct ones; longer ones are
        told apart as bytes."""
        buf, starts = kernel.joined(texts)
        buf, begin, end = units(buf)
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
        raw = buf.tobytes() + bytes(16)
        eight = np.ndarray((len(buf) + 9,), "<u8", raw, strides=(1,))  # the eight bytes from each byte on
        n = end - begin
        low, high = eight[begin] & _MASK[np.minimum(n, 8)], eight[begin + np.minimum(n, 8)] & _MASK[np.clip(n - 8, 0, 8)]
        order = np.argsort(kernel.mix(low + kernel.mix(high + n.astype(np.uint64))))
        order = order[n[order] <= 16]
        a, b = order[1:], order[:-1]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (low[a] != low[b]) | (high[a] != high[b]) | (n[a] != n[b])]))
        which = np.empty(len(n), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        distinct = [raw[x:y] for x, y in zip(begin[order[first]].tolist(), end[order[first]].tolist(), strict=True)]
        far = np.flatnonzero(n > 16)
        place: dict[bytes, int] = {}
        which[far] = [len(distinct) + place.setdefault(raw[x:y], len(place)) for x, y in zip(begin[far].tolist(), end[far].tolist(), strict=True)]
        ids = self.words(distinct + list(place))
        sizes = np.array([len(x) // 4 for x in ids])
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[which]
        total = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.arange(total[-1]) + np.repeat(at[which] - total[:-1], each)]
        return out, total[np.searchsorted(begin, starts)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps the words it knows from task to task."""
    return Encoder(path)


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, tail, pack = encoder(path), np.array([end_id], "<u4"), zstandard.ZstdCompressor(1).compress
        row = TaskContext.get().partitionId() << 33
        for batch in chunks(batches, 1 << 20):
            ids, cut = encode(utf8(batch.column("text")))
            n = batch.num_rows
            each = [np.concatenate([ids[a:b], tail]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), pa.array([len(x) for x in each], pa.int64()), pa.array([pack(narrow(x)) for x in each], pa.binary())],
                ["row", "doc_id", "n", "ids"],
            )
            row += n

    return run


def narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where they suffice; the first byte tells the width."""
    return b"2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"4" + ids.tobytes()


def widen(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=1).astype("<u4")


def combinations(units: int) -> list[dict[int, int]]:
    """Every one or two bins with repeats that fill the window: {bin: repeats}."""
    out = [{a: units // a} for a in range(1, units + 1) if units % a == 0]
    for a in range(1, units):
        for i in range(1, (units - a - 1) // a + 1):
            rest = units - i * a
            out += [{a: i, b: rest // b} for b in range(a + 1, rest + 1) if rest % b == 0]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """argmin |ax - b| for x >= 0 (Lawson and Hanson's active sets)."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    gain = a.T @ b
    floor = 1e-9 * max(1.0, np.abs(gain).max(initial=0))
    for _ in range(rounds):
        free = np.where(on, -np.inf, gain)
        j = int(np.argmax(free))
        if on.all() or free[j] <= floor:
            break
        on[j] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s[on] > 0).all():
                break
            bad = on & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                s = x
                break
        x = s
        gain = a.T @ (b - a @ x)
    return x


def plan(count: np.ndarray, tokens: np.ndarray, unit: int, window: int) -> list[tuple[dict[int, int], int]]:
    """(combination, repeats) from the histogram: documents and tokens of each bin, bin 0 unused. Repeats are rounded
    down, and lowered evenly until what remains fills the gaps."""
    units = window // unit
    combos = [c for c in combinations(units) if all(count[b] for b in c)]
    if not combos:
        return []
    a = np.zeros((units + 1, len(combos)))
    for j, c in enumerate(combos):
        for b, m in c.items():
            a[b, j] = m
    solved = nnls(a / units, count / units)
    mean = tokens / np.maximum(count, 1)
    for share in np.linspace(1, 0, 201):
        x = np.floor(solved * share + 1e-9)
        while (over := np.flatnonzero(a @ x > count)).size:
            x[np.flatnonzero((a[over[0]] > 0) & (x > 0))[-1]] -= 1
        used = (a @ x) * mean
        if tokens.sum() - used.sum() >= 1.05 * (x.sum() * window - used.sum()):
            break
    return [(combos[j], int(x[j])) for j in np.flatnonzero(x)]


def prefix_sums(df: DataFrame, value: str, into: str, parts: int) -> tuple[DataFrame, int]:
    """Adds the sum of `value` over all rows before a row, in an order by hash and row; also the whole sum. Only one
    number for each of `parts` groups comes to the driver."""
    df = df.withColumn("part_", F.pmod(F.xxhash64("row"), F.lit(parts)))
    sums = sorted((r[0], r[1]) for r in df.groupBy("part_").agg(F.sum(value).cast("long")).collect())
    total, begins = 0, []
    for part, n in sums:
        begins.append((part, total))
        total += n or 0
    begin = df.sparkSession.createDataFrame(begins, "part_ long, begin_ long")
    w = Window.partitionBy("part_").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(F.broadcast(begin), "part_").withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("begin_")).drop("part_", "begin_"), total


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, unit: int = 32) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = written(keyed(docs, "text").mapInArrow(_tokenised(tokenizer, end_id), "row long, doc_id long, n long, ids binary"), "tokens")
    thin = staged.select("row", "n", F.expr(f"n div {window}").alias("full"), (F.col("n") % window).alias("rest")).withColumn("bin", F.ceil(F.col("rest") / unit).cast("int"))
    units = window // unit
    count, tokens = np.zeros(units + 1), np.zeros(units + 1)
    for r in thin.filter("rest > 0").groupBy("bin").agg(F.count("*").alias("c"), F.sum("rest").alias("t")).collect():  # at most window / unit rows
        count[r["bin"]], tokens[r["bin"]] = r["c"], r["t"]
    chosen = plan(count, tokens, unit, window)

    whole, n_full = prefix_sums(thin.filter("full > 0").select("row", "full"), "full", "first", parts)
    full = whole.select("row", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("i"), "first").select(
        "row", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    # A document's place in its bin says which repeat of which combination takes it.
    rests = thin.filter("rest > 0").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = sorted((r["bin"], r["part"], r["count"]) for r in rests.groupBy("bin", "part").count().collect())  # bins x parts
    begins, last, at = [], None, 0
    for b, p, c in counts:
        at = at if b == last else 0
        begins.append((b, p, at))
        last, at = b, at + c
    begin = spark.createDataFrame(begins, "bin int, part long, begin long")
    ranked = rests.join(F.broadcast(begin), ["bin", "part"]).withColumn("place", F.col("begin") + F.row_number().over(Window.partitionBy("bin", "part").orderBy("row")) - 1)
    slots: dict[int, list[tuple[int, int, int]]] = {}  # bin: (first place, repeats in a sequence, first sequence)
    ends: dict[int, int] = {}
    sequence = n_full
    for combo, x in chosen:
        for b, m in combo.items():
            slots.setdefault(b, []).append((ends.get(b, 0), m, sequence))
            ends[b] = ends.get(b, 0) + m * x
        sequence += x
    tables = {b: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for b, v in slots.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bin", "place"))
            out = np.full(len(bins), -1, np.int64)
            for b in np.unique(bins):
                if b in tables:
                    mine = np.flatnonzero((bins == b) & (place < ends[b]))
                    base, m, first = tables[b]
                    k = np.searchsorted(base, place[mine], "right") - 1
                    out[mine] = first[k] + (place[mine] - base[k]) // m[k]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("full"), batch.column("rest"), pa.array(out)], ["row", "full", "rest", "sequence_id"])

    placed_ = written(ranked.select("row", "full", "rest", "bin", "place").mapInArrow(placed, "row long, full long, rest long, sequence_id long"), "placed")
    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed_.filter("sequence_id >= 0").select("row", (F.col("full") * window).alias("start"), F.col("rest").alias("length"), "sequence_id", F.coalesce(F.sum("rest").over(before), F.lit(0)).alias("offset"))

    gaps = placed_.filter("sequence_id >= 0").groupBy(F.col("sequence_id").alias("row")).agg(F.sum("rest").alias("used")).withColumn("gap", window - F.col("used")).filter("gap > 0")
    gaps, n_gap = prefix_sums(gaps, "gap", "gap_at", parts)
    tape, _ = prefix_sums(placed_.filter("sequence_id < 0").select("row", "full", "rest"), "rest", "tape_at", parts)
    tape = written(tape, "tape")
    blocks = lambda at, n: F.explode(F.sequence(F.expr(f"{at} div {window}"), F.expr(f"({at} + {n} - 1) div {window}"))).alias("block")
    inside = tape.filter(F.col("tape_at") < n_gap).select("*", blocks("tape_at", "rest")).join(
        gaps.select(F.col("row").alias("sequence_id"), "used", "gap", "gap_at", blocks("gap_at", "gap")), "block"
    )
    low, high = F.greatest("tape_at", "gap_at"), F.least(F.col("tape_at") + F.col("rest"), F.col("gap_at") + F.col("gap"))
    inside = inside.filter((low < high) & (F.expr(f"greatest(tape_at, gap_at) div {window}") == F.col("block"))).select(
        "row", (F.col("full") * window + low - F.col("tape_at")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("used") + low - F.col("gap_at")).alias("offset")
    )
    beyond = tape.filter(F.col("tape_at") + F.col("rest") > n_gap).withColumn("from", F.greatest(F.col("tape_at"), F.lit(n_gap)) - n_gap).withColumn("to", F.col("tape_at") + F.col("rest") - n_gap)
    beyond = beyond.select("*", F.explode(F.sequence(F.expr(f"`from` div {window}"), F.expr(f"(`to` - 1) div {window}"))).alias("w"))
    low, high = F.greatest(F.col("from"), F.col("w") * window), F.least(F.col("to"), (F.col("w") + 1) * window)
    beyond = beyond.select(
        "row", (F.col("full") * window + low + n_gap - F.col("tape_at")).alias("start"), (high - low).alias("length"), (F.col("w") + sequence).alias("sequence_id"), (low - F.col("w") * window).alias("offset")
    )
    pieces = full.unionByName(fitted).unionByName(inside).unionByName(beyond)
    pieces = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    return staged.join(pieces, "row").select("doc_id", "n", "ids", "pieces").mapInArrow(
        _checked, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, column="ids"):
        rows = []
        for doc, n, ids, pieces in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces")), strict=True):
            ids = widen(ids)
            rows += [(doc, p["start"], p["length"], zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()), n, p["sequence_id"], p["offset"]) for p in pieces]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
