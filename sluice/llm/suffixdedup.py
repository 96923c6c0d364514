"""Suffix-array dedup of byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Each byte covered by a `length`-byte string that also starts in a document with a smaller doc_id is removed. Texts are
UTF-8; matches never cross documents; strings are judged on the input.

Every `length`-byte window belongs to the least hash of the `seed`-byte strings in it, a rule that depends on its bytes
alone, so all occurrences of a window belong to the same hash. Consecutive windows of one hash make a run, sent in
pieces of at most `RUN_WINDOWS` windows. First,
hashes that occur in one document alone are set aside, and so are later copies of a whole text, which lose all their bytes and decide nothing that the
first copy does not; then the runs of the others meet in buckets by hash. In a
bucket, equal runs become one string that keeps its least document, so copies cost one string. Where a hash has several strings, not all of one window, their suffixes are sorted to
`length` bytes and give a Burrows-Wheeler transform. From the intervals of the first bytes on, which the sort tells, breadth first, backward extension of
each interval by each preceding byte sets the common prefixes between neighbouring suffixes by increasing value, and
stops before `length`: suffixes with no value between them share a window. A hash with very many runs is dealt out
window by window, by the hash of the whole window; then each batch sends a window of its least document alone, as that
decides for the others. Those windows meet twice: first among as many batches as the root of their number, where all but
the least document's are decided, then the least of each of these groups. So a window that every batch holds is in no
task more than that root times.

Defined cases: null text is empty; texts shorter than `length` bytes lose nothing; rows of equal doc_id do not remove
from each other; a null doc_id is the least; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from sluice.llm import batches as bt
from sluice.llm import kernel

SEPARATOR = 0xFF  # never a byte of UTF-8
#: Runs of one hash beyond which its windows are dealt out one by one; more where a bucket has more bytes than `HOT_SHARE` for each, as common runs grow
#: in number with the input, and a window by itself takes many times its share of a run.
HOT_RUNS = 4096
HOT_SHARE = 512
#: Windows of one run as it is sent, with their number as uint16. Periodic text is one run without end.
RUN_WINDOWS = 4096
#: Bytes of runs that a bucket's work holds arrays for at a time (a single hash may have more).
SLICE_BYTES = 1 << 20
#: Windows whose hashes are made at once.
LOT = 1 << 15
U = np.uint64


def _least(buf: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The least hash of the seeds in each window, in lots that a processor's cache holds."""
    size = max(0, len(buf) - length + 1)
    return np.concatenate([np.zeros(0, U), *[kernel.sliding_min(kernel.rolling(buf[x : min(x + LOT, size) + length - 1], seed), length - seed + 1) for x in range(0, size, LOT)]])


def runs_of(buf: np.ndarray, starts: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, first byte and number of windows of each run. The least of many hashes is small: it is hashed again, so that equal ranges of hashes
    have equal shares of the runs."""
    least = _least(buf, length, seed)
    if not len(least):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    sizes = np.diff(starts)
    out = np.minimum(sizes, length)  # the line feed after a document is not its own
    inside = np.repeat(np.tile([True, False], len(sizes)), np.column_stack([sizes - out, out]).ravel())[: len(least)]
    fresh = np.concatenate([[True], least[1:] != least[:-1]])
    fresh[starts[starts < len(least)]] = True
    begin = np.flatnonzero(inside & fresh)
    ends = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True))
    doc = np.repeat(np.arange(len(sizes)), np.diff(np.searchsorted(begin, starts)))
    return kernel.mix(least[begin]), doc, begin, ends - begin + 1


def _first_bytes(text: np.ndarray, length: int) -> tuple[np.ndarray, int, int]:
    """The first bytes of each suffix of a text that ends in a separator as one number, in as many bits as leave room for a place; beyond the end there are
    separators. Also how many bytes, and the bits of one."""
    n = len(text)
    known = np.zeros(256, bool)
    known[text] = True
    code = (np.cumsum(known) - 1).astype(U)
    weight = max(1, int(code[-1]).bit_length())
    taken = max(1, min(length, (64 - n.bit_length()) // weight))
    padded = np.concatenate([code[text], np.full(taken, code[SEPARATOR], U)])
    key = np.zeros(n, U)
    for j in range(taken):
        key = (key << U(weight)) | padded[j : j + n]
    return key, taken, weight


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """The suffixes of a text that ends in a separator in the order of their first `length` bytes, ties in any order. Beyond the end there are separators.

    Ranks of some bytes are doubled: by the ranks of a suffix and of the one that begins where its ranked bytes end.
    """
    n = len(text)
    key, ranked, weight = _first_bytes(text, length)
    bits, mask, room = U(n.bit_length()), U((1 << n.bit_length()) - 1), 64 - n.bit_length()
    at = np.arange(n, dtype=U)
    held = ranked * weight
    while True:
        if held <= room:  # numbers that hold their places are sorted sooner than an order of them is found
            key = (key << bits) | at
            key.sort()
            order = (key & mask).astype(np.int64)
            key >>= bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        if ranked >= length:
            return order
        rank = np.empty(n, U)
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])).astype(U)
        step = min(ranked, length - ranked)
        key = (rank << bits) | np.concatenate([rank[step:], np.full(min(step, n), rank[-1], U)])
        ranked += step
        held = 2 * n.bit_length()


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For the suffixes of a text in order (to `length` bytes), the common prefix of each with the one before; -1 where
    it is `length` or more. Separators are never extended over. The text ends in one."""
    n = len(text)
    bits, mask = n.bit_length(), (1 << n.bit_length()) - 1
    bwt = text[order - 1]  # the text begins after a separator, which is its last byte
    stable = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[stable] = np.arange(n)
    front = bwt[stable]
    prefix = np.full(n + 1, -1, np.int16)
    # The first bytes tell all intervals of as many steps: those of suffixes that begin alike.
    key, taken, weight = _first_bytes(text, length)
    key = key[order]
    apart = key[1:] ^ key[:-1]
    inner = prefix[1:n]
    last, whole = U((1 << weight) - 1), np.full(n, taken)  # bytes of each before a separator
    separator = key.max() & last
    for value in range(taken - 1, -1, -1):
        low = U(weight * (taken - 1 - value))
        inner[apart >> low != 0] = value
        whole[(key >> low) & last == separator] = value
    inner[inner > whole[:-1]] = -1
    prefix[0] = prefix[n] = 0
    rb = np.flatnonzero(np.append(inner == taken - 1, taken == 1) & (whole == taken)) + 1
    lb = np.concatenate([[0], np.flatnonzero(apart) + 1])
    lb = lb[np.searchsorted(lb, rb) - 1]
    for value in range(taken, length):
        sizes = rb - lb
        one = sizes == 1
        at = lb[one]
        at = at[bwt[at] != SEPARATOR]
        new_lb = lf[at]
        new_rb = new_lb + 1
        if not one.all():
            lb, sizes = lb[~one], sizes[~one]
            interval = np.repeat(np.arange(len(lb)), sizes)
            rows = np.arange(len(interval)) + np.repeat(lb - (np.cumsum(sizes) - sizes), sizes)
            keep = bwt[rows] != SEPARATOR
            to = np.sort((interval[keep] << bits) | lf[rows[keep]])
            if len(to):
                where, of = to & mask, to >> bits
                letter = front[where]
                cut = np.flatnonzero((of[1:] != of[:-1]) | (letter[1:] != letter[:-1])) + 1
                new_lb = np.concatenate([new_lb, where[np.concatenate([[0], cut])]])
                new_rb = np.concatenate([new_rb, where[np.append(cut - 1, len(to) - 1)] + 1])
        unset = prefix[new_rb] < 0
        lb, rb = new_lb[unset], new_rb[unset]  # intervals of one step lie apart: no two end at one place
        if not len(rb):
            break
        prefix[rb] = value
    return prefix[:n]


def least_documents(strings: list[np.ndarray] | np.ndarray, ends: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For every window of some strings (concatenated bytes, ends, the least document of each), in order, the least
    document of all strings that hold it."""
    sizes = np.diff(ends, prepend=0)
    text = np.full(int(sizes.sum()) + len(sizes), SEPARATOR, np.uint8)
    of = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(of)) + of] = strings
    n = len(text)
    order = suffix_order(text, length)
    prefix = common_prefixes(text, order, length)
    group = np.cumsum(prefix >= 0) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    window = np.arange(n) - begin[owner] + length <= sizes[owner]
    # Windows of a group are equal; suffixes that end sooner stand apart from them.
    told = np.where(window[order], docs[owner[order]], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(told, np.flatnonzero(prefix >= 0))
    out = np.empty(n, np.int64)
    out[order] = least[group]
    return out[window]


def _gather(buf: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return buf[at + np.repeat(begin, sizes)]


def _short_runs(doc: np.ndarray, begin: np.ndarray, windows: np.ndarray, most: int = RUN_WINDOWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut to at most `most` windows each: the run each comes from, document, first byte and number of windows."""
    pieces = -(-windows // most)
    of = np.repeat(np.arange(len(windows)), pieces)
    skip = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
    return of, doc[of], begin[of] + skip, np.minimum(windows[of] - skip, most)


def _string_hashes(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each of some concatenated strings, none empty."""
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    power, _ = kernel._power_tables(int(sizes.max()) + 1)
    return kernel.mix(np.add.reduceat(kernel._BYTE[text] * power[at], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def _slices(keys: np.ndarray, sizes: np.ndarray, most: int = 1 << 18):
    """Cuts sorted keys into slices of about `most` bytes, none within a key."""
    firsts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    before = (np.cumsum(sizes) - sizes)[firsts] // most
    cut = [*firsts[np.flatnonzero(np.diff(before, prepend=-1))].tolist(), len(keys)] if len(keys) else []
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _first_hashes(text: np.ndarray, begin: np.ndarray, length: int, seed: int, step: int = 1 << 13) -> np.ndarray:
    """The hash of each run, from its first window."""
    out = np.empty(len(begin), np.uint64)
    for x in range(0, len(begin), step):
        some = begin[x : x + step]
        windows = text[some[:, None] + np.arange(length)].ravel()
        seeds = kernel.rolling(np.append(windows, np.zeros(length, np.uint8)), seed)[: len(windows)].reshape(-1, length)
        out[x : x + step] = seeds[:, : length - seed + 1].min(axis=1)
    return kernel.mix(out)


def _covered(text: np.ndarray, doc: np.ndarray, windows: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some runs (concatenated bytes, documents, numbers of windows), the spans of covered windows: run, first window, last window."""
    sizes = windows + length - 1
    begin = np.cumsum(sizes) - sizes
    strings = _string_hashes(text, sizes)
    order = np.lexsort((doc, strings))
    fresh = np.concatenate([[True], strings[order][1:] != strings[order][:-1]])
    string_of = np.empty(len(doc), np.int64)
    string_of[order] = np.cumsum(fresh) - 1
    sample = order[fresh]  # one occurrence of each string, that of its least document
    own, least = windows[sample], doc[sample]
    own_begin = np.cumsum(own) - own
    answer = np.repeat(least, own)  # the least document of each window of each string
    # Windows of different strings can be equal only if their hashes are: those strings are sorted.
    # Where each is one window, they differ in all.
    _, back, repeats = np.unique(hashes[sample], return_inverse=True, return_counts=True)
    several = np.flatnonzero((repeats > 1)[back] & (np.bincount(back, weights=own > 1) > 0)[back])
    several = several[np.argsort(back[several], kind="stable")]
    for part in _slices(back[several], sizes[sample[several]]):  # whole hashes at a time: a sort holds `length` bytes for each of theirs
        some = several[part]
        piece = _gather(text, begin[sample[some]], sizes[sample[some]])
        told = least_documents(piece, np.cumsum(sizes[sample[some]]), least[some], length)
        answer[_gather(np.arange(len(answer)), own_begin[some], own[some])] = told
    row = np.repeat(np.arange(len(doc)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    covered = answer[own_begin[string_of[row]] + offset] < doc[row]
    edge = np.concatenate([[True], (row[1:] != row[:-1]) | (covered[1:] != covered[:-1])])
    heads = np.flatnonzero(edge)
    tails = np.append(heads[1:], len(row)) - 1
    heads, tails = heads[covered[heads]], tails[covered[heads]]
    return row[heads], offset[heads], offset[tails]


def _spans_of_bucket(length: int, seed: int, fine: int, hot_buckets: int):
    def run(key: tuple, sent: pa.Table) -> pa.Table:
        """For each batch, the spans to remove: document in the batch, first byte, end. Whole hashes are taken in turn, so
        that beyond the bucket's bytes a task holds arrays for about `SLICE_BYTES` of them. From `fine` on, buckets hold
        windows of very many batches, some of the batches each: what no document there precedes goes on to a bucket by
        the window alone, under a number from 0 on."""
        batches = sent.column("batch").to_pylist()
        if key[0].as_py() < 0:  # spans that are decided
            return sent.select(["bucket", "batch", "payload"])
        payloads = [bt.unsqueeze(p) for p in sent.column("payload").to_pylist()]
        of = np.repeat(np.arange(len(payloads)), [len(p[0]) for p in payloads])
        doc, place, start, windows = (np.concatenate([p[i] for p in payloads]) for i in range(4))
        text = np.concatenate([p[4] for p in payloads])
        del payloads
        windows = windows.astype(np.int64)
        sizes = windows + length - 1
        begin = np.cumsum(sizes) - sizes
        hashes = _first_hashes(text, begin, length, seed)
        order = np.argsort(hashes, kind="stable")
        found = []
        for part in _slices(hashes[order], sizes[order], SLICE_BYTES):
            some = order[part]
            which, a, b = _covered(_gather(text, begin[some], sizes[some]), doc[some], windows[some], hashes[some], length)
            found.append((some[which], a, b))
        which, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        if key[0].as_py() >= fine:
            left = np.ones(len(of), bool)
            left[which] = False
            on = np.flatnonzero(left)
            cut = np.searchsorted(of[on], np.arange(len(batches) + 1))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                some = on[cut[i] : cut[i + 1]]
                bytes_ = _gather(text, begin[some], sizes[some])
                out.append(((key[0].as_py() - fine) % hot_buckets, batches[i], bt.packed(doc[some], place[some], start[some], windows[some].astype(np.uint16), bytes_)))
        order = np.argsort(of[which], kind="stable")
        which, a, b = which[order], a[order] + start[which[order]], b[order] + start[which[order]] + length
        cut = np.searchsorted(of[which], np.arange(len(batches) + 1))
        for batch, x, y in zip(batches, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if y > x:
                out.append((-1 - batch, batch, bt.packed(place[which[x:y]], a[x:y].astype(np.uint32), b[x:y].astype(np.uint32))))
        return pa.Table.from_batches([bt.as_batch(out, ["bucket", "batch", "payload"], [pa.int64(), pa.int64(), pa.binary()])])

    return run


def salts_of(total: int, batch_bytes: int) -> int:
    """Into how many groups batches are put for hot windows: the root of their number."""
    return max(1, math.isqrt(total // batch_bytes))


def long_texts(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a batch that have a window, by the hash of their whole text; the hashes and the sizes."""
    sizes = np.diff(starts) - 1
    of = np.flatnonzero(sizes >= length)
    hashes = np.array([xxhash.xxh3_64_intdigest(buf[a : a + n]) for a, n in zip(starts[of].tolist(), sizes[of].tolist(), strict=True)], U)
    order = np.argsort(hashes, kind="stable")
    return of[order], hashes[order], sizes[of[order]].astype(np.uint32)


def later_copies(hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a text (its hash and its size) is also that of a smaller doc_id."""
    order = np.lexsort((ids, sizes, hashes))
    h, n, i = hashes[order], sizes[order], ids[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (n[1:] != n[:-1])]))
    out = np.empty(len(h), bool)
    out[order] = i > np.repeat(i[first], np.diff(first, append=len(h)))
    return out


def hot_from(bucket_bytes: int) -> int:
    """Beyond how many runs a hash is hot: a few hundredths of a bucket, whatever the input."""
    return max(HOT_RUNS, bucket_bytes // HOT_SHARE)


def repeated_spans(docs: DataFrame, length: int = 50, seed: int = 24, hot_runs: int | None = None, batch_bytes: int | None = None, bucket_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged documents, and for each batch the spans to remove as compressed arrays.

    A batch and a bucket exchange one row: unless given, both sizes grow with the root of the input, up to 4 and 16 MB.
    """
    if not 0 < seed < length:
        raise ValueError("the seed is shorter than the window")
    total = bt.text_bytes(docs)
    batch_bytes, bucket_bytes = batch_bytes or bt.lot(total, 1_500_000, 4 << 20), bucket_bytes or bt.lot(total, 6_000_000, 16 << 20)
    hot_runs = hot_runs or hot_from(bucket_bytes)
    staged, _ = bt.stage(docs, "suffix", batch_bytes, 5)
    buckets = bt.bucket_count(total, bucket_bytes)
    salts = salts_of(total, batch_bytes)
    hot_buckets = max(1, bt.bucket_count(total, bucket_bytes // 4) // salts)  # a window by itself takes many times its share of the text

    def ask(parts):
        for part in parts:
            for row in bt.rows(part):
                ids, buf, starts = bt.load(row)
                hashes, doc, _, _ = runs_of(buf, starts, length, seed)
                if not len(hashes):
                    continue
                whole, texts, sizes = long_texts(buf, starts, length)
                order = np.argsort(hashes)
                h, d = hashes[order], ids[doc[order]]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                h, shared, n = h[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(first, append=len(h)).astype(np.uint32)
                cut, of_text = bt.cuts(h, buckets), bt.cuts(texts, buckets)
                out = []
                for b in np.flatnonzero(np.diff(cut) + np.diff(of_text)).tolist():
                    x, y = slice(*cut[b : b + 2]), slice(*of_text[b : b + 2])
                    out.append((b, row["batch"], bt.packed(bt.deltas(h[x]), np.packbits(shared[x]), n[x], texts[y], sizes[y], ids[whole[y]])))
                yield bt.as_batch(out, ["bucket", "batch", "payload"], [pa.int32(), pa.int64(), pa.binary()])

    def judge(key: tuple, asked: pa.Table) -> pa.Table:
        """For each hash asked: 0 in one document alone, 1 in several, 2 in very many runs. For each text: whether a document with a smaller doc_id is its copy."""
        each = [bt.unsqueeze(p) for p in asked.column("payload").to_pylist()]
        hashes = [bt.undeltas(x[0]) for x in each]
        copies = np.split(later_copies(*(np.concatenate([x[i] for x in each]) for i in (3, 4, 5))), np.cumsum([len(x[3]) for x in each])[:-1])
        distinct, place, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = np.bincount(place, weights=np.concatenate([np.unpackbits(x[1])[: len(x[2])] for x in each]), minlength=len(distinct)) > 0
        runs = np.bincount(place, weights=np.concatenate([x[2] for x in each]), minlength=len(distinct))
        level = ((times > 1) | shared).astype(np.uint8) * (1 + (runs > hot_runs)).astype(np.uint8)
        ends = np.cumsum([len(h) for h in hashes])
        answers = [bt.packed(level[place[e - len(h) : e]], c.view(np.uint8)) for h, e, c in zip(hashes, ends, copies, strict=True)]
        return pa.table({"batch": asked.column("batch"), "bucket": pa.array([key[0].as_py()] * len(answers), pa.int32()), "payload": pa.array(answers, pa.binary())})

    def send(key: tuple, batch: pa.Table, answers: pa.Table) -> pa.Table:
        """The runs of shared hashes with their bytes, in buckets by hash. A later copy of a text goes whole: the first one's windows stand for its own."""
        out = []
        for row in bt.rows(batch):
            ids, buf, starts = bt.load(row)
            hashes, doc, begin, windows = runs_of(buf, starts, length, seed)
            told = sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
            if not told:
                continue
            _, of = np.unique(hashes, return_inverse=True)
            levels, copies = (np.concatenate(x) for x in zip(*[bt.unsqueeze(p) for _, p in told], strict=True))
            gone = long_texts(buf, starts, length)[0][copies > 0]
            out.append((-1 - row["batch"], row["batch"], bt.packed(gone.astype(np.uint32), np.zeros(len(gone), np.uint32), (np.diff(starts)[gone] - 1).astype(np.uint32))))
            level = np.where(np.isin(doc, gone), 0, levels[of])
            lots = [(0, buckets, hashes[level == 1], doc[level == 1], begin[level == 1], windows[level == 1])]
            if (level == 2).any():  # one run for each window, by the hash of the window
                hot, whole = level == 2, kernel.rolling(buf, length)
                many = _gather(np.arange(len(buf)), begin[hot], windows[hot])
                owner = np.repeat(doc[hot], windows[hot])
                # Beyond the least document of the batch that holds it, a window is covered whatever other batches hold.
                order = np.lexsort((ids[owner], whole[many]))
                many, owner = many[order], owner[order]
                fresh = np.concatenate([[True], whole[many][1:] != whole[many][:-1]])
                sure = ids[owner] > ids[owner][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
                a = (many - starts[owner])[sure].astype(np.uint32)
                out.append((-1 - row["batch"], row["batch"], bt.packed(owner[sure].astype(np.uint32), a, a + np.uint32(length))))
                many, owner = many[~sure], owner[~sure]
                lots.append((buckets + row["batch"] % salts * hot_buckets, hot_buckets, whole[many], owner, many, np.ones(len(many), np.int64)))
            for base, among, key_, doc, begin, windows in lots:
                of, doc, begin, windows = _short_runs(doc, begin, windows)
                key_ = key_[of]
                order = np.argsort(key_, kind="stable")
                key_, doc, begin, windows = key_[order], doc[order], begin[order], windows[order]
                sizes = windows + length - 1
                ends, bytes_ = np.cumsum(sizes), _gather(buf, begin, sizes)
                each = ids[doc], doc.astype(np.uint32), (begin - starts[doc]).astype(np.uint32), windows.astype(np.uint16)
                cut = bt.cuts(key_, among)
                for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if y > x:
                        out.append((base + b, row["batch"], bt.packed(*[v[x:y] for v in each], bytes_[ends[x] - sizes[x] : ends[y - 1]])))
        return pa.Table.from_batches([bt.as_batch(out, ["bucket", "batch", "payload"], [pa.int64(), pa.int64(), pa.binary()])])

    levels = staged.mapInArrow(ask, "bucket int, batch long, payload binary").groupBy("bucket").applyInArrow(judge, "batch long, bucket int, payload binary")
    sent = staged.groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(send, "bucket long, batch long, payload binary")
    spans, schema = sent, "bucket long, batch long, payload binary"
    for step in (buckets, 1 << 62):  # the second takes what the first sends on; what is decided passes through
        spans = spans.groupBy("bucket").applyInArrow(_spans_of_bucket(length, seed, step, hot_buckets), schema)
    return staged, spans.select("batch", "payload")


def removed_bytes(buf: np.ndarray, starts: np.ndarray, payloads: list[bytes]) -> np.ndarray:
    """Whether each byte of a batch goes."""
    change = np.zeros(len(buf) + 1, np.int64)
    for p in payloads:
        place, a, b = bt.unsqueeze(p)
        np.add.at(change, starts[place] + a, 1)
        np.add.at(change, starts[place] + b, -1)
    return np.cumsum(change[:-1]) > 0


def digest(docs: DataFrame, length: int = 50, seed: int = 24, hot_runs: int | None = None, batch_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    staged, spans = repeated_spans(docs, length, seed, hot_runs, batch_bytes, bucket_bytes)

    def finish(key: tuple, batch: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in bt.rows(batch):
            ids, buf, starts = bt.load(row)
            gone = removed_bytes(buf, starts, found.column("payload").to_pylist())
            for i, a, b in zip(ids.tolist(), starts[:-1].tolist(), (starts[1:] - 1).tolist(), strict=True):
                g = gone[a:b]
                kept = buf[a:b][~g] if g.any() else buf[a:b]
                out.append((None if i == bt.NO_ID else i, b - a, int(g.sum()), int((np.diff(g.view(np.int8), prepend=np.int8(0)) == 1).sum()), hashlib.sha256(kept.tobytes()).hexdigest()))
        return pa.Table.from_batches([bt.as_batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])])

    return staged.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
