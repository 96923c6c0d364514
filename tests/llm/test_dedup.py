"""Line dedup, suffix dedup, Jaccard join and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import batches as bt
from sluice.llm import decontaminate, jaccardjoin, kernel, linededup, suffixdedup
from sluice.llm.components import components

from . import cases

BLANKS = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# Line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(BLANKS))
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines_against_brute_force(spark, min_docs):
    rows = cases.corpus(5)
    found = got(linededup.line_digest(cases.frame(spark, rows), 20, min_docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert found == brute_lines(rows, 20, min_docs)
    assert sum(r[2] for r in found) > 0


def test_one_line_with_most_rows(spark):
    """A line of 3000 documents crosses range partitions and still has one keeper."""
    line = "the same long line of text in every one of them"
    rows = [cases.row(i, f"{line}\n{i}\n {line.upper()} ") for i in range(3000)]
    found = got(linededup.line_digest(cases.frame(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert found == brute_lines(rows)


def test_one_document_with_most_rows(spark):
    """A line that one document repeats over several range partitions counts that document once."""
    line = "the same long line of text, again and again and again"
    rows = [cases.row(1, f"{line}\none"), cases.row(2, f"{line}\n" * 20_000), cases.row(3, "\n".join(f"a line of its own, number {i} of the others" for i in range(2000)))]
    found = got(linededup.line_digest(cases.frame(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert found == brute_lines(rows) and not any(r[2] for r in found)
    rows += [cases.row(i, line) for i in (-7, -8, 4)]
    found = got(linededup.line_digest(cases.frame(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert found == brute_lines(rows) and sum(r[2] for r in found) == 20_003


def test_lines_of_odd_tables(spark):
    assert linededup.line_digest(cases.empty(spark)).count() == 0
    docs = cases.odd(spark)
    assert linededup.line_digest(docs, 5, 2).count() == docs.count()
    kept = linededup.drop_lines(docs, 5, 2)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r["key"] for r in kept.collect()} == {"clash"}


def test_lines_of_rows_that_share_an_id(spark):
    """Null and repeated ids: each row loses its own repeated lines, not those of another."""
    line = "the same long line of text in every one of them"
    rows = [cases.row(i, f"{line}\nnumber {i}") for i in range(6)]
    rows += [cases.row(d, t) for d in (None, 2) for t in (f"{line}\nits first", f"a line of its own, long enough to count as such\n{line}", "all its own\nand this\nand that", f"{line}\nits first")]
    told = [(linededup.NO_ID if d is None else d, *rest) for d, *rest in rows]
    found = got(linededup.line_digest(cases.frame(spark, rows)).fillna(linededup.NO_ID, ["doc_id"]), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert found == brute_lines(told)
    kept = linededup.drop_lines(cases.frame(spark, rows)).fillna(linededup.NO_ID, ["doc_id"])
    assert sorted((r["doc_id"], sha(r["text"])) for r in kept.collect()) == sorted((d, s) for d, _, _, s in brute_lines(told))


def test_bitmaps_round_trip():
    gone = [0, 3, 9, 17]
    keep = linededup.unpack(linededup.pack(gone), 40)
    assert np.flatnonzero(~keep).tolist() == gone
    assert linededup.unpack(None, 3).all()


# Suffix dedup


def brute_suffix(rows, length):
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, sha(bytes(np.frombuffer(raw, np.uint8)[~gone]))))
    return sorted(out)


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("length,seed,hot", [(50, 24, 4096), (50, 24, 3), (20, 5, 4096), (12, 11, 2)])
def test_suffix_against_brute_force(spark, length, seed, hot):
    rows = cases.corpus(7, 80)
    rows += [cases.row(9000, "ab" * 300), cases.row(9001, "ab" * 200 + "c"), cases.row(9002, "é" * 200), cases.row(9003, "é" * 150)]
    found = got(suffixdedup.digest(cases.frame(spark, rows), length, seed, hot), *SUFFIX)
    assert found == brute_suffix(rows, length)
    assert sum(r[2] for r in found) > 0


def test_suffix_of_a_line_in_every_batch(spark):
    """A line that every batch holds is hot, and goes to groups of batches first: no group sees it once for each batch."""
    line = "This very line stands at the end of each and every document of the table."
    rows = [cases.row(i, (t[1] or "") + "\n" + line) for i, t in enumerate(cases.corpus(8, 120))]
    batch_bytes = 1 << 10
    found = got(suffixdedup.digest(cases.frame(spark, rows), 50, 24, 8, batch_bytes, 1 << 12), *SUFFIX)
    assert found == brute_suffix(rows, 50)
    staged, spans = suffixdedup.repeated_spans(cases.frame(spark, rows), 50, 24, 8, batch_bytes, 1 << 12)
    assert staged.count() > 50 and spans.count() > 0
    total = sum(len(r[1].encode()) for r in rows)
    assert suffixdedup.salts_of(total, batch_bytes) > 5


def test_suffix_windows_go_on_once_a_group():
    """Of a window in six batches of one group only the least document's goes on; the others are decided there."""
    text, docs = b"0123456789" * 5, [7, 3, 9, 4, 8, 5]
    payload = lambda d: bt.squeeze(np.array([d]), np.zeros(1, np.uint32), np.zeros(1, np.uint32), np.ones(1, np.uint16), np.frombuffer(text, np.uint8))
    sent = pa.table({"bucket": pa.array([11] * 6, pa.int64()), "batch": pa.array(range(6), pa.int64()), "payload": pa.array([payload(d) for d in docs], pa.binary())})
    out = suffixdedup._spans_of_bucket(50, 24, 10, 4)((pa.scalar(11),), sent).to_pylist()
    assert [(r["bucket"], r["batch"]) for r in out if r["bucket"] >= 0] == [(1, 1)]
    assert sorted(r["batch"] for r in out if r["bucket"] < 0) == [0, 2, 3, 4, 5]


def test_suffix_hashes_have_equal_shares():
    """The least of many hashes is small: buckets of equal ranges of it would differ by a factor of twenty-seven."""
    buf, starts = kernel.joined([np.random.default_rng(i).integers(97, 123, 40_000, dtype=np.uint8).tobytes() for i in range(5)])
    hashes, doc, begin, windows = suffixdedup.runs_of(buf, starts, 50, 24)
    shares = np.diff(bt.cuts(np.sort(hashes), 32))
    assert shares.max() < 1.5 * shares.mean() and windows.sum() == 5 * (40_000 - 49)
    assert (np.bincount(doc, weights=windows) == 40_000 - 49).all() and (begin >= starts[doc]).all()


def test_suffix_windows_by_themselves_are_not_sorted(monkeypatch):
    """Windows of one hash that are each a string differ or are one: a hot hash takes no sort of fifty suffixes for each window."""
    seed = bytes(range(65, 89))
    strings = [bytes([97 + i % 26, 97 + i // 26] * 6) + seed + b"0" * 14 for i in range(200)] * 2
    text = np.frombuffer(b"".join(strings), np.uint8)
    monkeypatch.setattr(suffixdedup, "least_documents", None)
    row, a, b = suffixdedup._covered(text, np.arange(400), np.ones(400, np.int64), np.zeros(400, np.uint64), 50)
    assert sorted(row.tolist()) == list(range(200, 400)) and not a.any() and not b.any()


def test_suffix_hashes_are_hot_by_their_share():
    assert suffixdedup.hot_from(1 << 16) == suffixdedup.HOT_RUNS < suffixdedup.hot_from(16 << 20) <= (16 << 20) // 512


@pytest.mark.parametrize("letters,length", [(2, 8), (2, 50), (20, 1), (20, 50), (200, 50)])
def test_suffix_order(letters, length):
    rng = np.random.default_rng(letters)
    strings = [bytes(rng.integers(0, letters, n, dtype=np.uint8)) for n in (300, 1, 60, 300, 5)] + [b"\x01" * 200]
    text = np.frombuffer(b"".join(s + b"\xff" for s in [*strings, strings[0]]), np.uint8)
    padded = text.tobytes() + b"\xff" * length
    keys = [padded[i : i + length] for i in suffixdedup.suffix_order(text, length)]
    assert keys == sorted(padded[i : i + length] for i in range(len(text)))


def test_small_lots_come_back():
    for arrays in ([np.arange(5), np.array([7], np.uint16), np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)], [np.arange(9000), np.ones(3, np.uint32)]):
        back = bt.unsqueeze(bt.packed(*arrays))
        assert [x.dtype for x in back] == [x.dtype for x in arrays] and all((x == y).all() for x, y in zip(back, arrays, strict=True))


def test_suffix_of_whole_copies(spark):
    """Later copies of a text go whole, but not rows of the least doc_id, near copies, or texts without a window."""
    text = [t[1] or "" for t in cases.corpus(9, 30)]
    rows = [cases.row(i % 10 * 1000 + i // 10, t) for i, t in enumerate(t for t in text for _ in range(10))]
    rows += [cases.row(0, text[0]), cases.row(9999, text[3][:-1]), cases.row(9998, "short"), cases.row(9997, "short"), cases.row(9996, "x" * 50), cases.row(9995, "x" * 50), cases.row(9994, "x" * 51)]
    found = got(suffixdedup.digest(cases.frame(spark, rows), batch_bytes=1 << 11, bucket_bytes=1 << 13), *SUFFIX)
    assert found == brute_suffix(rows, 50)
    hashes, sizes, ids = np.array([5, 5, 5, 7, 5, 7], np.uint64), np.array([60, 60, 61, 60, 60, 60], np.uint32), np.array([3, bt.NO_ID, 9, 4, 3, 4])
    assert suffixdedup.later_copies(hashes, sizes, ids).tolist() == [True, False, False, False, True, False]


def test_lots_grow_with_the_root():
    sizes = [bt.lot(n, 1_500_000, 4 << 20) for n in (0, 10**7, 10**9, 4 * 10**9, 10**14)]
    assert sizes == [bt.LEAST_LOT, 150_000, 1_500_000, 3_000_000, 4 << 20]


def test_suffix_of_very_long_periodic_texts(spark):
    """Runs of more windows than two bytes can count: copies, another phase, and a short stretch elsewhere."""
    long = "word " * 30_000
    rows = [cases.row(1, long), cases.row(2, long), cases.row(3, "x" + long[2:]), cases.row(4, "-" * 70_000), cases.row(5, "ends in " + "-" * 60)]
    rows += [cases.row(6, "a" * 70_000), cases.row(7, "a" * 70_000), cases.row(8, "ab" * 500_000), cases.row(9, "b" + "ab" * 500_000)]
    found = got(suffixdedup.digest(cases.frame(spark, rows)), *SUFFIX)
    assert found == brute_suffix(rows, 50)


def test_suffix_of_odd_tables(spark):
    assert suffixdedup.digest(cases.empty(spark)).count() == 0
    found = suffixdedup.digest(cases.odd(spark), 50).collect()
    assert len(found) == 7
    by = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found)
    assert [r[2] == r[1] for r in by if r[0] == 1] == [True, True]  # the null id is the least and holds the text
    assert [r[1:] for r in by if r[0] in (2, 3)] == [(0, 0), (0, 0)]


def test_common_prefixes_by_expansion():
    """Prefixes set by backward extension equal those of plain comparison, up to the bound."""
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (40, 1, 17, 40, 5)]
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    padded = text.tobytes() + b"\xff" * 8
    order = np.array(sorted(range(len(text)), key=lambda i: padded[i : i + 8]))
    got_ = suffixdedup.common_prefixes(text, order, 8)
    for i in range(1, len(order)):
        a, b = (padded[j : j + 8].split(b"\xff")[0] for j in (order[i - 1], order[i]))
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        if len(a) == 8 and len(b) == 8:
            assert got_[i] == (-1 if n >= 8 else n)


# Jaccard join


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute_join(rows, words, num, den):
    sets = {doc: shingle_set(text, words) for doc, text, *_ in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((d, len(sets[d]), root(d)) for d in docs)


@pytest.mark.parametrize("words,num,den,seed", [(3, 90, 100, 11), (5, 80, 100, 12), (3, 60, 100, 13), (1, 1, 1, 14)])
def test_join_against_brute_force(spark, words, num, den, seed):
    rows = cases.corpus(seed, 200)
    found = got(jaccardjoin.near_components(cases.frame(spark, rows), words, num, den), "doc_id", "n_shingles", "component_id")
    assert found == brute_join(rows, words, num, den)
    assert len({r[2] for r in found}) < len(found)


def test_join_of_one_large_near_group(spark):
    """Many variants of one text, of which neighbours link and far ones do not."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for j in range(i % 7):
            words[(i // 7 + 9 * j) % 60] = f"v{i}_{j}"
        rows.append(cases.row(i, " ".join(words)))
    found = got(jaccardjoin.near_components(cases.frame(spark, rows), 3, 80, 100), "doc_id", "n_shingles", "component_id")
    assert found == brute_join(rows, 3, 80, 100)


def test_join_in_many_blocks(spark, monkeypatch):
    """Groups that span components, cut into blocks of few documents: nothing is lost between blocks."""
    monkeypatch.setattr(jaccardjoin, "BLOCK_DOCS", 3)
    passage = [f"p{i}" for i in range(14)]
    rng = __import__("random").Random(8)
    texts = [" ".join(passage + [f"o{rng.randrange(6)}" for _ in range(4)]) for _ in range(150)]
    rows = [cases.row(i, t) for i, t in enumerate(texts)]
    found = got(jaccardjoin.near_components(cases.frame(spark, rows), 1, 80, 100), "doc_id", "n_shingles", "component_id")
    assert found == brute_join(rows, 1, 80, 100)


def test_join_of_odd_tables(spark):
    assert jaccardjoin.near_components(cases.empty(spark)).count() == 0
    found = jaccardjoin.near_components(cases.odd(spark)).collect()
    assert len(found) == 7 and all(r["component_id"] is None for r in found if r["doc_id"] is None)
    kept = jaccardjoin.one_of_each(cases.odd(spark))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "3", "None", "None"]


def test_sketches_bound_the_difference():
    """Whole sketches, of any two sizes, and folded ones."""
    rng = np.random.default_rng(2)
    for n, more in ((300, 9), (300, 400), (40, 3000), (1, 0), (5000, 5000)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 15 :], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
        x, y = jaccardjoin._folded([jaccardjoin.whole_sketch(a), jaccardjoin.whole_sketch(b)])
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count(x ^ y).sum() <= apart
        if 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)):
            assert jaccardjoin.may_link(jaccardjoin.whole_sketch(a), jaccardjoin.whole_sketch(b), len(a) + len(b), 80, 100)


def test_hubs_over_lots_and_batches():
    """However lots and record batches are cut, a key's documents are linked to its least one, and a hub whose others have
    not met the least one has a row of its own."""
    rng = np.random.default_rng(4)
    for seed in range(40):
        lots = [[(int(k), int(d)) for k, d in sorted({(rng.integers(0, 4), rng.integers(0, 40)) for _ in range(rng.integers(1, 12))})] for _ in range(5)]
        taken, sent = set(), []
        for lot in lots:
            lot = [(k, d) for k, d in lot if d not in taken]
            taken |= {d for _, d in lot}
            for k in {k for k, _ in lot}:
                docs = sorted(d for x, d in lot if x == k)
                sent += [(k, docs[0], d, d == docs[0] and len(docs) > 1) for d in docs]
        sent.sort(key=lambda r: (r[0], r[2]))
        cut = sorted({0, len(sent), *rng.integers(0, len(sent) + 1, 3).tolist()})
        batches = [jaccardjoin._met_rows(*(np.array([r[i] for r in sent[a:b]], bool if i == 3 else np.int64) for i in range(4))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        out = {(r["key"], r["hub"], r["doc"]) for b in jaccardjoin._met(iter(batches)) for r in b.to_pylist()}
        for k in {r[0] for r in sent}:
            docs, hubs = {r[2] for r in sent if r[0] == k}, {r[2] for r in sent if r[0] == k and r[1] == r[2]}
            least, met = min(docs), {(h, d) for x, h, d in out if x == k and h != d}
            assert met == {(least, h) for h in hubs - {least}} | {(r[1], r[2]) for r in sent if r[0] == k and r[1] != r[2]}
            lonely = len(hubs) > 1 and any(r[3] for r in sent if r[0] == k)
            assert ((k, least, least) in out) == lonely, (seed, k)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and found[200] == found[150] == 100 and found[300] == 300


# Decontamination

ITEM = "what is the name of the river that runs past the old stone market in the morning"


def brute_windows(rows, items, window=10):
    word = decontaminate.WORD
    cut = lambda t: word.findall(lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text, *_ in rows:
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    found |= ids
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out)


def test_decontamination_against_brute_force(spark):
    rows = cases.corpus(21, 60)
    rows += [cases.row(7000, f"Before. {ITEM.upper()}! After"), cases.row(7001, " ".join(ITEM.split()[:9])), cases.row(7002, "short-ITEM here"), cases.row(7003, ITEM + " " + ITEM)]
    items = [(1, ITEM), (2, "short item"), (10, ITEM + " and more of it"), (11, ""), (12, None), (2, "short item"), (13, " ".join(rows[0][1].split()[:25]) if rows[0][1] else "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 5):
        found = got(decontaminate.contamination(cases.frame(spark, rows), bench, 10, block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert found == brute_windows(rows, items)
    assert sum(r[5] for r in found) >= 3


def test_decontamination_cuts_spans(spark):
    clean = "a document about something else entirely, which has nothing of the test items in it at all " * 3
    docs = cases.frame(spark, [cases.row(1, clean + ITEM + ". " + clean), cases.row(2, ITEM), cases.row(3, clean), cases.row(4, None), cases.row(5, "")])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert sorted(kept) == [1, 3, 4, 5] and kept[3]["text"] == clean and kept[4]["text"] is None
    assert ITEM not in kept[1]["text"] and clean.strip() in kept[1]["text"] and kept[1]["key"] == "clash"


def test_decontamination_by_items_without_id(spark):
    """They hit and are cut; together they count as one item, which the list of ids leaves out."""
    other = "a second passage that has no id either and stands in one document of this little table"
    texts = [f"Before. {ITEM}. After", f"Before. {other}. {ITEM}. After", other, "nothing of them"]
    docs = cases.frame(spark, [cases.row(i, t) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(None, other), (None, ITEM), (7, ITEM)], "item_id long, text string")
    told = {r["doc_id"]: r for r in brute_told(texts, [(None, other), (None, ITEM), (7, ITEM)])}
    for block in (1_000_000, 5):
        found = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, 10, block).collect()}
        assert {d: (r["n_hit"], r["n_items"], r["items_sha256"]) for d, r in found.items()} == {d: (r["n_hit"], r["n_items"], r["items_sha256"]) for d, r in told.items()}
        kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, 10, 1, 0.95, block).collect()}
        assert sorted(kept) == [0, 1, 3] and not any(x in t for t in kept.values() for x in (ITEM, other)) and kept[3] == texts[3]


def brute_told(texts, items):
    """As SQL has it: windows of each item, null ids as one item without a place in the list."""
    rows = brute_windows([(i, t) for i, t in enumerate(texts)], [("null" if i is None else i, t) for i, t in items])
    lists = {d: sorted({str(i) for i, t in items if i is not None and brute_windows([(0, texts[d])], [(i, t)])[0][5]}) for d, *_ in rows}
    return [{"doc_id": d, "n_hit": hit, "n_items": n, "items_sha256": sha(",".join(lists[d]))} for d, _, hit, n, _, _ in rows]


def test_blocks_are_broadcast_in_turn(spark, monkeypatch):
    """No block of the benchmark is broadcast while another is."""
    from pyspark import SparkContext
    from pyspark.core.broadcast import Broadcast

    live, most, send, end = set(), [], SparkContext.broadcast, Broadcast.destroy

    def sent(self, value):
        made = send(self, value)
        live.add(id(made)), most.append(len(live))
        return made

    monkeypatch.setattr(SparkContext, "broadcast", sent)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (live.discard(id(self)), end(self, *a)))
    bench = spark.createDataFrame([(i, f"{ITEM} {i}") for i in range(4)], "item_id long, text string")
    found = decontaminate.contamination(cases.frame(spark, [cases.row(1, f"{ITEM} 2")]), bench, 10, 5).collect()
    assert found[0]["n_items"] == 4 and len(most) == 4 and max(most) == 1


def test_decontamination_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(cases.empty(spark), none).count() == 0
    found = decontaminate.contamination(cases.odd(spark), none).collect()
    assert len(found) == 7 and not any(r["contaminated"] for r in found)


def test_form_letters_leave_no_block(spark):
    """Letters that differ in one word link with none: however many there are, no pair of theirs leaves a block."""
    rng = __import__("random").Random(6)
    letter = lambda i: " ".join(f"w{j}" if j != 20 else f"name{i}x{rng.randrange(10**6)}" for j in range(41))
    rows = [cases.row(i, letter(i)) for i in range(700)]
    sets = jaccardjoin.kernel.shingles([r[1].encode() for r in rows], 3)
    block = pa.RecordBatch.from_pydict({
        "key": [1] * 700, "i": [0] * 700, "j": [0] * 700, "doc": list(range(700)), "component": list(range(700)), "n_shingles": [len(u) for u in sets], "piece": [0] * 700,
        "fold": [jaccardjoin.folded(jaccardjoin.whole_sketch(u)) for u in sets], "small": [u.tobytes() for u in sets],
    })
    for what in ("links", "docs"):
        assert sum(b.num_rows for b in jaccardjoin._across(90, 100, what)(iter([block]))) == 0
    found = got(jaccardjoin.near_components(cases.frame(spark, rows + [cases.row(900, rows[5][1] + " more")]), 3, 90, 100), "doc_id", "n_shingles", "component_id")
    assert {r[2]: r[0] for r in found if r[0] != r[2]} == {5: 900} and len(found) == 701


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (60, 100), (1, 1)])
def test_linked_sets_share_as_many_keys_as_they_need(num, den):
    """Whatever pair links, in some band of both the keys that they share are as many as either needs."""
    rng = np.random.default_rng(7)
    bands = jaccardjoin.Bands(num, den)
    for n in (1, 2, 5, 9, 20, 40, 64, 100, 300, 1000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
            most = (den - num) * 2 * n // (den + num)
            lost = int(rng.integers(0, most // 2 + 1))
            more = int(rng.integers(0, most - lost + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            if not jaccardjoin.linked(a, b, num, den):
                continue
            ok = False
            for band in set(bands.of(len(a))) & set(bands.of(len(b))):
                x, y = (set(jaccardjoin.part_keys(u, band, bands).tolist()) for u in (a, b))
                assert all(k & 511 == band for k in x | y)
                ok |= len(x & y) >= max(jaccardjoin.least_shared(a, band, bands), jaccardjoin.least_shared(b, band, bands)) and len(x & y) > 0
            assert ok, (n, lost, more)
