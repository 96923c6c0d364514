"""N-gram Jaccard join: parity sketches, a pigeonhole join of their parts in each size band, and exact verification.

A document's set holds the hashes of its distinct n-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a
text of fewer words is one shingle; one without words has none and links with nothing. Two documents link when
den * |intersection| >= num * |union|. Then their symmetric difference is at most
D = (den - num) * (|A| + |B|) / (den + num).

The shingles of a document fall into P parts by hash range, and each part is the XOR of its shingles' hashes. Of P = D + 1 + slack parts
at least 1 + slack agree in two linked documents; a document with more empty parts than slack sends its empty parts
too, so one part that both send agrees. P depends on the size band; a band's largest partner lies in the next
band, so a document joins in its own band and, if a partner can lie there, in the next one.

Equal sets link at once and one document of each goes on. Its parts are plain rows (key, document). Where documents of
one task share a key, the least of them alone is shuffled by that key, so a key that a third of all documents hold is at most
one row for each lot of `LOT` bytes of text. In a group of equal keys every document meets the least one, never every other. A document
that shares fewer keys of a band than a link takes leaves the band's groups. Distinct
pairs whose whole-document bit sketches (one bit XOR-ed for each shingle, so that their Hamming distance is at most the
symmetric difference) differ in more bits than D go; what is then verified makes components. Groups whose other documents still span
components are cut into blocks of bounded size, in which only sketches of different components are compared; of near ones a block
sends no more than join its components, to be verified too. A block with one that fails is searched again, for the documents that are near
any of another component, and these by their sets. So no link between components is lost.

Defined cases: a null doc_id links with nothing and its component is null; rows that share a doc_id stand for their
least text; null texts have no words; other columns are kept by `one_of_each` and ignored elsewhere.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel
from sluice.llm.common import chunks, free_shuffles, given_up, keyed, sized, utf8, written
from sluice.llm.components import components

U = np.uint64
PAIR = "a long, b long"
SIZES = "doc_id long, n_shingles long, set_hash binary, fold binary, small binary, band int, need int, need_next int"
SIZES_NAMES = ["doc_id", "n_shingles", "set_hash", "fold", "small", "band", "need", "need_next"]
#: Keys tell their band in so many low bits.
BAND_BITS = 9
#: Sets of up to so many shingles go into blocks themselves.
SMALL = 64
MET = "key long, hub long, doc long, more boolean"
#: Bytes of text whose documents share keys before these are shuffled.
LOT = 4 << 20
BLOCK = ["key", "i", "j"]
#: Documents, and bytes of their sketches, of one block of a group that spans components.
BLOCK_DOCS, BLOCK_BYTES = 1024, 8 << 20


class Bands:
    """Size bands for a threshold num / den, and the number of sketch parts of each."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold lies in (0, 1]")
        self.num, self.den, self.low, self.high, self.parts, self.slack = num, den, [], [], [], []
        low = 1
        while low < 1 << 32:
            high = max(low * den // num, low * 21 // 20)  # near equality, or at it, bands still grow
            most = self.difference(2 * high)
            empty = math.exp(-(low + high) / 2 / (most + 1))
            slack = math.ceil(empty * most + 2 * math.sqrt(empty * most)) if most else 0
            self.low.append(low), self.high.append(high), self.parts.append(most + 1 + slack), self.slack.append(slack)
            low = high + 1
        if len(self.low) > 1 << BAND_BITS:
            raise ValueError("too many bands")

    def difference(self, total: int) -> int:
        """Largest symmetric difference of two linked sets of `total` elements together."""
        return (self.den - self.num) * total // (self.den + self.num)

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n elements joins."""
        b = bisect_right(self.low, n) - 1
        return [b, b + 1] if b + 1 < len(self.low) and n * self.den // self.num >= self.low[b + 1] else [b]


def part_keys(u: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """The join keys of a sorted set in a band: band, part and XOR of the part's hashes folded into one number."""
    p = bands.parts[band]
    bounds = np.searchsorted(u, kernel.even_bounds(p))
    total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(kernel.mix(u ^ U(0x5851F42D4C957F2D)))])
    ends = np.append(bounds[1:], len(u))
    keys = kernel.mix(kernel.mix((total[ends] ^ total[bounds]) + U(band + 1)) + np.arange(p, dtype=np.uint64)) >> U(BAND_BITS) << U(BAND_BITS) | U(band)
    full = ends > bounds
    return keys if p - int(full.sum()) > bands.slack[band] else keys[full]


def least_shared(u: np.ndarray, band: int, bands: Bands) -> int:
    """How many keys of a band a set shares at least with any that it links with there: of the 1 + slack parts that agree, those that are not empty. A set that sends its
    empty parts may share one alone."""
    empty = int((np.diff(np.append(np.searchsorted(u, kernel.even_bounds(bands.parts[band])), len(u))) == 0).sum())
    return 1 + bands.slack[band] - empty if empty <= bands.slack[band] else 1


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def whole_sketch(u: np.ndarray) -> bytes:
    """Bits, at least two for each shingle and a power of two in all, XOR-ed by hash. Halves XOR-ed give the next smaller sketch."""
    bits = max(512, 1 << (2 * len(u) - 1).bit_length()) if len(u) else 512
    odd = np.bincount((kernel.mix(u ^ U(0x2545F4914F6CDD1D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(sketch: bytes) -> bytes:
    """Half the bits, a bit for each shingle still; 512 bits stay."""
    x = np.frombuffer(sketch, np.uint64)
    return sketch if len(x) <= 8 else (x[: len(x) // 2] ^ x[len(x) // 2 :]).tobytes()


def may_link(a: bytes, b: bytes, total: int, num: int, den: int) -> bool:
    """Whether the Hamming distance of two sketches allows a link of sets of `total` elements together."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (den + num) <= (den - num) * total


def _set_hash(u: np.ndarray) -> bytes:
    return np.array([u.sum(dtype=np.uint64), np.bitwise_xor.reduce(kernel.mix(u)) if len(u) else 0], np.uint64).tobytes()


def _sizes(words: int, bands: Bands):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(parts):
            sets = kernel.shingles(utf8(batch.column("text")), words)
            columns = [pa.array([len(u) for u in sets], pa.int64()), *[pa.array(x, pa.binary()) for x in ([_set_hash(u) for u in sets], [folded(whole_sketch(u)) for u in sets], [u.tobytes() if len(u) <= SMALL else None for u in sets])]]
            needs = [[least_shared(u, b, bands) for b in bands.of(len(u))] + [None] if len(u) else [None, None] for u in sets]
            columns += [pa.array(x, pa.int32()) for x in ([bands.of(len(u))[0] if len(u) else None for u in sets], [n[0] for n in needs], [n[1] for n in needs])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], SIZES_NAMES)

    return run


def _met_rows(key: np.ndarray, hub: np.ndarray, doc: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(hub), pa.array(doc), pa.array(more)], ["key", "hub", "doc", "more"])


def _sent(words: int, bands: Bands):
    """The part keys of each lot of documents. A key's least document of the lot is its own hub (`more`: not the only one);
    the others name that hub."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(parts, LOT):
            texts, sets = utf8(batch.column("text")), []
            for i in range(0, len(texts), 500):
                sets += kernel.shingles(texts[i : i + 500], words)
            keys = [np.unique(np.concatenate([part_keys(u, b, bands) for b in bands.of(len(u))])) if len(u) else u for u in sets]
            if not sum(map(len, keys)):
                continue
            key = np.concatenate(keys).view(np.int64)
            doc = np.repeat(batch.column("doc_id").to_numpy(), [len(k) for k in keys])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.append(begin, len(key)))
            more = np.zeros(len(key), bool)
            more[begin] = times > 1
            hub = np.repeat(doc[begin], times)
            for i in range(0, len(key), 1 << 17):
                yield _met_rows(key[i : i + (1 << 17)], hub[i : i + (1 << 17)], doc[i : i + (1 << 17)], more[i : i + (1 << 17)])

    return run


def _met(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and document. Rows that name a hub pass. Of the hubs of a key, the least is the hub of the others;
    it has a row of its own if one of them is not the only one of its lot."""
    last = least = None
    told = np.zeros(2, bool)  # of the key before: whether a hub has others, and whether there are other hubs
    for batch in parts:
        key, hub, doc, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "hub", "doc", "more"))
        local = hub != doc
        if local.any():
            yield _met_rows(key[local], hub[local], doc[local], more[local])
            key, doc, more = key[~local], doc[~local], more[~local]
        if not len(key):
            continue
        fresh = np.concatenate([[key[0] != last], key[1:] != key[:-1]])  # None differs from all
        heads = doc[fresh]
        group = np.cumsum(fresh)  # 0: the key before goes on
        top = np.concatenate([[0 if least is None else least], heads])[group]
        other = doc != top
        seen = np.zeros((2, len(heads) + 1), bool)
        seen[:, 0] = told
        np.logical_or.at(seen[0], group, more)
        np.logical_or.at(seen[1], group, other)
        alone = np.searchsorted(group, np.intersect1d(np.flatnonzero(seen.all(axis=0)), group))
        yield _met_rows(np.concatenate([key[other], key[alone]]), np.concatenate([top[other], top[alone]]), np.concatenate([doc[other], top[alone]]), np.concatenate([more[other], more[alone]]))
        last, least, told = key[-1], top[-1], seen[:, -1]


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of sets of like sizes, brought to the shortest one's bits."""
    words = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), words), np.uint64)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0)
    return out


def _across(num: int, den: int, what: str):
    """Rows sorted by block; pairs of different components near enough by size and Hamming distance are sought. what is `links`: a pair is told
    if its components are not yet joined in the block, so that there are fewer pairs than documents; `docs`: each document of a pair is told
    (as a and b), once; or `exact`: as links, but rows have their sets and pairs are verified here. Pairs of small sets, which rows always have, are verified
    everywhere, so that no false one leaves. A block holds the documents of one
    group, or of one pair of its pieces: then those of the same piece meet elsewhere."""
    def near(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        docs, comp, size, piece = (np.array(c, np.int64) for c in zip(*[r[:4] for r in rows], strict=True))
        held_set = lambda i: rows[i][-1]
        verified = lambda a, b: linked(np.frombuffer(held_set(a), np.uint64), np.frombuffer(held_set(b), np.uint64), num, den)
        sketch = _folded([r[4] for r in rows])
        across = piece.min() != piece.max()
        values, comp, counts = np.unique(comp, return_inverse=True, return_counts=True)
        up = np.arange(len(values))
        outside = np.flatnonzero(comp != np.argmax(counts))  # every pair between components has one of these
        step = max(1, (1 << 21) // sketch.size)
        named = np.zeros(len(docs), bool)
        for x in range(0, len(outside), step):
            o = outside[x : x + step]
            own = up[comp]
            ok = (own[o][:, None] != own[None]) & (den * np.minimum(size[o][:, None], size[None]) >= num * np.maximum(size[o][:, None], size[None]))
            if across:
                ok &= piece[o][:, None] != piece[None]
            i, j = np.nonzero(ok)
            for y in range(0, len(i), 1 << 14):
                p, q = o[i[y : y + (1 << 14)]], j[y : y + (1 << 14)]
                spare = (den - num) * (size[p] + size[q]) - np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64) * (den + num)
                hit = np.flatnonzero(spare >= 0)
                if what == "docs":
                    hit = hit[[held_set(a) is None or held_set(b) is None or verified(a, b) for a, b in zip(p[hit].tolist(), q[hit].tolist(), strict=True)]] if len(hit) else hit
                    named[p[hit]] = named[q[hit]] = True
                    continue
                for k in hit[np.argsort(-spare[hit], kind="stable")].tolist():
                    a, b = p[k], q[k]
                    low, high = sorted((up[comp[a]], up[comp[b]]))
                    if low != high and (held_set(a) is None or held_set(b) is None or verified(a, b)):
                        up[up == high] = low
                        yield min(int(docs[a]), int(docs[b])), max(int(docs[a]), int(docs[b]))
        yield from ((d, d) for d in docs[named].tolist())

    names = [*BLOCK, "doc", "component", "n_shingles", "piece", "fold", "shingles" if what == "exact" else "small"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def told() -> pa.RecordBatch:
            pairs = list(near(held)) if len(held) > 1 else []
            ends = [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*[pa.array([x] * len(pairs), pa.int64()) for x in block or (0, 0, 0)], *ends], [*BLOCK, "a", "b"])

        for batch in parts:
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (key, i, j) != block:
                    yield told()
                    block, held = (key, i, j), []
                held.append(tuple(row))
        yield told()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets link."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(parts, column="set_a"):
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, PAIR)


def _sifted(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link. Sketches and sets grow with the documents, so these joins are alike at every size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(parts, column="sketch_a"):
            cols = [batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "total")]
            keep = [may_link(x, y, t, num, den) for x, y, t in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("fold").alias(f"sketch_{x}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return both.select("a", "b", "sketch_a", "sketch_b", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(run, PAIR)


def near_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark, bands = docs.sparkSession, Bands(num, den)
    rows = keyed(docs, "text")
    sizes = written(rows.mapInArrow(_sizes(words, bands), SIZES), "sizes")
    told = sizes.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("ids")).collect()[0]
    rows = rows.filter("doc_id is not null")
    if told["n"] > told["ids"]:  # rows that share an id stand for their least text
        rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        alone = written(rows.mapInArrow(_sizes(words, bands), SIZES), "sizes")
    else:
        alone = sizes.filter("doc_id is not null")

    # Equal sets link with the least of them, which alone goes on. The groups are written, so that Spark can split the join of a large one.
    equal = alone.filter("n_shingles > 0")
    copies = written(equal.groupBy("set_hash").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "equal")
    copy = written(equal.select("set_hash", F.col("doc_id").alias("b")).join(copies, "set_hash").filter("a != b").select("a", "b"), "copies")
    one = rows.join(sized(written(copy.select(F.col("b").alias("doc_id")), "copies-ids")), "doc_id", "left_anti")

    at = F.when(F.col("hub") == F.col("doc"), F.col("key")).otherwise(F.xxhash64("key", "doc"))  # rows that name a hub need no meeting
    met = written(one.mapInArrow(_sent(words, bands), MET).repartition(at).sortWithinPartitions("key", "doc").mapInArrow(_met, MET).select("key", "hub", "doc"), "met")
    free_shuffles(spark)
    # Documents that share a key by chance share few: those that share fewer keys of a band than any link takes leave it.
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1).cast("int")
    shared = met.filter("hub != doc").select(F.col("doc").alias("d"), "key").union(met.filter("hub != doc").select("hub", "key")).distinct().groupBy("d", band.alias("band")).agg(F.count("*").alias("many"))
    own = alone.select(F.col("doc_id").alias("d"), F.explode(F.array(F.struct("band", "need"), F.struct((F.col("band") + 1).alias("band"), F.col("need_next").alias("need")))).alias("b")).select("d", "b.band", "b.need")
    live = sized(written(shared.join(own, ["d", "band"]).filter("many >= need").select("d", "band"), "live"))
    kept = met.withColumn("band", band).join(live.withColumnRenamed("d", "doc"), ["doc", "band"])
    met, given = written(kept.select("key", "hub", "doc", "band"), "met-live"), met
    given_up(given)
    pairs = met.filter("hub != doc").join(live.withColumnRenamed("d", "hub"), ["hub", "band"])
    pairs = written(pairs.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    near = written(_sifted(pairs, alone, num, den), "near")

    def as_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(parts):
            sets = kernel.shingles(utf8(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([u.tobytes() for u in sets], pa.binary())], ["doc_id", "shingles"])

    def links_of(near: DataFrame) -> DataFrame:
        named = written(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "named")
        sets = written(rows.join(sized(named), "doc_id", "left_semi").mapInArrow(as_sets, "doc_id long, shingles binary"), "sets")
        links = written(_verified(near, sets, num, den), "links")
        given_up(sets)
        return links

    links = links_of(near).union(copy)
    parts = written(components(links), "components")
    given_up(pairs), given_up(near)

    # What is left: groups whose documents, but for those that have met all others, span components.
    label = parts.select(F.col("node").alias("doc"), "component")
    labelled = written(met.select("key", "doc").join(label, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component")), "labelled")
    given_up(met)
    # Documents that share one part mostly share others: of keys with the same documents (told by their number and two sums of hashes) one is enough.
    told = [F.count("*").alias("many"), *[F.sum(F.xxhash64("doc", F.lit(seed)).cast("decimal(38,0)")).alias(f"sum{seed}") for seed in (1, 2)]]
    spans = labelled.distinct().groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *told).filter("low < high")
    groups = written(spans.groupBy("many", "sum1", "sum2").agg(F.min("key").alias("key")).select("key"), "spanning")
    mixed = written(labelled.join(groups, "key").distinct(), "mixed")
    given_up(labelled)
    size = alone.select(F.col("doc_id").alias("doc"), "n_shingles", (F.octet_length("fold") + F.coalesce(F.octet_length("small"), F.lit(0))).alias("bytes"))
    mixed = written(mixed.join(size, "doc"), "unsettled")
    pieces = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("long").alias("pieces")
    cut = mixed.join(written(mixed.groupBy("key").agg(pieces), "pieces"), "key").withColumn("piece", F.pmod(F.xxhash64("doc"), F.col("pieces")))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).withColumn("i", F.least("piece", "with")).withColumn("j", F.greatest("piece", "with")).drop("with", "pieces", "bytes")
    fold = alone.select(F.col("doc_id").alias("doc"), "fold", "small")

    def searched(rows: DataFrame, what: str) -> DataFrame:
        laid = rows.join(fold.hint("merge"), "doc").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
        return written(laid.mapInArrow(_across(num, den, what), "key long, i long, j long, a long, b long"), f"blocks-{what}")

    rest = searched(cut, "links")
    free_shuffles(spark)
    late = links_of(written(rest.select("a", "b").distinct(), "late"))
    more = lambda links: components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    if not late.isEmpty():
        parts = written(more(late), "components")
    # Blocks of which a near pair was no link are searched again: for the documents near others, then by the sets of these.
    missed = written(rest.join(late, ["a", "b"], "left_anti").select(*BLOCK).distinct(), "missed")
    if not missed.isEmpty():
        again = cut.join(missed, BLOCK).drop("component").join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        again = written(again, "again")
        near = written(again.join(searched(again, "docs").select(*BLOCK, F.col("a").alias("doc")), [*BLOCK, "doc"]), "near-docs")
        named = written(near.select(F.col("doc").alias("doc_id")).distinct(), "named")
        sets = written(rows.join(sized(named), "doc_id", "left_semi").mapInArrow(as_sets, "doc_id long, shingles binary"), "sets")
        late = searched(near.join(sets.withColumnRenamed("doc_id", "doc"), "doc"), "exact").select("a", "b")
        if not late.isEmpty():
            parts = more(late)
    own = sizes.select("doc_id", "n_shingles").join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return own.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents of which no linked one has a smaller doc_id, all columns as they were."""
    gone = written(near_components(docs, words, num, den).filter("doc_id != component_id").select(F.col("doc_id").alias("gone_")), "gone")
    return docs.join(sized(gone), docs["doc_id"].cast("long") == F.col("gone_"), "left_anti")
