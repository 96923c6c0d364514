"""Embedding near-dedup: random projections decoded to points of the E8 lattice, in several tables.

Only vectors of one label (not null) and one length are compared, by cosine in double precision; two link at `least` or more. Equal vectors are
one from the start, with their number. In each table a unit vector is projected to `blocks` times eight numbers, each eight decoded to the
nearest point of E8 (the nearer of the two nearest points of D8 and of D8 shifted by a half); these points are the vector's cell. It is also
sent to `probes` neighbouring cells, those whose points (one block moved by one of the 240 shortest vectors) are nearest to its projection.

In a cell all vectors meet its hub (the least that has the cell as its own), never every other: distinct pairs are verified and make
components. Cells whose vectors still span components are cut into blocks of at most `BLOCK` vectors, compared by matrix products; a
block sends no more links than join its components. Then links are counted: within a component, vectors at less than half the link angle from
its mean link with all others there (angles add up), so they are counted, not compared; the rest meet block by block, and blocks
send a number for each vector. So no pairs of a group are listed, and every link within a component is counted, also one no table has found.

Defined cases: a null vector, one of no or only zero components, or with null or non-finite ones, and any of a null label, link with nothing; rows that
share a vec_id, or have none, are vectors each by itself; a null vec_id is no component's name unless all are null, and such a row is not
kept; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel
from sluice.llm.common import free_shuffles, given_up, sized, small_lots, written
from sluice.llm.components import components

U = np.uint64
#: Vectors of one block of a cell or component.
BLOCK = 512
CELL = ["key", "i", "j"]


def short_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    pairs = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((2, -2), repeat=2)]
    halves = [s for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves, np.int64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    row = np.arange(len(x))
    odd = near.sum(axis=1).astype(np.int64) & 1 == 1
    near[row[odd], worst[odd]] += np.where(off[row[odd], worst[odd]] < 0, -1, 1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight numbers, doubled."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    pick = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(pick[:, None], half, whole)).astype(np.int64)


class Tables:
    """Projections and cell names of every table, alike in every process."""

    def __init__(self, tables: int, blocks: int, width: float, probes: int, seed: int = 12):
        self.tables, self.blocks, self.width, self.probes, self.seed = tables, blocks, width, probes, seed
        rng = np.random.Generator(np.random.PCG64(seed))
        self.names = rng.integers(1, 1 << 63, (tables, 8 * blocks), dtype=np.uint64) * U(2) + U(1)
        self.short = short_vectors()

    def projection(self, table: int, dim: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64([self.seed, table, dim])).standard_normal((dim, 8 * self.blocks)) / self.width

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The name of each unit vector's own cell, and of its neighbours: (vectors, 1 + probes)."""
        x = unit @ self.projection(table, unit.shape[1])
        blocks = [x[:, 8 * b : 8 * b + 8] for b in range(self.blocks)]
        points = [nearest_e8(b) for b in blocks]
        name = self.names[table].reshape(self.blocks, 8)
        own = sum(((p.astype(np.uint64) * name[b]).sum(axis=1, dtype=np.uint64) for b, p in enumerate(points)), np.zeros(len(x), np.uint64))
        if not self.probes:
            return own[:, None]
        moved = np.concatenate([(self.short.astype(np.uint64) * name[b]).sum(axis=1, dtype=np.uint64) for b in range(self.blocks)])
        # A move by m brings the point nearer by 2 r.m - m.m, and m.m is alike for all.
        gain = np.concatenate([(b - p / 2) @ (self.short.T / 2) for b, p in zip(blocks, points, strict=True)], axis=1)
        best = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
        return np.concatenate([own[:, None], own[:, None] + moved[best]], axis=1)

    def keys(self, unit: np.ndarray, group: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) keys of cells; group: a number for label and length."""
        with np.errstate(over="ignore"):
            return np.stack([kernel.mix(kernel.mix(self.cells(unit, t) + U(t + 1)) ^ kernel.mix(group)[:, None]) for t in range(self.tables)], axis=1)


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square is too large or small
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Written: vec (a number of the distinct vector), label, dim, embedding, n (rows that have it), id (the least vec_id). Odd vectors are left out."""
    ok = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter(ok)
    found = own.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("id"))
    return written(found.select(F.monotonically_increasing_id().alias("vec"), "label", F.size("embedding").alias("dim"), "embedding", "n", "id"), "vectors")


def _keyed(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                lot = batch.slice(at, 2048)
                vec, group, dims = lot.column("vec").to_numpy(), lot.column("group").to_numpy().view(np.uint64), lot.column("dim").to_numpy()
                vectors = _lists(lot.column("embedding"))
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    keys = tables.keys(_units([vectors[i] for i in own.tolist()]), group[own])
                    each = keys.shape[1] * keys.shape[2]
                    mine = np.tile(np.arange(keys.shape[2]) == 0, len(own) * keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(vec[own], each)), pa.array(mine)], ["key", "vec", "own"])

    return run


def cosines(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return (_units(a) * _units(b)).sum(axis=1)


def _verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _lists(batch.column("x")), _lists(batch.column("y"))
            same = [len(p) == len(q) for p, q in zip(x, y, strict=True)]
            keep = np.zeros(batch.num_rows, bool)
            for dim in {len(p) for p in x}:
                own = [i for i, p in enumerate(x) if len(p) == dim and same[i]]
                if own:
                    keep[own] = cosines([x[i] for i in own], [y[i] for i in own]) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    side = lambda k, v: vectors.select(F.col("vec").alias(k), F.col("label").alias(f"label_{v}"), F.col("embedding").alias(v)).hint("merge")
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").filter("label_x = label_y")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _blocks(least: float):
    """Rows sorted by block: links that join its components. Pairs of one piece meet in that piece's own block."""

    def told(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        vec, comp, piece = (np.array(c, np.int64) for c in zip(*[r[:3] for r in rows], strict=True))
        values, up_of = np.unique(comp, return_inverse=True)
        up = np.arange(len(values))
        unit = _units([r[3] for r in rows])
        across = piece.min() != piece.max()
        for i in range(len(rows)):
            own = up[up_of]
            near = (unit[i + 1 :] @ unit[i] >= least) & (own[i + 1 :] != own[i])
            if across:
                near &= piece[i + 1 :] != piece[i]
            for j in (np.flatnonzero(near) + i + 1).tolist():
                low, high = sorted((up[up_of[i]], up[up_of[j]]))
                if low != high:
                    up[up == high] = low
                    yield int(vec[i]), int(vec[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def out() -> pa.RecordBatch:
            by_dim: dict[tuple, list] = {}
            for r in held:  # names of cells are hashes: labels and lengths are compared, too
                by_dim.setdefault((r[4], len(r[3])), []).append(r)
            pairs = [p for rows in by_dim.values() if len(rows) > 1 for p in told(rows)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            vectors = _lists(batch.column("embedding"))
            for k, (key, i, j, vec, comp, piece, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*CELL, "vec", "component", "piece", "label")), strict=True)):
                if (key, i, j) != block:
                    yield out()
                    block, held = (key, i, j), []
                held.append((vec, comp, piece, vectors[k].copy(), label))
        yield out()

    return run


def _cut(rows: DataFrame, by: str, piece) -> DataFrame:
    """A row for each block (by, i, j) of pieces that a vector meets in; rows have `pieces`."""
    laid = rows.withColumn("piece", piece).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return laid.withColumn("i", F.least("piece", "with")).withColumn("j", F.greatest("piece", "with")).drop("with", "pieces")


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the unit vectors of each component in a batch."""
    for batch in batches:
        comp, dims, vectors = batch.column("component").to_numpy(), batch.column("dim").to_numpy(), _lists(batch.column("embedding"))
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            names, at = np.unique(comp[own], return_inverse=True)
            sums = np.zeros((len(names), dim))
            np.add.at(sums, at, _units([vectors[i] for i in own.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(sums), pa.list_(pa.float64()))], ["component", "sum"])


def _balls(least: float):
    """Whether a vector lies in its component's ball: less than half the link angle from the mean, with some room for rounding."""
    near = math.cos(math.acos(least) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _lists(batch.column("embedding")), _lists(batch.column("mean"))
            inside = np.zeros(batch.num_rows, bool)
            for dim in {len(p) for p in x}:
                own = [i for i, p in enumerate(x) if len(p) == dim and y[i].any()]
                if own:
                    inside[own] = cosines([x[i] for i in own], [y[i] for i in own]) > near
            yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(inside)], ["vec", "ball"])

    return run


def _counts(least: float):
    """Rows sorted by block: for each vector, the rows (n) of the others that it links with in this block."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        vec, n, piece, ball = (np.array(c, np.int64) for c in zip(*[r[:4] for r in rows], strict=True))
        unit = _units([r[4] for r in rows])
        near = unit @ unit.T >= least
        if piece.min() != piece.max():
            near &= piece[:, None] != piece
        near &= ~((ball[:, None] == 1) & (ball == 1))  # these are counted as one ball
        np.fill_diagonal(near, False)
        return pa.RecordBatch.from_arrays([pa.array(vec), pa.array(near @ n)], ["vec", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            vectors = _lists(batch.column("embedding"))
            for k, (key, i, j, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*CELL, "vec", "n", "piece", "ball")), strict=True)):
                if (key, i, j) != block:
                    if held:
                        yield told(held)
                    block, held = (key, i, j), []
                held.append((*row, vectors[k].copy()))
        if held:
            yield told(held)

    return run


def links_within(members: DataFrame, least: float) -> DataFrame:
    """vec and links: rows of the same component (vec, component, dim, embedding, n) that each vector links with, copies of itself left out."""
    sums = members.select("component", "dim", "embedding").mapInArrow(_means, "component long, sum array<double>")
    mean = sums.select("component", F.posexplode("sum")).groupBy("component", "pos").agg(F.sum("col").alias("col"))
    mean = written(mean.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda x: x["col"]).alias("mean")), "means")
    inside = written(members.join(mean, "component").select("vec", "embedding", "mean").mapInArrow(_balls(least), "vec long, ball boolean"), "balls")
    marked = written(members.join(inside, "vec").withColumn("ball", F.col("ball").cast("int")), "marked")
    of_ball = marked.filter("ball = 1").groupBy("component").agg(F.sum("n").alias("in_ball"))
    counted = marked.filter("ball = 1").join(of_ball, "component").select("vec", (F.col("in_ball") - F.col("n")).alias("links"))
    # Pieces hold ball or rest alone; blocks of two pieces of the ball need no comparison. A component that is all ball has no block.
    sizes = marked.groupBy("component").agg(F.ceil(F.sum("ball") / BLOCK).alias("balls"), F.ceil(F.sum(1 - F.col("ball")) / BLOCK).alias("rests")).filter("rests > 0")
    laid = marked.join(written(sizes.withColumn("pieces", F.col("balls") + F.col("rests")), "piece-sizes"), "component")
    piece = F.when(F.col("ball") == 1, F.pmod(F.xxhash64("vec"), F.greatest("balls", F.lit(1)))).otherwise(F.col("balls") + F.pmod(F.xxhash64("vec"), F.greatest("rests", F.lit(1))))
    cut = _cut(laid, "component", piece).filter("j >= balls").select(F.col("component").alias("key"), "i", "j", "vec", "n", "piece", "ball", "embedding")
    met = cut.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_counts(least), "vec long, links long")
    return counted.union(met).groupBy("vec").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, least: float = 0.98, tables: int = 7, blocks: int = 2, width: float = 1.4, probes: int = 4) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    width: projections are divided by it, so that cells of a larger width hold more vectors; further blocks make cells rarer. As measured on random
    pairs, a table finds 65 of 100 pairs of cosine 0.98, so seven find all but one in 1,500, and two unlike vectors share a cell of a table
    once in two million times.
    """
    small_lots(rows.sparkSession)
    if not 0 < least < 1:
        raise ValueError("the least cosine lies between 0 and 1")
    vectors = distinct_vectors(rows)
    named = vectors.select("vec", "dim", "embedding", F.xxhash64("label", "dim").alias("group"))
    keys = written(named.mapInArrow(_keyed(Tables(tables, blocks, width, probes)), "key long, vec long, own boolean"), "cells")
    hubs = keys.filter("own").groupBy("key").agg(F.min("vec").alias("hub"))
    shared = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("vec").alias("least")).filter("many > 1").join(hubs, "key").select("key", "hub")
    met = written(keys.select("key", "vec").join(written(shared, "hubs"), "key"), "met")
    given_up(keys)
    pairs = met.filter("vec != hub").select(F.least("vec", "hub").alias("a"), F.greatest("vec", "hub").alias("b")).distinct()
    links = written(_verified(written(pairs, "pairs"), vectors, least), "links")
    parts = written(components(links), "components")

    def labelled(frame: DataFrame) -> DataFrame:
        return frame.join(parts.withColumnRenamed("node", "vec"), "vec", "left").withColumn("component", F.coalesce("component", "vec"))

    # Cells of which, besides the hub, at least two vectors are of different components than each other or the hub.
    mixed = written(labelled(met.select("key", "vec").distinct()), "labelled")
    given_up(met)
    spans = mixed.groupBy("key").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).filter("many > 2 and low < high")
    mixed = mixed.join(written(spans.select("key", F.ceil(F.col("many") / BLOCK).alias("pieces")), "spanning"), "key")
    cut = _cut(mixed, "key", F.pmod(F.xxhash64("vec"), F.col("pieces")))
    laid = cut.join(vectors.select("vec", "label", "embedding").hint("merge"), "vec").repartition(*CELL).sortWithinPartitions(*CELL)
    more = written(laid.mapInArrow(_blocks(least), "a long, b long"), "late-links")
    free_shuffles(rows.sparkSession)
    if not more.isEmpty():
        parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    members = written(vectors.join(parts.withColumnRenamed("node", "vec"), "vec").select("vec", "component", "dim", "embedding", "n"), "members")
    links_of = written(links_within(members, least), "counts")
    own = vectors.select("vec", "label", "embedding", "n", "id")
    told = labelled(own).join(links_of, "vec", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0)))
    told = written(told.select("label", "embedding", "n_links", "component", "id"), "told")
    least_id = written(told.groupBy("component").agg(F.min("id").alias("component_id")), "least-ids")
    told = written(told.join(least_id, "component").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id"), "told")
    each = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = each.join(told, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
