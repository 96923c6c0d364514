"""Connected areas of probability maps by runs of rows, also of maps that come in tiles.

A row of cells at or above a level is a few runs; runs of neighbouring rows that share a column are joined, all of a map at once, by union of
sorted intervals and pointer jumping in NumPy. A map too large for a task comes as tiles: each tile finds its own areas, and only the cells along
its border meet those of its neighbours, by a join on their place; areas that touch across borders are then one.

Defined cases: values that are null or not a number are below the level; a map without cells has no box; a map of the wrong number of values is an error; columns besides
those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end (exclusive) of each run of true cells, row by row."""
    edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, begin, end


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components under links a, b."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return up
        np.minimum.at(up, x, low)
        np.minimum.at(up, y, low)
        while (up[up] != up).any():
            up = up[up]


def areas(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, begin, end) and the number of each one's 4-connected area, in order of its first run."""
    row, begin, end = row_runs(on)
    if not len(row):
        return row, begin, end, row
    # In the order of (row, column), a run touches those of the next row that end after its beginning and begin before its end.
    width = on.shape[1] + 1
    first = np.searchsorted(row * width + end, (row + 1) * width + begin, side="right")
    last = np.searchsorted(row * width + begin, (row + 1) * width + end, side="left")
    times = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(row)), times)
    b = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    _, number = np.unique(joined(len(row), a, b), return_inverse=True)
    return row, begin, end, number


def area_boxes(row: np.ndarray, begin: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(areas, 5): first column, first row, last column, last row, cells."""
    n = int(number.max()) + 1 if len(number) else 0
    out = np.zeros((n, 5), np.int64)
    out[:, :2] = 1 << 62
    np.minimum.at(out[:, 0], number, begin)
    np.minimum.at(out[:, 1], number, row)
    np.maximum.at(out[:, 2], number, end - 1)
    np.maximum.at(out[:, 3], number, row)
    np.add.at(out[:, 4], number, end - begin)
    return out


def _level(values: list, width: int, height: int, least: float) -> np.ndarray:
    v = np.array(values if values is not None else [], np.float64)  # null is not a number
    if len(v) != (width or 0) * (height or 0):
        raise ValueError("MAP_SIZE")
    return (v >= least).reshape(height or 0, width or 0)


def _tile_areas(least: float):
    names = ["image_id", "tile", "area", "x0", "y0", "x1", "y1", "cells", "edge_x", "edge_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = batch.column("image_id")
            for i, (tile, left, top, w, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "left", "top", "width", "height")), strict=True)):
                row, begin, end, number = areas(_level(batch.column("values_")[i].as_py(), w, h, least))
                boxes = area_boxes(row, begin, end, number) + np.array([left, top, left, top, 0])
                # Cells on the tile's rim: whole first and last rows, first and last columns of the others.
                rim: dict[int, set[tuple[int, int]]] = {}
                for y, a, b, k in zip(row.tolist(), begin.tolist(), end.tolist(), number.tolist(), strict=True):
                    xs = range(a, b) if y in (0, h - 1) else [x for x in ((0,) if a == 0 else ()) + ((w - 1,) if b == w else ())]
                    if xs:
                        rim.setdefault(k, set()).update((left + x, top + y) for x in xs)
                own = [(k, *box, *zip(*sorted(rim[k]), strict=True)) if k in rim else (k, *box, (), ()) for k, box in enumerate(boxes.tolist())]
                columns = list(zip(*own, strict=True)) if own else [()] * 8
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
                arrays = [pa.array([list(v) for v in c] if t == kinds[-1] else list(c), t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([image.take(pa.array([i] * len(own), pa.int64())), pa.array([tile] * len(own), pa.int64()), *arrays], names)

    return run


def map_areas(maps: DataFrame, least: float = 0.3) -> DataFrame:
    """image_id, x0, y0, x1, y1 (first and last column and row) and cells of every 4-connected area at `least` or more. maps: image_id, width, height, values by
    row; tiles of one map also left and top, the place of their first cell. Tiles must not overlap."""
    tiled = "left" in maps.columns
    kind = maps.schema["image_id"].dataType.simpleString()
    place = [F.col(x).cast("long").alias(x) if tiled else F.lit(0).cast("long").alias(x) for x in ("left", "top")]
    rows = maps.select("image_id", *place, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("values").alias("values_"))
    rows = rows.withColumn("tile", F.xxhash64("left", "top"))
    schema = f"image_id {kind}, tile long, area long, x0 long, y0 long, x1 long, y1 long, cells long, edge_x array<long>, edge_y array<long>"
    found = rows.select("image_id", "tile", "left", "top", "width", "height", "values_").mapInArrow(_tile_areas(least), schema)
    if not tiled:
        return found.select("image_id", "x0", "y0", "x1", "y1", "cells")
    found = found.persist()
    rim = found.select("image_id", "tile", "area", F.explode(F.arrays_zip("edge_x", "edge_y")).alias("e")).select("image_id", "tile", "area", F.col("e.edge_x").alias("x"), F.col("e.edge_y").alias("y"))
    other = rim.select(F.col("image_id").alias("i2"), F.col("tile").alias("tile2"), F.col("area").alias("area2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    beside = rim.select("image_id", "tile", "area", F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))).alias("n"))
    met = beside.join(other, F.col("image_id").eqNullSafe(F.col("i2")) & (F.col("n.x") == F.col("x2")) & (F.col("n.y") == F.col("y2")) & (F.col("tile") != F.col("tile2")))
    pairs = met.select("image_id", F.struct("tile", "area").alias("a"), F.struct(F.col("tile2").alias("tile"), F.col("area2").alias("area")).alias("b")).distinct()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of one image after the other, its areas' least partner each."""
        image, links = None, []

        def told() -> pa.RecordBatch:
            nodes = sorted({n for p in links for n in p})
            at = {n: i for i, n in enumerate(nodes)}
            up = joined(len(nodes), np.array([at[a] for a, _ in links], np.int64), np.array([at[b] for _, b in links], np.int64))
            columns = [pa.array([image] * len(nodes), image_type), *[pa.array([n[k] for n in nodes], pa.int64()) for k in (0, 1)], *[pa.array([nodes[u][k] for u in up], pa.int64()) for k in (0, 1)]]
            return pa.RecordBatch.from_arrays(columns, ["i3", "t3", "a3", "tile_of", "area_of"])

        image_type = None
        for batch in batches:
            image_type = batch.column("image_id").type
            for own, a, b in zip(*(batch.column(c).to_pylist() for c in ("image_id", "a", "b")), strict=True):
                if links and own != image:
                    yield told()
                    links = []
                image = own
                links.append(((a["tile"], a["area"]), (b["tile"], b["area"])))
        if links:
            yield told()

    of = pairs.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(unite, f"i3 {kind}, t3 long, a3 long, tile_of long, area_of long")
    whole = found.join(of, F.col("image_id").eqNullSafe(F.col("i3")) & (F.col("tile") == F.col("t3")) & (F.col("area") == F.col("a3")), "left")
    key = [F.coalesce("tile_of", "tile").alias("t"), F.coalesce("area_of", "area").alias("a")]
    return whole.groupBy("image_id", *key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("cells").alias("cells")).drop("t", "a")


def text_boxes(maps: DataFrame, least: float = 0.3, min_area: int = 8, pad: int = 1, most: int = 200, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """Boxes (image_id, x, y, width, height) of 4-connected areas of a probability map (image_id, width, height, values; tiles: left, top) at `least` or more whose
    bounding box has at least `min_area` cells, padded and scaled, by y then x, at most `most` an image. A box is no wider or higher than its image."""
    # A tiled image ends where its tiles end.
    far = lambda size, at: F.max(F.col(size) + (F.col(at) if "left" in maps.columns else F.lit(0)))
    sizes = maps.groupBy("image_id").agg(far("width", "left").alias("image_w"), far("height", "top").alias("image_h")).withColumnRenamed("image_id", "image_")
    found = map_areas(maps, least).join(sizes, F.col("image_id").eqNullSafe(F.col("image_"))).withColumn("w", F.col("x1") - F.col("x0") + 1).withColumn("h", F.col("y1") - F.col("y0") + 1).filter(F.col("w") * F.col("h") >= min_area)
    box = found.select(
        "image_id", F.greatest(F.lit(0.0), (F.col("x0") - pad) * F.lit(scale_x)).alias("x"), F.greatest(F.lit(0.0), (F.col("y0") - pad) * F.lit(scale_y)).alias("y"),
        F.least(F.col("image_w") * F.lit(scale_x), (F.col("w") + 2 * pad) * F.lit(scale_x)).alias("width"), F.least(F.col("image_h") * F.lit(scale_y), (F.col("h") + 2 * pad) * F.lit(scale_y)).alias("height"),
    )
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", "height", "width"))
    return box.withColumn("n_", n).filter(F.col("n_") <= most).drop("n_")
