"""PNG files of every kind, and areas of maps, against plain definitions and another reader."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import runs, spatial
from sluice.sources import png


def plain_filter(kind: int, rows: list[bytes], step: int) -> bytes:
    """Filtered rows by the format's definition, byte by byte; kind 5 takes each filter in turn."""
    out, before = b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        k, line = y % 5 if kind == 5 else kind, bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, nearest)[k]) % 256)
        out += bytes([k]) + bytes(line)
        before = row
    return out


def packed(samples: np.ndarray, depth: int) -> list[bytes]:
    """Rows of samples as bytes."""
    rows = []
    for line in samples.reshape(len(samples), -1).tolist():
        bits = "".join(f"{v:0{depth}b}" for v in line)
        bits += "0" * (-len(bits) % 8)
        rows.append(int(bits, 2).to_bytes(len(bits) // 8, "big"))
    return rows


def file(samples, depth, colour, kind, interlaced=False, extra=()):
    h, w, n = samples.shape
    step = max(1, n * depth // 8)
    parts = [samples[y::dy, x::dx] for x, y, dx, dy in png.PASSES] if interlaced else [samples]
    raw = b"".join(plain_filter(kind, packed(p, depth), step) for p in parts if p.size)
    body = zlib.compress(raw)
    chunk = lambda name, b: struct.pack(">I", len(b)) + name + b + struct.pack(">I", zlib.crc32(name + b))
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))
    return png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"k\0v") + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
def test_every_depth_and_filter(colour, depth):
    rng = np.random.default_rng(colour * 100 + depth)
    palette = rng.integers(0, 256, (1 << min(depth, 8)) * 3, np.uint8).tobytes()
    for h, w in ((1, 1), (7, 5), (5, 13), (11, 9)):
        samples = rng.integers(0, 1 << depth, (h, w, png.SAMPLES[colour]))
        if colour == 3:
            entry = np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples[:, :, 0]]
            wanted = np.concatenate([entry, np.full((h, w, 1), 255)], axis=2)
        else:
            eight = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
            grey = eight[:, :, :1].repeat(3, axis=2) if colour in (0, 4) else eight[:, :, :3]
            wanted = np.concatenate([grey, eight[:, :, -1:] if colour in (4, 6) else np.full((h, w, 1), 255)], axis=2)
        for kind in range(6):
            for interlaced in (False, True):
                got = png.decode(file(samples, depth, colour, kind, interlaced, [(b"PLTE", palette)] if colour == 3 else ()))
                assert (got == wanted).all(), (h, w, kind, interlaced)


def test_transparent_colours():
    samples = np.array([[[0], [1], [2]]])
    got = png.decode(file(samples, 2, 3, 0, extra=[(b"PLTE", bytes(range(9))), (b"tRNS", b"\x00\x80")]))
    assert got[0, :, 3].tolist() == [0, 128, 255]
    assert png.decode(file(samples, 2, 0, 0, extra=[(b"tRNS", b"\x00\x01")]))[0, :, 3].tolist() == [255, 0, 255]


def test_damaged_files():
    good = file(np.zeros((4, 4, 4), int), 8, 6, 4)
    small = file(np.zeros((4, 4, 4), int), 8, 6, 0)
    head = lambda w: png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, 4, 8, 6, 0, 0, 0))
    cases = {
        "SIGNATURE": b"GIF89a", "TRUNCATED": good[:-5], "CRC": good[:20] + b"\x09" + good[21:], "TOO_LARGE": png.SIGNATURE + head(1 << 30) + good[33:], "SIZE": png.SIGNATURE + head(5) + small[33:], "HEADER": png.SIGNATURE + head(0) + good[33:],
        "PALETTE": file(np.full((1, 1, 1), 3), 2, 3, 0, extra=[(b"PLTE", bytes(6))]), "FILTER": png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(b"\x05\x00")) + png._chunk(b"IEND", b""),
    }
    for error, content in cases.items():
        with pytest.raises(png.BadPng, match=error):
            png.decode(content)


def test_round_trip_by_another_reader(spark):
    rng = np.random.default_rng(4)
    smooth = (np.add.outer(np.arange(60), np.arange(80))[:, :, None] * np.array([1, 2, 3, 0]) % 256).astype(np.uint8)
    smooth[:, :, 3] = 255
    images = [smooth, rng.integers(0, 256, (9, 17, 4), np.uint8), np.zeros((1, 1, 4), np.uint8)]
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.tobytes()), "x") for i, p in enumerate(images)] + [(9, 2, 2, None, "x")]
    done = png.png_content(spark.createDataFrame(rows, "i int, width int, height int, rgba binary, png string"))
    files = {r["i"]: bytes(r["png"]) if r["png"] is not None else None for r in done.collect()}
    assert files[9] is None and len(files[0]) < smooth.size / 10
    read = spark._jvm.javax.imageio.ImageIO
    for i, p in enumerate(images):
        assert (png.decode(files[i]) == p).all()
        image = read.read(spark._jvm.java.io.ByteArrayInputStream(files[i]))
        h, w, _ = p.shape
        assert (image.getWidth(), image.getHeight()) == (w, h)
        for y, x in ((0, 0), (h - 1, w - 1), (h // 2, w // 3)):
            a, r, g, b = struct.pack(">I", image.getRGB(x, y) & 0xFFFFFFFF)
            assert (r, g, b, a) == tuple(p[y, x].tolist())
    back = png.png_pixels(done.withColumn("content", F.col("png"))).collect()
    assert {r["i"]: bytes(r["rgba"]) if r["rgba"] is not None else None for r in back} == {**{i: p.tobytes() for i, p in enumerate(images)}, 9: None}
    bad = png.png_pixels(spark.createDataFrame([(bytearray(b"no"),)], "content binary")).first()
    assert (bad["rgba"], bad["error"]) == (None, "SIGNATURE")
    with pytest.raises(Exception, match="RASTER_SIZE"):
        png.png_content(spark.createDataFrame([(3, 2, bytearray(4))], "width int, height int, rgba binary")).collect()


def test_crops_are_png(spark):
    images = spark.createDataFrame([("i", 4, 4, bytearray([127] * 64))], "image_id string, width int, height int, rgba binary")
    boxes = spark.createDataFrame([("i", 1.0, 1.0, 2.0, 2.0)], "image_id string, x double, y double, width double, height double")
    r = spatial.crop_records(spatial.masked(images, boxes)).select("*", F.unbase64("data_base64").alias("b"), F.sha2(F.unbase64("data_base64"), 256).alias("again")).first()
    pixels = png.decode(bytes(r["b"])).reshape(16, 4)
    assert r["mime_type"] == "image/png" and r["sha256"] == r["again"] and [i for i in range(16) if pixels[i].tolist() == [0, 0, 0, 255]] == [5, 6, 9, 10]


# Areas


def plain_areas(on):
    """First and last column and row, and cells, of each area, by search."""
    h, w = on.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if on[y, x] and (y, x) not in seen:
                todo, cells = [(y, x)], {(y, x)}
                while todo:
                    a, b = todo.pop()
                    for p in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                        if 0 <= p[0] < h and 0 <= p[1] < w and on[p] and p not in cells:
                            cells.add(p), todo.append(p)
                seen |= cells
                ys, xs = zip(*cells, strict=True)
                out.append((min(xs), min(ys), max(xs), max(ys), len(cells)))
    return sorted(out)


def test_areas_of_maps_and_tiles(spark):
    rng = np.random.default_rng(6)
    grids = [(rng.random((h, w)) < p).astype(float) for h, w, p in ((1, 1, 0.5), (20, 30, 0.45), (33, 17, 0.6), (25, 25, 0.1), (16, 16, 0.0), (12, 40, 1.0))]
    spiral = np.zeros((41, 41))
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = 1
        spiral[k + 2, k : k + 2] = 1
    grids.append(spiral)
    whole = spark.createDataFrame([(i, g.shape[1], g.shape[0], g.ravel().tolist(), "x") for i, g in enumerate(grids)], "image_id int, width int, height int, values array<double>, tile string")
    tiles = [(i, x, y, g[y : y + 7, x : x + 9].shape[1], g[y : y + 7, x : x + 9].shape[0], g[y : y + 7, x : x + 9].ravel().tolist()) for i, g in enumerate(grids) for y in range(0, g.shape[0], 7) for x in range(0, g.shape[1], 9)]
    cut = spark.createDataFrame(tiles, "image_id int, left int, top int, width int, height int, values array<double>")
    wanted = sorted((i, *a) for i, g in enumerate(grids) for a in plain_areas(g >= 0.3))
    for maps in (whole, cut):
        assert sorted(map(tuple, runs.map_areas(maps).select("image_id", "x0", "y0", "x1", "y1", "cells").collect())) == wanted
    boxes = lambda maps: sorted(map(tuple, runs.text_boxes(maps, most=5, scale_x=2.0).collect()))
    assert boxes(whole) == boxes(cut)
    for i, g in enumerate(grids):
        h, w = g.shape
        told = sorted((max(0, y0 - 1), 2.0 * max(0, x0 - 1), min(2.0 * w, 2.0 * (x1 - x0 + 3)), min(h, y1 - y0 + 3)) for x0, y0, x1, y1, _ in plain_areas(g >= 0.3) if (x1 - x0 + 1) * (y1 - y0 + 1) >= 8)
        got = sorted((r[2], r[1], r[3], r[4]) for r in boxes(whole) if r[0] == i)
        assert len(got) == min(5, len(told)) and all(t in [(float(a), b, c, float(d)) for a, b, c, d in told] for t in got)


def test_odd_maps(spark):
    schema = "image_id string, width int, height int, values array<double>"
    maps = spark.createDataFrame([(None, 3, 3, [None, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]), ("e", 0, 0, []), ("n", 0, 0, None)], schema)
    assert [tuple(r) for r in runs.map_areas(maps).collect()] == [(None, 0, 0, 2, 2, 7)]
    with pytest.raises(Exception, match="MAP_SIZE"):
        runs.map_areas(spark.createDataFrame([("a", 2, 2, [1.0])], schema)).collect()


def test_large_map_is_quick():
    import time

    begin = time.process_time()
    on = np.random.default_rng(1).random((2000, 2000)) < 0.55
    row, start, end, number = runs.areas(on)
    assert (end - start).sum() == on.sum() and time.process_time() - begin < 20
