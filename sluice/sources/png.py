"""PNG in NumPy: pixels of PNG bytes, and PNG bytes of pixels.

Reading takes every bit depth, colour type and row filter of the format, interlaced or not, palettes and transparent colours, and checks every chunk's
CRC. Rows depend on the rows above and pixels on those to their left, so the filters are undone along anti-diagonals, all rows at once. Nothing is inflated beyond what the
header says, nor a header of more than `MOST_PIXELS` believed.

Defined cases: null content has null pixels and no error; content that is no whole PNG has null pixels and an error that names why.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

# The signature, samples of a pixel by colour type, the depths each type may have, and the passes of interlacing (x, y, step in x, step in y).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MOST_PIXELS = 1 << 26


class BadPng(ValueError):
    """Content that is no whole PNG."""


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left, the nearest to left + above - above left; ties go in this order."""
    p = a + b - c
    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes with their filters undone; step: bytes from a pixel to the next."""
    n, width = rows.shape
    if kinds.max(initial=0) > 4:
        raise BadPng("FILTER")
    if not np.isin(kinds, (3, 4)).any() and not ((kinds == 1).any() and (kinds == 2).any()):
        out = rows.copy()  # neither an average nor Paeth's: sums along rows or along columns do
        left = kinds == 1
        if left.any():
            pixels = out[left].reshape(left.sum(), -1, step)
            out[left] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(left.sum(), width)
        if (kinds == 2).any():
            begin = np.flatnonzero(kinds != 2)  # each run of rows that look up is a column sum from the row it begins at
            first = np.maximum.accumulate(np.where(kinds != 2, np.arange(n), -1))
            total = np.cumsum(out, axis=0, dtype=np.uint8)
            base = np.where((first > 0)[:, None], total[np.maximum(first - 1, 0)], 0).astype(np.uint8)
            out = total - base if len(begin) else total
        return out
    pixels = rows.reshape(n, -1, step)
    w = pixels.shape[1]
    out = np.zeros((n + 1, w + 1, step), np.int16)  # a row above and a pixel to the left, of zeros
    kind = kinds[:, None]
    for d in range(n + w - 1):
        y = np.arange(max(0, d - w + 1), min(n, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        k = kind[y]
        guess = np.where(k == 1, a, np.where(k == 2, b, np.where(k == 3, (a + b) >> 1, np.where(k == 4, paeth(a, b, c), 0))))
        out[y + 1, x + 1] = (pixels[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(n, width)


def filtered(rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of each row whose differences are least in sum, and the filtered rows."""
    n, width = rows.shape
    x = np.zeros((n + 1, width + step), np.int16)
    x[1:, step:] = rows
    now, a, b, c = x[1:, step:], x[1:, :width], x[:-1, step:], x[:-1, :width]
    every = np.stack([(now - g) & 255 for g in (np.zeros_like(now), a, b, (a + b) >> 1, paeth(a, b, c))]).astype(np.uint8)
    kinds = np.minimum(every, 256 - every.astype(np.int16)).sum(axis=2).argmin(axis=0)
    return kinds.astype(np.uint8), every[kinds, np.arange(n)]


def _samples(rows: np.ndarray, depth: int, count: int) -> np.ndarray:
    """Samples (rows, count) of packed rows."""
    if depth == 16:
        return rows.reshape(len(rows), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return rows.astype(np.uint16)
    bits = np.unpackbits(rows, axis=1)[:, : count * depth].reshape(len(rows), count, depth)
    return bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint16)


def decode(content: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    """RGBA (height, width, 4) of PNG bytes; of 16 bits the upper eight."""
    if content[:8] != SIGNATURE:
        raise BadPng("SIGNATURE")
    at, head, palette, clear, data = 8, None, None, None, []
    while True:
        if at + 12 > len(content):
            raise BadPng("TRUNCATED")
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(content):
            raise BadPng("TRUNCATED")
        if zlib.crc32(name + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise BadPng("CRC")
        at += 12 + size
        if head is None and name != b"IHDR":
            raise BadPng("HEADER")
        if name == b"IHDR":
            if size != 13:
                raise BadPng("HEADER")
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
        elif not name[0] & 32:
            raise BadPng("CHUNK")  # one that no reader may pass over
    width, height, depth, colour, method, filters, interlaced = head
    if not width or not height or colour not in SAMPLES or depth not in DEPTHS[colour] or method or filters or interlaced > 1:
        raise BadPng("HEADER")
    if width * height > most:
        raise BadPng("TOO_LARGE")
    n = SAMPLES[colour]
    passes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),)) if width > x and height > y]
    sizes = [h * (1 + -(-w * n * depth // 8)) for *_, w, h in passes]
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(data), sum(sizes) + 1)
    except zlib.error as e:
        raise BadPng("DEFLATE") from e
    if len(raw) != sum(sizes):
        raise BadPng("SIZE")
    pixels, begin = np.zeros((height, width, n), np.uint16), 0
    for (x, y, dx, dy, w, h), size in zip(passes, sizes, strict=True):
        lines = np.frombuffer(raw, np.uint8, size, begin).reshape(h, -1)
        begin += size
        plain = unfiltered(lines[:, 0], lines[:, 1:], max(1, n * depth // 8))
        pixels[y::dy, x::dx] = _samples(plain, depth, w * n).reshape(h, w, n)
    return _rgba(pixels, depth, colour, palette, clear)


def _rgba(pixels: np.ndarray, depth: int, colour: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    out = np.full((*pixels.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        if palette is None or len(palette) % 3 or not len(palette):
            raise BadPng("PALETTE")
        colours = np.full((len(palette) // 3, 4), 255, np.uint8)
        colours[:, :3] = palette.reshape(-1, 3)
        alpha = np.frombuffer(clear or b"", np.uint8)[: len(colours)]
        colours[: len(alpha), 3] = alpha
        if pixels.max() >= len(colours):
            raise BadPng("PALETTE")
        return colours[pixels[:, :, 0]]
    eight = (pixels >> 8 if depth == 16 else pixels * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out[:, :, :3] = eight[:, :, :1] if colour in (0, 4) else eight[:, :, :3]
    if colour in (4, 6):
        out[:, :, 3] = eight[:, :, -1]
    elif clear is not None and len(clear) >= 2 * pixels.shape[2]:
        key = np.frombuffer(clear, ">u2", pixels.shape[2])
        out[:, :, 3] = np.where((pixels == key).all(axis=2), 0, 255)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(pixels: np.ndarray) -> bytes:
    """PNG bytes of RGBA (height, width, 4): eight bits, each row by its best filter."""
    height, width, _ = pixels.shape
    kinds, rows = filtered(np.ascontiguousarray(pixels, np.uint8).reshape(height, width * 4), 4)
    body = zlib.compress(np.concatenate([kinds[:, None], rows], axis=1).tobytes(), 6)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


#: Pixels leave a task in lots of about so many bytes.
LOT_BYTES = 4 << 20


def lots(batch: pa.RecordBatch, content: str, rest: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """The columns `rest` with width, height, rgba and error: pixels are many times their PNG, so that few large images leave together, but many small ones."""
    types = (pa.int32(), pa.int32(), pa.binary(), pa.string())
    done, held, begin = [], 0, 0
    for i in range(batch.num_rows):
        value, told = batch.column(content)[i].as_py(), (None, None, None, None)
        if value is not None:
            try:
                p = decode(value, most)
                told = (p.shape[1], p.shape[0], p.tobytes(), None)
            except BadPng as e:
                told = (None, None, None, str(e))
        done.append(told)
        held += len(told[2] or b"")
        if held >= LOT_BYTES or i + 1 == batch.num_rows:
            lot = batch.slice(begin, i + 1 - begin)
            columns = [lot.column(c) for c in rest] + [pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "width", "height", "rgba", "error"])
            done, held, begin = [], 0, i + 1


def png_pixels(images: DataFrame, content: str = "content", most: int = MOST_PIXELS) -> DataFrame:
    """The images with width, height, rgba (bytes by row, four a pixel) and error of PNG bytes. Columns of these names give way."""
    names = ["width", "height", "rgba", "error"]
    rest = [c for c in images.columns if c not in names]
    rows = images.select(*rest, F.col(content).cast("binary").alias("png_content_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from lots(batch, "png_content_", rest, most)

    kinds = (IntegerType(), IntegerType(), BinaryType(), StringType())
    schema = StructType([*rows.drop("png_content_").schema.fields, *[StructField(n, t) for n, t in zip(names, kinds, strict=True)]])
    return rows.mapInArrow(run, schema)


def png_content(images: DataFrame, into: str = "png") -> DataFrame:
    """The images (width, height, rgba) with their PNG bytes; a null raster has null. A raster of the wrong size, or without a pixel, is an error."""
    rest = [c for c in images.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, rgba in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgba")), strict=True):
                if rgba is not None and (not w or not h or len(rgba) != w * h * 4):
                    raise ValueError("RASTER_SIZE")
                out.append(None if rgba is None else encode(np.frombuffer(rgba, np.uint8).reshape(h, w, 4)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, pa.binary())], [*rest, into])

    rows = images.select(*rest)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(into, BinaryType())]))
