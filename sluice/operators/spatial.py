"""Boxes: overlap measures, fusion of page elements with pixel records, suppression and merging of detections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    side = lambda p, s: F.greatest(zero, F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("x", "width") * side("y", "height")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 for an empty box."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(intersection(a, b) / smaller)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, the union counted as 1 at least."""
    common = intersection(a, b)
    return common / F.greatest(F.lit(1.0), area(a) + area(b) - common)


def clipped(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels that a box touches inside an image: left, top, right, bottom."""
    return F.struct(
        F.greatest(F.lit(0), F.floor(b["x"])).cast("int").alias("left"), F.greatest(F.lit(0), F.floor(b["y"])).cast("int").alias("top"),
        F.least(width, F.ceil(b["x"] + b["width"])).cast("int").alias("right"), F.least(height, F.ceil(b["y"] + b["height"])).cast("int").alias("bottom"),
    )


def rescaled(b: Column, sx: Column, sy: Column, dx: Column | float = 0.0, dy: Column | float = 0.0, pad: float = 0.0) -> Column:
    """A box in another frame: scaled, shifted and padded (raster, viewport and crop coordinates)."""
    dx, dy = F.lit(dx) if isinstance(dx, float) else dx, F.lit(dy) if isinstance(dy, float) else dy
    return F.struct((b["x"] * sx + dx - pad).alias("x"), (b["y"] * sy + dy - pad).alias("y"), (b["width"] * sx + 2 * pad).alias("width"), (b["height"] * sy + 2 * pad).alias("height"))


def _name() -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in ("text", "label", "control_value")])), r"[^\p{L}\p{N}]+", " "))


def fuse(dom: DataFrame, pixels: DataFrame, least: float = 0.3, most: int = 2000) -> DataFrame:
    """Page elements with the sources of pixel records that lie on them (three at most), then the records that lie on
    none; at most `most` rows a snapshot, page elements first, each by dom_index.

    A record of VISION fits an image, others fit by name containment. A snapshot has 2000 elements at most, so that the join by
    snapshot, with the overlap as condition, stays small in each.
    """
    left = dom.withColumn("name_", _name()).select("snapshot_id", c("id").alias("dom_id"), "role", "tag", "name_", c("bbox").alias("dom_box"))
    right = pixels.withColumn("pixel_name_", _name()).select("snapshot_id", c("id").alias("pixel_id"), c("sources").alias("pixel_sources"), "pixel_name_", c("bbox").alias("pixel_box"), c("dom_index").alias("pixel_index"))
    named = (c("name_") != "") & (c("pixel_name_") != "") & (c("name_").contains(c("pixel_name_")) | c("pixel_name_").contains(c("name_")))
    fits = F.when(F.array_contains("pixel_sources", "VISION"), (c("role") == "img") | (c("tag") == "img")).otherwise(named)
    pairs = left.join(right, "snapshot_id").filter((overlap_ratio(c("dom_box"), c("pixel_box")) >= least) & fits).select("snapshot_id", "dom_id", "pixel_id", "pixel_sources", "pixel_index").distinct()
    added = pairs.groupBy("snapshot_id", c("dom_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pixel_index", "pixel_id", "pixel_sources"))), lambda x: x["pixel_sources"])).alias("added_"))
    own = F.coalesce("sources", F.array(F.lit("DOM")))
    fused = dom.join(added, ["snapshot_id", "id"], "left").withColumn("sources", F.when(c("added_").isNull(), own).otherwise(F.slice(F.array_distinct(F.concat(own, "added_")), 1, 3))).drop("added_").withColumn("rank_", F.lit(0))
    alone = pixels.join(pairs.select("snapshot_id", c("pixel_id").alias("id")).distinct(), ["snapshot_id", "id"], "left_anti").withColumn("rank_", F.lit(1))
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("rank_", "dom_index", "id"))
    return fused.unionByName(alone, allowMissingColumns=True).withColumn("place_", place).filter(c("place_") <= most).drop("rank_", "place_")


def masks_in_regions(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """snapshot_id, region_id, box_id and the common part of each box and region of a snapshot."""
    left = boxes.select("snapshot_id", "box_id", c("bbox").alias("box"))
    right = regions.select("snapshot_id", "region_id", c("bbox").alias("region"))
    low = lambda p: F.greatest(c("box")[p], c("region")[p])
    size = lambda p, s: F.least(c("box")[p] + c("box")[s], c("region")[p] + c("region")[s]) - low(p)
    pairs = left.join(right, "snapshot_id").filter(intersection(c("box"), c("region")) > 0)
    return pairs.select("snapshot_id", "region_id", "box_id", F.struct(low("x").alias("x"), low("y").alias("y"), size("x", "width").alias("width"), size("y", "height").alias("height")).alias("part")).distinct()


def suppress(detections: DataFrame, by: str = "image_id", most_iou: float = 0.45, most: int = 100) -> DataFrame:
    """Non-maximum suppression: by falling confidence, a detection stays unless a kept one of its type overlaps it by
    more than `most_iou`; at most `most` an image. Columns: image_id, det_id, type, confidence, x, y, width, height."""

    def fold(group: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for x in _by_confidence(group):
            for k in kept:
                if k["type"] != x["type"]:
                    continue
                common = max(_side(k, x, "x", "width"), 0.0) * max(_side(k, x, "y", "height"), 0.0)
                if common > most_iou * max(_number(k["width"]) * _number(k["height"]) + _number(x["width"]) * _number(x["height"]) - common, 1e-12):
                    break
            else:
                kept.append(x)
                if len(kept) >= most:
                    break
        return kept

    return _folded(detections, by, fold, detections.schema)


def _number(value) -> float:
    return math.nan if value is None else float(value)


def _side(a: dict, b: dict, at: str, size: str) -> float:
    """The common length of two boxes along one axis, below 0 if they are apart; NaN if a number is missing."""
    p, q, m, n = _number(a[at]), _number(b[at]), _number(a[size]), _number(b[size])
    told = min(p + m, q + n) - max(p, q)
    return math.nan if math.isnan(p + q + m + n) else told


def _by_confidence(group: list[dict]) -> list[dict]:
    """By falling confidence (missing ones last), then det_id."""
    return sorted(group, key=lambda r: (r["confidence"] is None or r["confidence"] != r["confidence"], -(r["confidence"] or 0), r["det_id"] is None, r["det_id"]))


def _folded(rows: DataFrame, by: str, fold, schema) -> DataFrame:
    """fold(the rows of a group, as dicts) for each group. Groups follow each other in a sorted partition and leave it in lots, as a call of pandas for each costs far more
    than a fold of a few boxes; one group is held at a time."""
    import itertools

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        done: list[dict] = []
        flat = (row for batch in batches for row in batch.to_pylist())
        for _, group in itertools.groupby(flat, key=lambda r: r[by]):
            done += fold(list(group))
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, by).sortWithinPartitions(by).mapInArrow(run, schema)


def merge_detections(detections: DataFrame, by: str = "snapshot_id", most_iou: float = 0.45) -> DataFrame:
    """One identity visual_<n> for overlapping detections of a type: by falling confidence, a detection joins the first
    kept one that it overlaps, whose box grows to hold both. Order matters, so each snapshot is folded."""
    from pyspark.sql import types as T

    schema = T.StructType([*detections.schema.fields, T.StructField("evidence_id", T.StringType())])

    box = ("x", "y", "width", "height")

    def fold(group: list[dict]) -> list[dict]:
        rows: list[dict] = []
        for x in _by_confidence(group):
            x |= {k: math.nan if x[k] is None else x[k] for k in box}
            for m in rows:
                if m["type"] != x["type"]:
                    continue
                w = min(m["x"] + m["width"], x["x"] + x["width"]) - max(m["x"], x["x"])
                h = min(m["y"] + m["height"], x["y"] + x["height"]) - max(m["y"], x["y"])
                common = max(0, w) * max(0, h)
                if common / max(1, m["width"] * m["height"] + x["width"] * x["height"] - common) > most_iou:
                    right, bottom = max(m["x"] + m["width"], x["x"] + x["width"]), max(m["y"] + m["height"], x["y"] + x["height"])
                    m["x"], m["y"] = min(m["x"], x["x"]), min(m["y"], x["y"])
                    m["width"], m["height"] = right - m["x"], bottom - m["y"]
                    break
            else:
                rows.append(x | {"evidence_id": f"visual_{len(rows)}"})
        return [r | {k: None if r[k] != r[k] else r[k] for k in box} for r in rows]

    return _folded(detections, by, fold, schema)


def document_regions(texts: DataFrame, regions: DataFrame, types: tuple[str, ...] = ("PAN", "GSTIN", "PAYMENT_CARD", "AADHAAR_LIKE", "ACCOUNT_ID")) -> tuple[DataFrame, DataFrame]:
    """Read texts (snapshot_id, text_id, text, bbox) to detected entities and masks: one row for each accepted span with the box of its text; and
    the regions with `type`: PRIVATE_DOCUMENT, without a crop, for one that a text with an entity of `types` meets, else null."""
    from sluice.operators.detect import detect

    found = texts.select("snapshot_id", "text_id", "bbox", F.explode(detect(c("text"))).alias("e")).select("snapshot_id", "text_id", "bbox", c("e.type").alias("type"), F.lit("OCR").alias("source"), c("e.confidence").alias("confidence"), c("e.value").alias("raw_value"))
    hard = found.filter(c("type").isin(*types)).select("snapshot_id", c("text_id").alias("box_id"), "bbox").distinct()
    met = masks_in_regions(hard, regions).select("snapshot_id", "region_id").distinct().withColumn("type", F.lit("PRIVATE_DOCUMENT"))
    return found, regions.join(met, ["snapshot_id", "region_id"], "left").withColumn("crop", c("type").isNull())


def crop_records(done: DataFrame) -> DataFrame:
    """Records of verified crops from `masked` rasters: id, mime_type, width, height, sha256 and data_base64 (of the PNG), redaction_verified. One that
    is not verified is an error."""
    from sluice.sources.png import png_content

    done = png_content(done)
    checked = F.when(c("verified"), True).otherwise(F.raise_error("REDACTION_FAILED").cast("boolean"))
    return done.select(c("image_id").alias("id"), F.lit("image/png").alias("mime_type"), "width", "height", F.sha2("png", 256).alias("sha256"), F.base64("png").alias("data_base64"), checked.alias("redaction_verified"))


def capped_pixels(records: DataFrame, most: int = 160) -> DataFrame:
    """At most `most` pixel records of a snapshot, by falling confidence, then id."""
    n = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(c("confidence").desc(), "id"))
    return records.withColumn("n_", n).filter(c("n_") <= most).drop("n_")


def reading_order(boxes: DataFrame, by: str = "image_id", most: int = 200) -> DataFrame:
    """Recognised texts (text, confidence, x, y) joined from top to bottom, then left to right: text and mean confidence of each image."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("y", "x", "text"))
    kept = boxes.withColumn("n_", n).filter(c("n_") <= most)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_", "text"))), lambda t: t["text"]), " ").alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"))


def capped_regions(regions: DataFrame, analysed: int = 8) -> DataFrame:
    """The first `analysed` regions of a snapshot keep what was found; the others count as private documents."""
    n = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("region_no"))
    return regions.withColumn("outcome", F.when(n <= analysed, "ANALYSED").otherwise("PRIVATE_DOCUMENT"))


def masked(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, width, height, rgba with every box opaque black, verified, and sha256 of the bytes. A raster of the
    wrong size is an error. boxes: image_id, x, y, width, height; an image and its boxes are folded together."""
    listed = boxes.groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("boxes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import numpy as np

        for part in parts:
            out = []
            for r in part.itertuples():
                if len(r.rgba) != r.width * r.height * 4:
                    raise ValueError("REDACTION_FAILED")
                pixels = np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4).copy()
                spans = [
                    (max(0, math.floor(b["y"])), min(r.height, math.ceil(b["y"] + b["height"])), max(0, math.floor(b["x"])), min(r.width, math.ceil(b["x"] + b["width"])))
                    for b in (r.boxes if r.boxes is not None else [])
                ]
                for top, bottom, left, right in spans:
                    pixels[top:bottom, left:right] = (0, 0, 0, 255)
                ok = all((pixels[t:b, x:y] == (0, 0, 0, 255)).all() for t, b, x, y in spans)
                raw = pixels.tobytes()
                out.append((r.image_id, r.width, r.height, raw, ok, hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "rgba", "verified", "sha256"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "width", "height", "rgba").join(listed, "image_id", "left").mapInPandas(run, f"image_id {kind}, width int, height int, rgba binary, verified boolean, sha256 string")


def ctc_text(best: Column, score: Column, alphabet: Column) -> Column:
    """Greedy CTC: of the best symbol at each step, repeats and blanks (0) go; text and mean score of what stays."""
    steps = F.arrays_zip(best.alias("s"), score.alias("p"))
    kept = F.filter(F.transform(steps, lambda x, i: F.struct(x["s"].alias("s"), x["p"].alias("p"), F.when(i > 0, F.element_at(best, F.greatest(i, F.lit(1)))).alias("before"))), lambda x: (x["s"] != 0) & ~x["s"].eqNullSafe(x["before"]))
    text = F.array_join(F.transform(kept, lambda x: F.element_at(alphabet, x["s"])), "")
    return F.struct(text.alias("text"), F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"]) / F.size(kept)).otherwise(F.lit(0.0)).alias("confidence"))
