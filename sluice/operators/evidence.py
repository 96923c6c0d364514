"""Evidence: detector hits, unique items and items to review of each type, without raw values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import nfkc


def item_key(type_: Column, value: Column, evidence_id: Column, site: Column) -> Column:
    """What makes two hits one item: a given identity, else the normalised value (digits of a phone), else the site."""
    text = F.trim(F.lower(value))
    text = F.when(type_ == "PHONE", F.regexp_replace(text, r"\D", "")).otherwise(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(evidence_id, F.when(F.length(text) > 0, F.concat(F.lit("value:"), text)), F.concat(F.lit("site:"), site))


def summarise(entities: DataFrame, by: list[str], unicode_forms: bool = True) -> DataFrame:
    """by, type, detector_hits, unique_items, review_items. An item is up for review if each of its hits is contextual,
    from OCR, or of confidence under 0.6.

    entities: type, source, confidence, raw_value, and where known contextual, evidence_id, element_id, region_id,
    entity_id, option_index. Two partial aggregates; only keys are shuffled, hashed so that no raw value leaves a task.
    """
    has = set(entities.columns)
    col = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    value = nfkc(F.coalesce("raw_value", F.lit(""))) if unicode_forms else F.coalesce("raw_value", F.lit(""))
    site = F.concat(F.coalesce(col("element_id", "string"), col("region_id", "string"), col("entity_id", "string"), F.lit("")), F.lit(":"), F.coalesce(col("option_index", "int").cast("string"), F.lit("")))
    review = F.coalesce(col("contextual", "boolean"), F.lit(False)) | (F.col("source") == "OCR") | (F.col("confidence") < 0.6)
    keyed = entities.select(*by, "type", F.sha2(item_key(F.col("type"), value, col("evidence_id", "string"), site), 256).alias("item"), review.alias("review"))
    items = keyed.groupBy(*by, "type", "item").agg(F.count("*").alias("hits"), F.bool_and("review").alias("review"))
    return items.groupBy(*by, "type").agg(F.sum("hits").alias("detector_hits"), F.count("*").alias("unique_items"), F.count_if("review").alias("review_items"))


def as_maps(summary: DataFrame, by: list[str]) -> DataFrame:
    """The summary as three maps from type to count."""
    pairs = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.struct("type", c))))).alias(c)
    return summary.groupBy(*by).agg(pairs("unique_items"), pairs("detector_hits"), pairs("review_items"))


def blocked_regions(decided: DataFrame, by: list[str]) -> DataFrame:
    """Distinct visual regions with a dropped entity."""
    return decided.filter("field = 'VISUAL' and decision = 'DROP'").groupBy(*by).agg(F.countDistinct(F.coalesce("evidence_id", "region_id")).alias("blocked_regions"))
