"""Policy: one decision for each entity, vault handles, and redaction of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.patterns import DROPPED_TYPES


def decision(type_: Column, is_handled: Column | None = None) -> Column:
    """LOCAL_HANDLE for values that have a handle, DROP for the strictest types and faces, ASK for OTHER, else ABSTRACT."""
    handled = F.lit(False) if is_handled is None else F.coalesce(is_handled, F.lit(False))
    return F.when(handled, "LOCAL_HANDLE").when(type_.isin(*DROPPED_TYPES, "FACE"), "DROP").when(type_ == "OTHER", "ASK").otherwise("ABSTRACT")


def replacement(type_: Column, handle: Column | None = None) -> Column:
    """The text that stands for an entity: its handle, <TYPE>, or null where the user is asked."""
    tag = F.when(type_ != "OTHER", F.concat(F.lit("<"), type_, F.lit(">")))
    return tag if handle is None else F.coalesce(handle, tag)


def handles(values: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """The vault's table: scope, kind, value, handle LOCAL_<KIND>_<n>, numbered in each scope and kind by first
    appearance (`order` is a total order in a scope). Equal values share a handle. Private: it holds the values."""
    firsts = values.groupBy(scope, "kind", "value").agg(F.min(F.struct(*order)).alias("first_seen"))
    n = F.row_number().over(Window.partitionBy(scope, "kind").orderBy("first_seen"))
    return firsts.withColumn("handle", F.concat(F.lit("LOCAL_"), "kind", F.lit("_"), n)).select(scope, "kind", "value", "handle")


def decide(entities: DataFrame, vault: DataFrame | None = None, scope: str = "snapshot_id") -> DataFrame:
    """The entities with decision and replacement. Values of fields TASK and PRIVATE_VALUE take their handle from the
    vault's table; an entity has exactly one decision."""
    if vault is None:
        return entities.withColumn("decision", decision(F.col("type"))).withColumn("replacement", replacement(F.col("type")))
    private = F.col("field").isin("TASK", "PRIVATE_VALUE") & (F.length("raw_value") > 0)
    held = vault.select(F.col(scope).alias("v_scope"), F.col("kind").alias("v_kind"), F.col("value").alias("v_value"), "handle")
    joined = entities.join(held, (F.col(scope) == F.col("v_scope")) & (F.col("type") == F.col("v_kind")) & (F.col("raw_value") == F.col("v_value")) & private, "left")
    known = F.col("handle").isNotNull()
    return joined.withColumn("decision", decision(F.col("type"), known)).withColumn("replacement", replacement(F.col("type"), F.col("handle"))).drop("v_scope", "v_kind", "v_value", "handle")


def redact(text: Column, spans: Column) -> Column:
    """The text with spans {type, start, stop} (by start, disjoint) replaced from the right by <TYPE>; null stays null."""
    return redact_with(text, spans, lambda s: F.concat(F.lit("<"), s["type"], F.lit(">")))


def redact_with(text: Column, spans: Column, by) -> Column:
    """As redact, each span replaced by by(span); a null replacement leaves <TYPE>."""
    put = lambda s: F.coalesce(by(s), F.concat(F.lit("<"), s["type"], F.lit(">")))
    return F.aggregate(F.reverse(spans), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), put(s), F.substring(t, s["stop"] + 1, F.length(t))))


def redact_entities(texts: DataFrame, decided: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The texts redacted by decided entities of the same key (nullable keys match null-safely); KEEP changes nothing,
    and an entity without a decision is an error."""
    right = decided.groupBy(*[F.col(k).alias(f"k_{k}") for k in key]).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "type", "decision", "replacement"))).alias("spans_")
    )
    on = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"k_{k}"))
        on = same if on is None else on & same
    joined = texts.join(right, on, "left").drop(*[f"k_{k}" for k in key])
    checked = F.transform(F.col("spans_"), lambda s: F.when(s["decision"].isNull(), F.raise_error("an entity has no decision").cast("struct<start:int,stop:int,type:string,decision:string,replacement:string>")).otherwise(s))
    kept = F.filter(checked, lambda s: s["decision"] != "KEEP")
    return joined.withColumn(text, F.when(F.col("spans_").isNull(), F.col(text)).otherwise(redact_with(F.col(text), kept, lambda s: s["replacement"]))).drop("spans_")
