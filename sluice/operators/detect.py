"""Text detectors: candidates of every type, validated, and overlaps resolved by priority."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.patterns import DETECTORS, FOLDED, FOUR_DIGITS, Detector
from sluice.functions.validators import VALIDATORS

SPAN = "struct<type:string,value:string,start:int,stop:int,confidence:double,priority:int>"


#: A fold copies all that it has built at each step, so long lists are folded in pieces of this many.
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _before(values: Column, start: int, combine) -> Column:
    """For each of some whole numbers, `start` combined with all before it: running sums or maxima."""
    none = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))

    def fold(xs: Column, value) -> Column:
        return F.aggregate(xs, none, lambda acc, x: F.struct(combine(acc["at"], value(x)).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def pieces(xs: Column) -> Column:
        cut = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(_CHUNK)), lambda b: F.slice(xs, b + 1, F.lit(_CHUNK)))).otherwise(F.array().cast("array<array<int>>"))
        return F.transform(cut, lambda piece: fold(piece, lambda x: x))

    def whole(local: Column) -> Column:
        bases = fold(local, lambda piece: piece["at"])["out"]
        return F.flatten(F.transform(F.arrays_zip(local.alias("piece"), bases.alias("base")), lambda z: F.transform(z["piece"]["out"], lambda o: combine(z["base"], o).cast("int"))))

    return _let(values, lambda xs: _let(pieces(xs), whole))


def split_at(text: Column, pattern: str) -> Column:
    """What lies before, between and after the matches of a pattern that matches no empty text. Spark compiles the pattern of `split` anew for every row, but that of
    `regexp_replace` once, and a split by one plain character needs none; texts that hold the character are split by the pattern."""
    mark = "\x01"
    return F.when(F.contains(text, F.lit(mark)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, mark), mark, -1))


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match as {value, start, stop}: offsets are code points, start counts from 0, and the value of a group
    lies where its text first occurs in the match."""
    gaps = split_at(text, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(rows: Column) -> Column:
        at = _before(F.transform(rows, lambda x: F.length(x["gap"]) + F.length(x["whole"])), 0, lambda a, b: a + b)

        def span(z: Column) -> Column:
            x = z["x"]
            begin = z["at"] + F.length(x["gap"])
            start = begin + F.greatest(F.instr(x["whole"], x["value"]) - 1, F.lit(0)) if group else begin
            return F.struct(x["value"].alias("value"), start.cast("int").alias("start"), (start + F.length(x["value"])).cast("int").alias("stop"))

        return F.transform(F.arrays_zip(rows.alias("x"), at.alias("at")), span)

    rows = lambda w: _let(gaps, lambda g: F.arrays_zip(F.slice(g, F.lit(1), F.size(w)).alias("gap"), w.alias("whole"), (w if group == 0 else value).alias("value")))
    none = F.array().cast("array<struct<value:string,start:int,stop:int>>")
    return _let(whole, lambda w: F.when(F.size(w) == 0, none).otherwise(_let(rows(w), placed)))


def _tested(text: Column, chosen: list[Detector]) -> Column:
    """What the cheap tests of the chosen detectors need of a text, so that it is made once for all: {text, low, folded, four}."""
    none, words = F.lit(None), {w for d in chosen for w in d.words}
    return F.struct(
        text.alias("text"), (F.lower(text) if words - {"@", "0"} else none.cast("string")).alias("low"), (reduce(or_, [F.contains(text, F.lit(x)) for x in FOLDED]) if words else none.cast("boolean")).alias("folded"),
        (text.rlike(FOUR_DIGITS) if any(d.digits for d in chosen) else none.cast("boolean")).alias("four"),
    )


def _candidates(t: Column, d: Detector) -> Column:
    text = t["text"]
    spans = spans_of(text, d.pattern, d.group)
    keep = lambda x: (F.length(x["value"]) > 0) & (VALIDATORS[d.validator](x["value"]) if d.validator else F.lit(True))
    typed = F.transform(
        F.filter(spans, keep),
        lambda x: F.struct(F.lit(d.type).alias("type"), x["value"].alias("value"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(d.confidence).alias("confidence"), F.lit(d.priority).alias("priority")),
    )
    # The cheap tests first, cheapest ahead: a text that fails one costs no more.
    tests = [reduce(or_, [F.contains(text if w in "@0" else t["low"], F.lit(w)) for w in d.words], t["folded"])] if d.words else []
    tests += ([t["four"]] if d.digits else []) + ([text.rlike(d.hint)] if d.hint else [])
    return F.when(reduce(and_, tests), typed).otherwise(F.array().cast(f"array<{SPAN}>"))


def resolve(candidates: Column) -> Column:
    """Of overlapping candidates the one of higher priority, then of lower start, is accepted first; what touches none
    accepted stays. Result by start. Candidates are cut into clusters that do not overlap each other, so that each is
    only compared with those near it."""
    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    by_priority = lambda a, b: F.when(a["priority"] > b["priority"], -1).when(a["priority"] < b["priority"], 1).otherwise(by_start(a, b))
    none = F.array().cast(f"array<{SPAN}>")

    def greedy(group: Column) -> Column:
        accepted = F.aggregate(
            F.array_sort(group, by_priority), none,
            lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])), acc).otherwise(F.concat(acc, F.array(x))),
        )
        return F.when(F.size(group) < 2, group).otherwise(F.array_sort(accepted, by_start))

    def clustered(xs: Column) -> Column:
        """Lists of candidates: one begins where it starts at or after the end of all before it."""
        reach = _before(F.transform(xs, lambda x: x["stop"]), -1, lambda a, b: F.greatest(a, b))
        marked = F.transform(F.arrays_zip(xs.alias("x"), reach.alias("reach")), lambda z, i: F.when(z["x"]["start"] >= z["reach"], i))
        starts = F.filter(marked, lambda i: i.isNotNull())
        return _let(starts, lambda b: F.transform(b, lambda at, i: F.slice(xs, at + 1, F.coalesce(F.get(b, i + 1), F.size(xs)) - at)))

    return F.when(F.size(candidates) < 2, candidates).otherwise(_let(F.array_sort(candidates, by_start), lambda xs: F.flatten(F.transform(clustered(xs), greedy))))


def detect(text: Column, types: tuple[str, ...] | None = None) -> Column:
    """Accepted spans of a text, by start; none for a null text."""
    chosen = [d for d in DETECTORS if types is None or d.type in types]
    text = F.coalesce(text.cast("string"), F.lit(""))
    return _let(text, lambda x: _let(_tested(x, chosen), lambda t: _let(F.concat(*[_candidates(t, d) for d in chosen]), resolve)))


def entities(df: DataFrame, text: str, key: list[str], types: tuple[str, ...] | None = None, source: str = "DOM") -> DataFrame:
    """One row for each accepted span: the key, entity number in it, type, source, confidence, raw_value, start, stop.
    raw_value is private: drop it before results leave the engine."""
    found = df.select(*key, F.posexplode(detect(F.col(text), types)).alias("n", "e"))
    return found.select(
        *key, F.concat(F.lit("pii_"), F.col("n") + 1).alias("entity_id"), F.col("e.type").alias("type"), F.lit(source).alias("source"), F.col("e.confidence").alias("confidence"),
        F.col("e.value").alias("raw_value"), F.col("e.start").alias("start"), F.col("e.stop").alias("stop"),
    )


def field_texts(observations: DataFrame, tasks: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Every text that a page snapshot is scanned for: one row for each (snapshot, element, field, option index). The fields are
    TEXT, LABEL, OPTION and CONTROL_VALUE of elements; TASK of tasks (snapshot_id, task); and PRIVATE_VALUE of the side table
    of values (snapshot_id, element_id, value). Empty and null texts have no row."""
    e = F.col("e")
    rows = observations.select("snapshot_id", F.explode("elements").alias("e"))
    source = F.when(F.array_contains(e["sources"], "OCR") & ~F.array_contains(e["sources"], "DOM"), "OCR").otherwise("DOM")
    one = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("text"), F.lit(None).cast("int").alias("option_index"))
    options = F.transform(F.coalesce(e["options"], F.array()), lambda x, i: F.struct(F.lit("OPTION").alias("field"), x.alias("text"), i.alias("option_index")))
    texts = F.concat(F.array(one("TEXT", e["text"]), one("LABEL", e["label"])), options, F.array(one("CONTROL_VALUE", e["control_value"])))
    found = rows.select("snapshot_id", e["id"].alias("element_id"), source.alias("source"), F.posexplode(texts).alias("part", "t")).select("snapshot_id", "element_id", "source", "part", "t.*")
    extra = lambda df, element, field, text: df.select(
        "snapshot_id", element.cast("string").alias("element_id"), F.lit("DOM").alias("source"), F.lit(0).alias("part"), F.lit(field).alias("field"), F.col(text).alias("text"), F.lit(None).cast("int").alias("option_index")
    )
    if tasks is not None:
        found = found.unionByName(extra(tasks, F.lit(None), "TASK", "task"))
    if values is not None:
        found = found.unionByName(extra(values, F.col("element_id"), "PRIVATE_VALUE", "value"))
    return found.filter(F.length("text") > 0)


def all_entities(*sources: DataFrame) -> DataFrame:
    """The union of entities of all sources (text fields, metadata, visual hints, OCR, contextual), columns that one lacks
    null; numbered pii_1, pii_2, ... in each snapshot by source, place and value."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    for name, kind in (("field", "string"), ("element_id", "string"), ("region_id", "string"), ("option_index", "int"), ("start", "int"), ("evidence_id", "string"), ("contextual", "boolean")):
        if name not in whole.columns:
            whole = whole.withColumn(name, F.lit(None).cast(kind))
    order = Window.partitionBy("snapshot_id").orderBy("source", "element_id", "region_id", "field", "option_index", "start", "type", "raw_value")
    return whole.withColumn("entity_id", F.concat(F.lit("pii_"), F.row_number().over(order)))


def contextual_entities(protected: DataFrame, type_of) -> DataFrame:
    """Entities of a contextual scanner: one row for each placeholder of `protected` (snapshot_id, element_id, field, protected
    {text, found}), of confidence 0.9, the type that type_of gives its placeholder, and decision ABSTRACT. raw_value is private."""
    p = F.col("p")
    rows = protected.select("snapshot_id", "element_id", "field", F.explode("protected.found").alias("p"))
    return rows.select(
        "snapshot_id", "element_id", "field", type_of(p["placeholder"]).alias("type"), F.lit("DOM").alias("source"), F.lit(0.9).alias("confidence"), p["value"].alias("raw_value"), p["placeholder"].alias("placeholder"),
        F.lit(True).alias("contextual"), F.lit("ABSTRACT").alias("decision"),
    )


def handled_task(text: Column, found: Column, handle_of: Column) -> Column:
    """A protected task text with each placeholder replaced by its handle: handle_of maps placeholders to handles, and one
    without a handle stays. Other fields keep their placeholders."""
    put = lambda t, p: F.when(F.element_at(handle_of, p["placeholder"]).isNotNull(), F.replace(t, p["placeholder"], F.element_at(handle_of, p["placeholder"]))).otherwise(t)
    return F.aggregate(F.coalesce(found, F.array().cast("array<struct<placeholder:string,value:string>>")), text, put)
