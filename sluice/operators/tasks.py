"""Task texts: field values replaced by handles, clarifications, comparison words, and contextual protection of segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.patterns import COMPARISON, EDGE
from sluice.operators.detect import spans_of, split_at
from sluice.operators.policy import handles

c = F.col
# The labelled fields of a task, in order, and what may end a value.
_FIELD = r"(?:first\s+name|last\s+name|full\s+name|email(?:\s+address)?|mobile(?:\s+number)?|phone(?:\s+number)?|current\s+address|address|upi(?:\s+id)?|user\s*name|text\s+input|search(?:\s+(?:query|box))?)"
_END = rf"(?=\s*(?:,|;|$|\.\s+(?=[A-Za-z])|{EDGE}and\s+(?={_FIELD}{EDGE})))"
_FIELDS = (
    ("GIVEN_NAME", r"first\s+name", "is|=|:"),
    ("SURNAME", r"last\s+name", "is|=|:"),
    ("PERSON_NAME", r"full\s+name", "is|=|:"),
    ("EMAIL", r"email(?:\s+address)?", "is|=|:"),
    ("PHONE", r"(?:mobile|phone)(?:\s+number)?", "is|=|:"),
    ("ADDRESS", r"(?:current\s+address|address)", "is|=|:"),
    ("UPI_ID", r"upi(?:\s+id)?", "is|=|:"),
    ("USERNAME", r"user\s*name", "is|=|:|with"),
    ("TEXT", r"(?:text\s+input|search(?:\s+(?:query|box))?)", "is|=|:|with"),
)
# Texts that are actions, not values, and words before a button's name.
_ACTION_ONLY = r"(?i)^(?:my\s+)?(?:and\s+)?(?:continue|submit|stop|proceed|go|click|press|select|choose|fill|enter|use)(?:\s+.*)?$"
_CLICKED = rf'(?i){EDGE}(?:click|press)\s+(?:the\s+)?["\'“]?$'
VALUE = "struct<kind:string,value:string,start:int,stop:int>"


def _plausible(kind: str, value: Column) -> Column:
    ok = {
        "EMAIL": value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
        "PHONE": F.length(F.regexp_replace(value, r"\D", "")) >= 7,
        "UPI_ID": value.rlike(r"^[A-Za-z0-9._-]{2,}@[A-Za-z]{2,}$"),
    }.get(kind, F.length(value) >= 4)
    if kind in ("GIVEN_NAME", "SURNAME", "PERSON_NAME"):
        ok = value.rlike(r"^\p{L}[\p{L} .'-]{0,99}$") & ~value.rlike(rf"(?i){EDGE}(?:and|then){EDGE}")
    return ok & ~value.rlike(_ACTION_ONLY)


def task_values(task: Column) -> Column:
    """The field values that a task supplies: {kind, value, start, stop}, by start from the right, none that overlaps
    the one to its right."""
    found = []
    for kind, name, link in _FIELDS:
        pattern = rf"(?i){EDGE}{name}\s*(?:{link})?\s*(?:\"([^\"]{{1,200}})\"|'([^']{{1,200}})'|([^,;\n]{{1,200}}?){_END})"

        def value_of(x: Column, pattern: str) -> Column:
            groups = [F.nullif(F.regexp_extract(F.concat(x["value"]), pattern.replace(_END, "$"), i), F.lit("")) for i in (1, 2, 3)]
            raw = F.trim(F.coalesce(*groups, F.lit("")))
            return F.when(raw.endswith("."), F.rtrim(F.substring(raw, F.lit(1), F.length(raw) - 1))).otherwise(raw)

        def place(x: Column, kind: str, pattern: str) -> Column:
            value = value_of(x, pattern)
            # The value's last occurrence in the match.
            at = F.length(x["value"]) - F.instr(F.reverse(x["value"]), F.reverse(value)) - F.length(value) + 1
            start = (x["start"] + at).cast("int")
            return F.struct(F.lit(kind).alias("kind"), value.alias("value"), start.alias("start"), (start + F.length(value)).cast("int").alias("stop"), F.substring(task, F.greatest(x["start"] - 39, F.lit(1)), F.least(x["start"], F.lit(40))).alias("before"))

        rows = F.filter(
            F.transform(spans_of(task, pattern), lambda x: place(x, kind, pattern)),  # noqa: B023
            lambda v: (F.length(v["value"]) > 0) & ~v["value"].rlike("^LOCAL_[A-Z0-9_]+$") & _plausible(kind, v["value"]) & ~v["before"].rlike(_CLICKED),  # noqa: B023
        )
        found.append(F.transform(rows, lambda v: F.struct(v["kind"].alias("kind"), v["value"].alias("value"), v["start"].alias("start"), v["stop"].alias("stop"))))
    by_start = lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0)
    return F.aggregate(
        F.array_sort(F.concat(*found), by_start), F.array().cast(f"array<{VALUE}>"),
        lambda acc, v: F.when(F.exists(acc, lambda y: v["stop"] > y["start"]), acc).otherwise(F.concat(acc, F.array(v))),
    )


def localise(tasks: DataFrame, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """The tasks with field values replaced by handles LOCAL_<KIND>_<n>, and the vault's table (private). Handles are
    numbered from the right of each task, equal values share one."""
    rows = tasks.select(key, "task", F.posexplode_outer(task_values(c("task"))).alias("place", "v"))
    vault = handles(rows.filter("v is not null").select(key, c("v.kind").alias("kind"), c("v.value").alias("value"), "place"), key, ["place"])
    known = vault.select(c(key).alias("k_"), c("kind").alias("kind_"), c("value").alias("value_"), "handle")
    joined = rows.join(known, (c(key) == c("k_")) & (c("v.kind") == c("kind_")) & (c("v.value") == c("value_")), "left")
    spans = joined.groupBy(key).agg(F.any_value("task").alias("task"), F.array_sort(F.collect_list(F.when(c("handle").isNotNull(), F.struct("place", "v.start", "v.stop", "handle")))).alias("spans_"))
    put = F.aggregate("spans_", c("task"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["handle"], F.substring(t, s["stop"] + 1, F.length(t))))
    return spans.select(key, put.alias("task")), vault


def with_clarifications(task: Column, answers: Column, most: int = 4000) -> Column:
    """The task with its last three clarifications, cut to `most` characters."""
    last = F.slice(answers, F.greatest(F.size(answers) - 2, F.lit(1)), F.lit(3))
    return F.when(F.size(answers) > 0, F.substring(F.concat(task, F.lit("\nUser clarification: "), F.array_join(last, "\nUser clarification: ")), 1, most)).otherwise(task)


def comparison_lost(original: Column, sanitised: Column) -> Column:
    """Whether a comparison word of the original is missing from the sanitised task."""
    found = lambda t: F.transform(F.regexp_extract_all(t, F.lit(COMPARISON), F.lit(0)), F.lower)
    return F.size(F.array_except(found(original), found(sanitised))) > 0


# What redaction leaves in a text.
MARKER = (
    r"<(?:PERSON_NAME|EMAIL|PHONE|ADDRESS|UPI_ID|PASSWORD|OTP|PAYMENT_CARD|AADHAAR_LIKE|PAN|ACCOUNT_ID|PRIVATE_DOCUMENT|FACE|OTHER)>"
    rf"|{EDGE}LOCAL_[A-Z0-9_]+{EDGE}|\[(?:GIVEN_NAME|SURNAME|EMAIL|PHONE|BUILDING_NUMBER|STREET_NAME|SECONDARY_ADDRESS)_\d+\]"
)


def segments(text: Column) -> Column:
    """The text cut at redaction markers and handles: {part, is_marker}, in order; joined they give the text."""
    pair = lambda z: F.array(F.struct(z["gap"].alias("part"), F.lit(False).alias("is_marker")), F.struct(z["mark"].alias("part"), F.lit(True).alias("is_marker")))
    both = F.transform(F.arrays_zip(split_at(text, MARKER).alias("gap"), F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)).alias("mark")), pair)
    return F.filter(F.flatten(both), lambda s: s["part"].isNotNull() & (s["part"] != ""))


def protect(df: DataFrame, text: str, scan: Callable[[list[str]], list[tuple[str, list[tuple[str, str]]]]], into: str = "protected", most: int = 4000) -> DataFrame:
    """Adds {text, found: array of (placeholder, value)} by a pluggable scanner, which gets the segments between
    markers that are not blank. Texts over `most` characters, and a scanner that returns fewer results than it got,
    are errors: nothing passes unscanned."""
    import re

    marker = re.compile("(" + MARKER.replace(EDGE, r"\b") + ")")

    @F.pandas_udf("struct<text:string,found:array<struct<placeholder:string,value:string>>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            cut = [marker.split(t) if t is not None else [] for t in texts]
            if any(t is not None and len(t) > most for t in texts):
                raise ValueError("CONTEXTUAL_TEXT_TOO_LONG")
            asked = [s for p in cut for i, s in enumerate(p) if i % 2 == 0 and s.strip()]
            told = scan(asked) if asked else []
            if len(told) != len(asked):
                raise ValueError("CONTEXTUAL_OUTPUT_INCOMPLETE")
            answers, out = iter(told), []
            for t, p in zip(texts, cut, strict=True):
                new, found = [], []
                for i, s in enumerate(p):
                    if i % 2 == 0 and s.strip():
                        s, more = next(answers)
                        found += [{"placeholder": a, "value": b} for a, b in more]
                    new.append(s)
                out.append({"text": None if t is None else "".join(new), "found": found})
            yield pd.DataFrame(out, columns=["text", "found"])

    return df.withColumn(into, run(c(text)))


def gazetteer(names: dict[str, list[str]]) -> Callable[[list[str]], list[tuple[str, list[tuple[str, str]]]]]:
    """A scanner by word list, {kind: words}: a stand-in for a trained model, not its equal."""
    import re

    kinds = {w.lower(): k for k, ws in names.items() for w in ws}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, kinds), key=len, reverse=True)) + r")\b", re.I) if kinds else None

    def scan(texts: list[str]) -> list[tuple[str, list[tuple[str, str]]]]:
        out = []
        for t in texts:
            found: list[tuple[str, str]] = []

            def put(m: re.Match, found: list = found) -> str:
                kind = kinds[m[0].lower()]
                mark = f"[{kind}_{sum(1 for f, _ in found if f.startswith('[' + kind + '_')) + 1}]"
                found.append((mark, m[0]))
                return mark

            out.append((pattern.sub(put, t) if pattern else t, found))
        return out

    return scan


def grouped_spans(spans: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Model spans with group_start, group_stop: successive PERSON_NAME or ADDRESS spans that only blanks, commas or
    hyphens part are one item. spans: key, text, type, start, stop."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy("start", "stop")
    before, kind = F.lag("stop").over(w), F.lag("type").over(w)
    gap = F.substring(c(text), before + 1, c("start") - before)
    joins = c("type").isin("PERSON_NAME", "ADDRESS") & (kind == c("type")) & (c("start") >= before) & gap.rlike(r"^[\s,-]*$")
    rows = spans.withColumn("new_", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("group_", F.sum("new_").over(w))
    whole = Window.partitionBy(*key, "group_")
    return rows.withColumn("group_start", F.min("start").over(whole)).withColumn("group_stop", F.max("stop").over(whole)).drop("new_", "group_")
