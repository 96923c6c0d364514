"""Ranking and order: planning priorities, budgeted selection, ordinals, repeats, ring buffers, round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import mentions, words

c = F.col


def priority(task_words: Column) -> Column:
    """Score of an element for a task: 20 a shared word, 1000 for a handle, 800 for an empty input, 700 for options,
    500 for a control, 100 for a link, less 200 if disabled. These weights are fixed values."""
    name = F.concat_ws(" ", "text", "label", "selected_option", "control_value", F.array_join(F.coalesce("options", F.array().cast("array<string>")), " "))
    flag = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return (
        20 * F.size(F.array_intersect(task_words, words(name)))
        + flag(F.length("value_handle") > 0, 1000)
        + flag(c("input_type").isNotNull() & (c("input_type") != "select") & ~c("value_present"), 800)
        + flag(F.size(F.coalesce("options", F.array().cast("array<string>"))) > 0, 700)
        + F.when(c("role").isin("button", "textbox", "combobox", "checkbox", "radio", "slider"), 500).when(c("role") == "link", 100).otherwise(0)
        - flag(~c("enabled"), 200)
    )


def ranked(elements: DataFrame, tasks: DataFrame, reserved: int = 12) -> DataFrame:
    """Adds score and rank in each snapshot: up to `reserved` OCR texts first, then by score, ties by place."""
    rows = elements.join(tasks.select("snapshot_id", words(c("task"), 3).alias("words_")), "snapshot_id").withColumn("score", priority(c("words_"))).drop("words_")
    by_score = Window.partitionBy("snapshot_id").orderBy(c("score").desc(), "dom_index", "id")
    ocr = F.coalesce((c("role") == "visual_text") & F.array_contains("sources", "OCR"), F.lit(False))
    rows = rows.withColumn("ocr_", ocr).withColumn("nth_", F.row_number().over(Window.partitionBy("snapshot_id", "ocr_").orderBy(c("score").desc(), "dom_index", "id")))
    late = F.when(c("ocr_") & (c("nth_") <= reserved), 0).otherwise(1)
    return rows.withColumn("late_", late).withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("late_", c("score").desc(), "dom_index", "id"))).drop("ocr_", "nth_", "late_")


def budgeted(elements: DataFrame, tasks: DataFrame, chars: int = 20_000, most: int = 80) -> DataFrame:
    """The elements that fit a budget of characters of compact JSON: by rank, one that does not fit is skipped and the
    next tried, until `most` are taken. Needs the column compact."""
    rows = ranked(elements, tasks).withColumn("size_", F.length("compact"))
    listed = rows.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("rank", "size_"))).alias("r_"))  # a snapshot holds 2000 elements at most
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("ranks"))

    def take(acc: Column, x: Column) -> Column:
        fits = (x["size_"] <= chars) & ((F.size(acc["ranks"]) == 0) | (acc["used"] + x["size_"] <= chars)) & (F.size(acc["ranks"]) < most)
        return F.when(fits, F.struct((acc["used"] + x["size_"]).alias("used"), F.concat(acc["ranks"], F.array(x["rank"])).alias("ranks"))).otherwise(acc)

    chosen = listed.select("snapshot_id", F.explode(F.aggregate("r_", start, take, lambda a: a["ranks"])).alias("rank"))
    return rows.join(chosen, ["snapshot_id", "rank"], "left_semi").drop("size_")


def longest_named(elements: DataFrame, tasks: DataFrame, name: str) -> DataFrame:
    """Of the elements whose name the task of their snapshot mentions, the one of the longest name, ties by place."""
    rows = elements.join(tasks.select("snapshot_id", c("task").alias("task_")), "snapshot_id").filter(mentions(c("task_"), c(name)))
    order = Window.partitionBy("snapshot_id").orderBy(F.length(name).desc(), "dom_index", "id")
    return rows.withColumn("n_", F.row_number().over(order)).filter("n_ = 1").drop("n_", "task_")


# Ordinals and verbs of control requests.
ORDINALS = {"first": 0, "1st": 0, "second": 1, "2nd": 1, "third": 2, "3rd": 2, "fourth": 3, "4th": 3, "fifth": 4, "5th": 4}
SET_VERBS, CLEAR_VERBS = "select|check|tick|mark|enable|choose", "clear|uncheck|untick|deselect|disable"


def ordinal_requests(tasks: DataFrame) -> DataFrame:
    """snapshot_id, request_no, role, ordinal (from 0) and desired state of each 'check the second checkbox'."""
    w = "(?<![A-Za-z0-9_])"
    pattern = rf"(?i){w}({SET_VERBS}|{CLEAR_VERBS})\s+(?:the\s+)?({'|'.join(ORDINALS)})\s+(checkbox|radio(?:\s+button)?)(?![A-Za-z0-9_])"
    text = F.regexp_replace(F.lower("task"), "-", " ")
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    rows = tasks.select("snapshot_id", F.posexplode(F.arrays_zip(part(1).alias("verb"), part(2).alias("ordinal"), part(3).alias("kind"))).alias("request_no", "r"))
    place = F.create_map(*[x for k, v in ORDINALS.items() for x in (F.lit(k), F.lit(v))])
    return rows.select("snapshot_id", "request_no", F.when(c("r.kind").startswith("radio"), "radio").otherwise("checkbox").alias("role"), F.element_at(place, c("r.ordinal")).alias("ordinal"), (~c("r.verb").rlike(f"^(?:{CLEAR_VERBS})$")).alias("desired"))


def ordinal_targets(elements: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each ordinal request with the enabled control that it means: snapshot_id, request_no, id, selected, desired."""
    n = F.row_number().over(Window.partitionBy("snapshot_id", "role").orderBy("dom_index", "id")) - 1
    controls = elements.filter(c("enabled") & c("role").isin("checkbox", "radio")).withColumn("ordinal", n)
    return ordinal_requests(tasks).join(controls.select("snapshot_id", "role", "ordinal", "id", "selected"), ["snapshot_id", "role", "ordinal"])


def repeats(steps: DataFrame, session: str, order: list[str], action: Column, page: Column) -> DataFrame:
    """Adds repeated: the action and the page have the same signatures as in the step before."""
    w = Window.partitionBy(session).orderBy(*order)
    rows = steps.withColumn("a_", F.sha2(action, 256)).withColumn("p_", F.sha2(page, 256))
    same = (F.lag("a_").over(w) == c("a_")) & (F.lag("p_").over(w) == c("p_"))
    return rows.withColumn("repeated", F.coalesce(same, F.lit(False))).drop("a_", "p_")


def last_rows(rows: DataFrame, by: list[str], order: list[str], most: int = 100) -> DataFrame:
    """The last `most` rows of each group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*[c(x).desc() for x in order]))
    return rows.withColumn("n_", n).filter(c("n_") <= most).drop("n_")


def round_trips(events: DataFrame, by: str, order: list[str], at: str, is_sent: Column, is_back: Column) -> DataFrame:
    """by, sent_at, back_at, elapsed_ms of each sending and the first return after it, before the next sending."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = events.filter(is_sent | is_back).withColumn("sent_", is_sent).withColumn("next_sent_", F.lead(is_sent).over(w)).withColumn("next_at_", F.lead(at).over(w))
    pairs = rows.filter(c("sent_") & ~c("next_sent_"))
    return pairs.select(by, c(at).alias("sent_at"), c("next_at_").alias("back_at"), (F.unix_millis(c("next_at_").cast("timestamp")) - F.unix_millis(c(at).cast("timestamp"))).alias("elapsed_ms"))


def top(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(c("n_") <= n).drop("n_")
