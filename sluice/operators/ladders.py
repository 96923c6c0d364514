"""Two more ladders of rules beside the planner's: what a device settles by itself, and the booking journey.

As in `planner`, every rule gives candidates, and the least (rule, place) of a snapshot is its action. Elements and tasks have the columns that they have there.

Defined cases: a snapshot that no rule fits has no row; null texts, labels and options have no name; null flags count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.patterns import EDGE
from sluice.functions.text import escaped, mentions, month_label
from sluice.operators import rank
from sluice.operators.elements import element_kinds, screen_summary
from sluice.operators.planner import _named_state

c = F.col
# Tasks that need a planner, that ask for a summary, that a device may settle; how tasks name the kinds of fields; handles.
REASONING = rf"{EDGE}(?:compare|recommend|best|cheapest|lowest|least\s+expensive|research|calculate|evaluate|rank|book|purchase|place\s+(?:the\s+)?order|find\s+the){EDGE}"
SUMMARY = rf"(?s){EDGE}(?:describe|summari[sz]e|analyse|analyze){EDGE}.*{EDGE}(?:screen|page|visible|viewport){EDGE}"
SIMPLE = rf"{EDGE}(?:fill|enter|type|use|add|provide|select|choose|check|tick|mark|enable|clear|uncheck|untick|deselect|disable|click|press|scroll){EDGE}"
FILLS = rf"{EDGE}(?:fill|enter|type|use|add|provide){EDGE}"
FIELD_WORDS = {
    "EMAIL": "email", "PHONE": "(?:phone|mobile)", "PASSWORD": "password", "GIVEN_NAME": r"first\s+name", "SURNAME": r"last\s+name", "PERSON_NAME": r"(?:full\s+)?name", "ADDRESS": "address", "UPI_ID": "upi", "OTP": "otp", "USERNAME": r"user\s*name",
    "TEXT": r"(?:text\s+input|search(?:\s+(?:query|box))?)",
}
HANDLE = rf"{EDGE}LOCAL_([A-Z0-9_]+)_\d+{EDGE}"
NEXT_BUTTONS = "^(?:continue|next|back|finish|save)$"
NO_SUBMIT = rf"{EDGE}(?:do\s+not|don't|never)\s+(?:click\s+|press\s+)?(?:the\s+)?submit{EDGE}"
SCROLL_PIXELS = 700
DEVICE_RULES = ("SUMMARY", "FILL", "CHOOSE", "ORDINAL", "NAMED_STATE", "SCROLL", "NAMED_BUTTON", "SATISFIED")
_DEVICE = "struct<rule_no:int,place:int,id:string,type:string,handle:string,option:string,direction:string>"


def _null() -> Column:
    return F.lit(None).cast("string")


def _name() -> Column:
    return F.trim(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in ("label", "text", "control_value")]))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "-", " "), r"\s+", " "))


def _asks_for(task: Column, kinds: Column) -> Column:
    """Whether a task names a field of one of the kinds."""
    found = F.lit(False)
    for kind, words in FIELD_WORDS.items():
        found = found | (F.array_contains(kinds, kind) & task.rlike(EDGE + words + EDGE))
    return found


def on_device(elements: DataFrame, tasks: DataFrame) -> DataFrame:
    """snapshot_id, rule, type, element_id, handle, option, direction, amount and summary of what a device settles without a planner. Tasks that need reasoning, and
    those that ask for none of its actions, have no row."""
    asked = tasks.select("snapshot_id", "task", _plain(c("task")).alias("t_"))
    summary = c("t_").rlike(SUMMARY) & ~c("t_").rlike(REASONING)
    simple = asked.filter(~c("t_").rlike(REASONING) & ~c("t_").rlike(SUMMARY) & c("t_").rlike(SIMPLE))
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = elements.drop("task").join(simple, "snapshot_id")
    enabled, filled = yes(c("enabled")), yes(c("value_present"))
    kinds = element_kinds(c("input_type"), c("label"), c("text"))
    kind = F.nullif(F.regexp_extract("value_handle", "^LOCAL_([A-Z0-9_]+)_[0-9]+$", 1), F.lit(""))
    named = c("t_").contains(F.lower("value_handle"))
    of_kind = c("t_").rlike(FILLS) & F.array_contains(kinds, kind) & _asks_for(c("t_"), F.array(kind))
    option = F.get(F.filter(F.coalesce("options", F.array().cast("array<string>")), lambda o: mentions(c("t_"), o)), 0)
    control = c("role").isin("checkbox", "radio")
    state = F.when(enabled & control, _named_state(c("t_"), F.transform(F.array_compact(F.array("label", "text", "control_value")), _plain)))
    name = _name()
    button = _plain(name)
    clicked = F.regexp_like("t_", F.concat(F.lit(rf"{EDGE}(?:click|press)\s+(?:the\s+)?"), escaped(button), F.lit("(?![A-Za-z0-9_])")))
    pressed = enabled & (c("role") == "button") & mentions(c("t_"), name) & (clicked | button.rlike(NEXT_BUTTONS)) & ~(c("t_").rlike(NO_SUBMIT) & F.lower(name).contains("submit"))

    def action(rule: str, type_: str, when: Column | None = None, place: Column | None = None, own: bool = True, handle: Column | None = None, option: Column | None = None, direction: Column | None = None) -> Column:
        told = F.struct(
            F.lit(DEVICE_RULES.index(rule)).alias("rule_no"), (c("dom_index") if place is None else place).cast("int").alias("place"), (c("id") if own else _null()).alias("id"), F.lit(type_).alias("type"),
            *[(_null() if v is None else v).alias(n) for n, v in (("handle", handle), ("option", option), ("direction", direction))],
        ).cast(_DEVICE)
        return told if when is None else F.when(yes(when), told)

    own = F.array(
        action("FILL", "TYPE_HANDLE", enabled & ~filled & (F.length("value_handle") > 0) & (named | yes(of_kind)), handle=c("value_handle")),
        action("CHOOSE", "SELECT", enabled & option.isNotNull() & ~option.eqNullSafe(c("selected_option")), option=option),
        action("NAMED_STATE", "CLICK", state.isNotNull() & ~state.eqNullSafe(c("selected"))), action("NAMED_BUTTON", "CLICK", pressed),
    )
    told = rows.select(
        "snapshot_id", F.array_min(F.array_compact(own)).alias("best"), state.isNotNull().alias("named"), (option.isNotNull()).alias("optional"), (option.isNotNull() & ~option.eqNullSafe(c("selected_option"))).alias("unset"),
        (filled & _asks_for(c("t_"), kinds)).alias("implicit"),
    )
    each = told.groupBy("snapshot_id").agg(F.min("best").alias("best"), F.bool_or(F.col("named") | F.col("optional") | F.col("implicit")).alias("known"), F.bool_or("unset").alias("unset"))
    # Ordinal requests, with the control that each means, if there is one.
    asks = rank.ordinal_requests(simple.select("snapshot_id", c("t_").alias("task")))
    targets = rank.ordinal_targets(elements, simple.select("snapshot_id", c("t_").alias("task"))).select("snapshot_id", "request_no", "id", "selected")
    met = asks.join(targets, ["snapshot_id", "request_no"], "left").withColumn("ok", yes(c("selected").eqNullSafe(c("desired"))) & c("id").isNotNull())
    ordinal = met.groupBy("snapshot_id").agg(F.min(F.when(c("id").isNotNull() & ~c("ok"), action("ORDINAL", "CLICK", place=c("request_no")))).alias("ordinal"), F.bool_and("ok").alias("ordinals_ok"))
    # Handles that the task names are satisfied by a field of their kind that is filled, or holds the handle.
    handles = simple.select("snapshot_id", F.explode(F.arrays_zip(F.regexp_extract_all("task", F.lit(HANDLE), F.lit(0)).alias("handle"), F.regexp_extract_all("task", F.lit(HANDLE), F.lit(1)).alias("kind"))).alias("h")).select("snapshot_id", "h.*").distinct()
    fields = elements.filter(enabled).select("snapshot_id", F.explode(kinds).alias("kind"), filled.alias("filled"), c("value_handle").alias("held"))
    settled = handles.join(fields, ["snapshot_id", "kind"], "left").groupBy("snapshot_id", "handle").agg(F.bool_or(yes(c("filled") | (c("held") == c("handle")))).alias("ok"))
    settled = settled.groupBy("snapshot_id").agg(F.bool_and("ok").alias("handles_ok"))
    scroll = F.nullif(F.upper(F.regexp_extract("t_", rf"{EDGE}scroll\s+(up|down){EDGE}", 1)), F.lit(""))
    both = simple.join(each, "snapshot_id", "left").join(ordinal, "snapshot_id", "left").join(settled, "snapshot_id", "left")
    done = (yes(c("known")) | c("ordinals_ok").isNotNull() | c("handles_ok").isNotNull()) & F.coalesce("ordinals_ok", F.lit(True)) & F.coalesce("handles_ok", F.lit(True)) & ~yes(c("unset"))
    zero = F.lit(0)
    best = F.array_min(F.array_compact(F.array("best", "ordinal", action("SCROLL", "SCROLL", scroll.isNotNull(), zero, False, direction=scroll), action("SATISFIED", "FINISH", done, zero, False))))
    found = both.select("snapshot_id", best.alias("a")).filter("a is not null").withColumn("summary", F.when(c("a.type") == "FINISH", "The requested simple form and control states are complete locally."))
    seen = screen_summary(elements.join(asked.filter(summary).select("snapshot_id"), "snapshot_id", "left_semi"))
    text = F.concat(
        F.lit("Local screen analysis found "), "interactive", F.lit(" interactive elements and "), "visual", F.lit(" pixel-derived records."),
        F.when(F.size("names") > 0, F.concat(F.lit(" Visible controls include "), F.array_join("names", ", "), F.lit("."))).otherwise(""), F.when(F.size("readings") > 0, F.concat(F.lit(" Sanitized visual text: "), F.array_join("readings", "; "), F.lit("."))).otherwise(""),
    )
    summed = asked.filter(summary).join(seen, "snapshot_id", "left").select("snapshot_id", action("SUMMARY", "FINISH", place=zero, own=False).alias("a"), F.coalesce(text, F.lit("Local screen analysis found 0 interactive elements and 0 pixel-derived records.")).alias("summary"))
    rules = F.array(*[F.lit(r) for r in DEVICE_RULES])
    return found.unionByName(summed).select(
        "snapshot_id", F.get(rules, c("a.rule_no")).alias("rule"), c("a.type").alias("type"), c("a.id").alias("element_id"), c("a.handle").alias("handle"), c("a.option").alias("option"), c("a.direction").alias("direction"),
        F.when(c("a.type") == "SCROLL", SCROLL_PIXELS).alias("amount"), "summary",
    )


# The words of the journey's pages, in the order in which their controls are tried.
SEARCH, DONE = "Search trains", "Simulated booking complete"
ROUTE = (("From", "from"), ("To", "to"), ("Travel class", "travel_class"), ("Quota", "quota"))
PASSENGER = (("Passenger age", "age"), ("Passenger gender", "gender"), ("Berth preference", "berth"))
PRIVATE = ("PERSON_NAME", "EMAIL", "PHONE")
BUTTONS = (SEARCH, "Continue as demo traveller", "Review journey", "Continue to payment", "Pay simulated fare")
FARE = r"^Choose train .+, departure (\d{2}):\d{2}, fare (\d+)$"
JOURNEY_RULES = ("ROUTE", "MONTH", "DAY", "OPEN_DATES", "DONE", "PRIVATE", "PASSENGER", "FARE", "BUTTON")


def journey(elements: DataFrame, trips: DataFrame) -> DataFrame:
    """snapshot_id, rule, type, element_id, handle, option and error of the next step of a booking. trips: snapshot_id, rehearsal, and the journey {from, to, date,
    travel_class, quota, age, gender, berth}, null where the task has none. On the search page an option or a day that is not on offer is an error, and so is a missing journey;
    elsewhere the choice of a fare is left to a planner unless it is a rehearsal, and then the row says so (type null)."""
    rows = elements.join(trips, "snapshot_id").filter(F.coalesce("enabled", F.lit(False))).withColumn("name_", F.trim(F.coalesce(F.nullif("label", F.lit("")), "text", F.lit(""))))
    j, box = c("journey"), c("role") == "combobox"
    button = c("role") == "button"
    options = F.coalesce("options", F.array().cast("array<string>"))
    kind = "struct<rule_no:int,place:int,at:double,dom_index:int,id:string,type:string,handle:string,option:string,error:string>"

    def step(rule: str, when: Column, type_: str | None, place: int = 0, at: Column | None = None, handle: Column | None = None, option: Column | None = None, error: Column | None = None) -> Column:
        told = F.struct(
            F.lit(JOURNEY_RULES.index(rule)).alias("rule_no"), F.lit(place).alias("place"), (F.lit(0.0) if at is None else at).alias("at"), c("dom_index").cast("int").alias("dom_index"), c("id").alias("id"), F.lit(type_).cast("string").alias("type"),
            *[(_null() if v is None else v).alias(n) for n, v in (("handle", handle), ("option", option), ("error", error))],
        ).cast(kind)
        return F.when(F.coalesce(when, F.lit(False)), told)

    def choose(rule: str, label: str, value: Column, place: int) -> list[Column]:
        unset = box & (c("name_") == label) & (F.length(value) > 0) & ~c("selected_option").eqNullSafe(value)
        there = F.array_contains(options, value)
        return [step(rule, unset & there, "SELECT", place, option=value), step(rule, unset & ~there, None, place, error=F.lit(f"REQUEST_UNAVAILABLE: {label}"))]

    search = [x for i, (label, field) in enumerate(ROUTE) for x in choose("ROUTE", label, j[field], i)] + choose("MONTH", "Journey month", month_label(j["date"]), 0) + [
        step("DAY", button & (c("name_") == F.concat(F.lit("Journey date "), j["date"])), "CLICK"),
        step("OPEN_DATES", button & ((c("name_") == "Choose journey date") | c("name_").startswith("Selected journey date ")) & (c("name_") != F.concat(F.lit("Selected journey date "), j["date"])), "CLICK"),
    ]
    fare, hour = F.nullif(F.regexp_extract("name_", FARE, 2), F.lit("")).cast("double"), F.nullif(F.regexp_extract("name_", FARE, 1), F.lit("")).cast("int")
    later = [
        step("DONE", c("name_") == DONE, "FINISH"),
        *[step("PRIVATE", (c("role") == "textbox") & ~F.coalesce("value_present", F.lit(False)) & c("value_handle").startswith(f"LOCAL_{k}_") & F.lower("name_").contains("passenger"), "TYPE_HANDLE", i, handle=c("value_handle")) for i, k in enumerate(PRIVATE)],
        *[x for i, (label, field) in enumerate(PASSENGER) for x in choose("PASSENGER", label, j[field], i)],
        step("FARE", (hour < 12) & c("rehearsal"), "CLICK", at=fare), step("FARE", (hour < 12) & ~F.coalesce("rehearsal", F.lit(False)), None, at=fare), *[step("BUTTON", button & (c("name_") == b), "CLICK", i) for i, b in enumerate(BUTTONS)],
    ]
    told = rows.select(
        "snapshot_id", (c("name_") == SEARCH).alias("searching"), j.isNull().alias("unknown"), (box & (c("name_") == "Journey month")).alias("months"), F.array_min(F.array_compact(F.array(*search))).alias("first"),
        F.array_min(F.array_compact(F.array(*search[:-2]))).alias("chosen"), search[-2].alias("day"), F.array_min(F.array_compact(F.array(*later))).alias("then"),
    )
    each = told.groupBy("snapshot_id").agg(*[F.bool_or(x).alias(x) for x in ("searching", "unknown", "months")], *[F.min(x).alias(x) for x in ("first", "chosen", "day", "then")])
    fail = lambda rule, error: F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in (("rule_no", "int", JOURNEY_RULES.index(rule)), ("place", "int", 0), ("at", "double", 0.0), ("dom_index", "int", 0), ("id", "string", None), ("type", "string", None), ("handle", "string", None), ("option", "string", None), ("error", "string", error))])
    months = F.coalesce("chosen", "day", fail("DAY", "REQUEST_UNAVAILABLE: Journey date"))
    opened = F.when(c("first.rule_no") == JOURNEY_RULES.index("DAY"), F.lit(None).cast(kind)).otherwise(c("first"))
    searching = F.when(c("unknown"), fail("ROUTE", "REQUEST_UNAVAILABLE: Booking request")).when(c("months"), months).otherwise(opened)
    best = F.coalesce(F.when(c("searching"), searching), c("then"))
    rules = F.array(*[F.lit(r) for r in JOURNEY_RULES])
    found = each.select("snapshot_id", best.alias("a")).filter("a is not null")
    return found.select("snapshot_id", F.get(rules, c("a.rule_no")).alias("rule"), *[c(f"a.{x}").alias("element_id" if x == "id" else x) for x in ("type", "id", "handle", "option", "error")])
