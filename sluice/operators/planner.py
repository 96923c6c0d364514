"""The planner: a ladder of rules as ranked candidate actions, the projections around it, and its step limits.

Every rule of a snapshot gives candidates; the least (rule, place) is its action. Columns as in `elements`; tasks: snapshot_id, task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.patterns import EDGE
from sluice.functions.text import escaped, price
from sluice.operators import rank
from sluice.operators.elements import lowest_price
from sluice.operators.guard import button_prohibited

c = F.col
# What a finished page says, the tasks it answers, words for the least price, and buttons that a task may ask for.
_DONE = rf"{EDGE}(?:controlled demo complete|order (?:was )?placed|booking confirmed|form submitted successfully|task completed successfully){EDGE}"
_MAY_FINISH = rf"{EDGE}(?:complete|finish|order|book|submit|continue){EDGE}"
_CHEAP = ("cheap", "lowest", "least expensive")
_INTENTS = ((rf"{EDGE}continue{EDGE}", "continue"), (rf"{EDGE}place\s+(?:the\s+)?order{EDGE}", "place order"), (rf"{EDGE}submit{EDGE}", "submit"))
_NO_WORD = "(?![A-Za-z0-9_])"
#: Rules in their order.
RULES = ("VISIBLY_DONE", "FILL", "CHOOSE", "ORDINAL", "NAMED_STATE", "BUTTON_INTENT", "NAMED_BUTTON", "SATISFIED", "NO_RULE")
_ACTION = "struct<rule_no:int,place:int,dom_index:int,id:string,type:string,handle:string,option:string>"


def _named_state(task: Column, names: Column) -> Column:
    """The state that a task asks of a control, by the longest of its names that the task holds; null if it holds none."""
    usable = F.filter(names, lambda n: (F.length(n) >= 2) & ~n.rlike(r"^\d+$") & F.regexp_like(task, F.concat(F.lit("(?<![A-Za-z0-9_])"), escaped(n), F.lit(_NO_WORD))))
    longest = F.get(F.array_sort(usable, lambda a, b: F.length(b) - F.length(a)), 0)
    cleared = F.regexp_like(task, F.concat(F.lit(rf"{EDGE}(?:{rank.CLEAR_VERBS})\s+(?:the\s+)?"), escaped(longest), F.lit(_NO_WORD)))
    return F.when(longest.isNotNull(), ~cleared)


def plan(elements: DataFrame, tasks: DataFrame) -> DataFrame:
    """snapshot_id, rule, type, element_id, handle and option of each task's next action: FINISH where no rule has one."""
    rows = elements.drop("task").join(tasks.select("snapshot_id", F.regexp_replace(F.lower("task"), "-", " ").alias("t_")), "snapshot_id")
    enabled = F.coalesce(c("enabled"), F.lit(False))
    none = F.lit(None).cast("string")

    def action(rule: str, type_: str, when: Column, place: Column | int = 0, handle: Column = none, option: Column = none) -> Column:
        return F.when(when, F.struct(F.lit(RULES.index(rule)).alias("rule_no"), (F.lit(place) if isinstance(place, int) else place).alias("place"), c("dom_index").alias("dom_index"), c("id").alias("id"), F.lit(type_).alias("type"), handle.alias("handle"), option.alias("option")))

    options = F.filter(F.coalesce("options", F.array().cast("array<string>")), lambda o: ~F.lower(o).contains("select"))
    asked = F.get(F.filter(options, lambda o: F.contains(c("t_"), F.lower(o))), 0)
    cheap = F.lit(False)
    for word in _CHEAP:
        cheap = cheap | c("t_").contains(word)
    wanted = F.coalesce(asked, F.when(cheap, lowest_price(options, price)))
    may = enabled & (F.size(options) > 0)
    control = enabled & c("role").isin("checkbox", "radio")
    names = F.transform(F.array_compact(F.array("label", "control_value", "text")), lambda n: F.trim(F.regexp_replace(F.lower(n), "-", " ")))
    state = F.when(control, _named_state(c("t_"), names))
    button = enabled & (c("role") == "button")
    visible = F.lower(F.concat_ws(" ", F.nullif("text", F.lit("")), F.nullif("label", F.lit(""))))
    intents = [action("BUTTON_INTENT", "CLICK", button & c("t_").rlike(t) & visible.contains(name) & ~button_prohibited(c("t_"), visible), i) for i, (t, name) in enumerate(_INTENTS)]
    click = lambda n: F.regexp_like("t_", F.concat(F.lit(rf"{EDGE}(?:click|press)\s+(?:the\s+)?[\"'“]?"), escaped(F.trim(F.lower(n))), F.lit(_NO_WORD))) & ~button_prohibited(c("t_"), n)
    named = button & (F.coalesce(click(c("text")), F.lit(False)) | F.coalesce(click(c("label")), F.lit(False)))
    own = F.array(
        action("FILL", "TYPE_HANDLE", enabled & (F.length("value_handle") > 0), handle=c("value_handle")),
        action("CHOOSE", "SELECT", may & wanted.isNotNull() & ~wanted.eqNullSafe(c("selected_option")), option=wanted),
        action("NAMED_STATE", "CLICK", state.isNotNull() & ~state.eqNullSafe(c("selected"))),
        *intents,
    )
    told = rows.select(
        "snapshot_id", F.array_min(F.array_compact(own)).alias("best"), (F.coalesce(may & wanted.isNotNull(), F.lit(False)) | state.isNotNull()).alias("recognised"),
        action("NAMED_BUTTON", "CLICK", named).alias("named"), F.coalesce(F.lower(F.concat_ws(" ", "text", "label")).rlike(_DONE), F.lit(False)).alias("done"),
    )
    each = told.groupBy("snapshot_id").agg(F.min("best").alias("best"), F.bool_or("recognised").alias("recognised"), F.count("named").alias("n_named"), F.min("named").alias("named"), F.bool_or("done").alias("done"))
    targets = rank.ordinal_targets(elements, tasks)
    by_place = targets.groupBy("snapshot_id").agg(
        F.min(F.when(~c("selected").eqNullSafe(c("desired")), F.struct(F.lit(RULES.index("ORDINAL")).alias("rule_no"), c("request_no").alias("place"), F.lit(0).alias("dom_index"), c("id").alias("id"), F.lit("CLICK").alias("type"), none.alias("handle"), none.alias("option")))).cast(_ACTION).alias("ordinal"),
        F.lit(True).alias("asked"),
    )
    both = tasks.select("snapshot_id", F.lower("task").rlike(_MAY_FINISH).alias("may_finish")).join(each, "snapshot_id", "left").join(by_place, "snapshot_id", "left")
    finish = lambda rule: F.struct(F.lit(RULES.index(rule)).alias("rule_no"), F.lit(0).alias("place"), F.lit(0).alias("dom_index"), none.alias("id"), F.lit("FINISH").alias("type"), none.alias("handle"), none.alias("option")).cast(_ACTION)
    known = F.coalesce(c("recognised"), F.lit(False)) | F.coalesce(c("asked"), F.lit(False))
    best = F.array_min(F.array_compact(F.array(
        F.when(F.coalesce(c("done") & c("may_finish"), F.lit(False)), finish("VISIBLY_DONE")), c("best").cast(_ACTION), c("ordinal"), F.when(c("n_named") == 1, c("named")).cast(_ACTION), F.when(known, finish("SATISFIED")), finish("NO_RULE"),
    )))
    rules = F.array(*[F.lit(r) for r in RULES])
    return both.select("snapshot_id", best.alias("a")).select("snapshot_id", F.get(rules, c("a.rule_no")).alias("rule"), c("a.type").alias("type"), c("a.id").alias("element_id"), c("a.handle").alias("handle"), c("a.option").alias("option"))


def planned(elements: DataFrame, tasks: DataFrame, planner: Callable[[DataFrame, DataFrame], DataFrame] = plan) -> DataFrame:
    """Actions of any planner (elements, tasks) -> actions, each with an id of its own. The ids are random."""
    return planner(elements, tasks).withColumn("action_id", F.concat(F.lit("act_"), F.regexp_replace(F.expr("uuid()"), "-", "")))


def minimal(elements: DataFrame, columns: tuple[str, ...] = ("snapshot_id", "id", "role", "text", "label", "input_type", "value_handle", "enabled", "selected", "value_present", "options", "selected_option", "control_value", "dom_index", "bbox", "sources")) -> DataFrame:
    """Only the columns that a planner may see."""
    return elements.select(*[x for x in columns if x in elements.columns])


# Labels of a comparison screen.
FARE_LABEL, UNTRUSTED, NOTES = "Choose train ", "Untrusted page instruction", "Unrelated notes"


def is_fare_button() -> Column:
    return F.coalesce(c("enabled") & (c("role") == "button") & c("label").startswith(FARE_LABEL), F.lit(False))


def comparison_screen(elements: DataFrame, task: str) -> DataFrame:
    """The fare buttons, the untrusted instruction (cut to 320 characters) and the notes of a screen, with the task replaced."""
    kept = elements.filter(is_fare_button() | c("label").isin(UNTRUSTED, NOTES))
    return kept.withColumn("text", F.when(c("label") == UNTRUSTED, F.substring("text", 1, 320)).otherwise(c("text"))).withColumn("task", F.lit(task))


def in_scope(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds allowed: the action clicks a fare button of its own snapshot, whatever page text asks for."""
    fares = elements.filter(is_fare_button()).select("snapshot_id", c("id").alias("element_id"), F.lit(True).alias("fare_")).distinct()
    return actions.join(fares, ["snapshot_id", "element_id"], "left").withColumn("allowed", F.coalesce((c("type") == "CLICK") & c("fare_"), F.lit(False))).drop("fare_")


# Controls of a journey form that a device may read as they stand.
JOURNEY_CONTROLS = ("From", "To", "Travel class", "Quota", "Journey month", "Passenger age", "Passenger gender", "Berth preference")
_DATE_BUTTON = r"^(?:Choose journey date|(?:Selected journey date|Journey date) \d{4}-\d{2}-\d{2})$"


def local_overlay(sanitised: DataFrame, local: DataFrame) -> DataFrame:
    """Sanitised elements with label, options and selection of the local ones, for visible and enabled journey controls of the same role
    alone; every other element stays as it is."""
    seen = local.filter(c("visible") & c("enabled")).select(
        "snapshot_id", "id", "role", c("tag").alias("tag_"), c("label").alias("label_"), c("options").alias("options_"), c("selected_option").alias("selected_")
    )
    both = sanitised.join(seen, ["snapshot_id", "id", "role"], "left")
    select = F.coalesce((c("role") == "combobox") & (c("tag_") == "select") & c("label_").isin(*JOURNEY_CONTROLS), F.lit(False))
    date = F.coalesce((c("role") == "button") & (c("tag_") == "button") & c("label_").rlike(_DATE_BUTTON), F.lit(False))
    put = lambda name, value, when: F.when(when, c(value)).otherwise(c(name)).alias(name)
    changed = {"label": put("label", "label_", select | date), "options": put("options", "options_", select), "selected_option": put("selected_option", "selected_", select)}
    return both.select(*[changed.get(x, c(x)) for x in sanitised.columns])


def with_target(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds target: role, text and label of the action's element, as its signature is made of them; null without one."""
    e = elements.select("snapshot_id", c("id").alias("element_id"), F.concat_ws("|", "role", "text", "label").alias("target"))
    return actions.join(e, ["snapshot_id", "element_id"], "left")


def fares(rows: DataFrame, morning: bool, by: str) -> DataFrame:
    """Departures (departure HH:MM, fare), before noon if `morning`, in order of fare or departure, with the total to pay."""
    kept = rows.filter(F.substring("departure", 1, 2).cast("int") < 12) if morning else rows
    return kept.withColumn("total", total(c("fare"))).orderBy(by)


def total(fare: Column) -> Column:
    """A fare with the fixed fee."""
    return fare + 35


def is_passenger() -> Column:
    """A name of two characters or more, an e-mail address, ten digits of phone, an age from 1 to 120, gender and berth."""
    return F.coalesce(
        (F.length(F.trim("name")) >= 2) & c("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & c("phone").rlike(r"^[0-9]{10}$") & (c("age").try_cast("double") > 0) & (c("age").try_cast("double") <= 120)
        & (F.length("gender") > 0) & (F.length("berth") > 0), F.lit(False)
    )


def status() -> Column:
    """What an agent's state (error, phase, pending, delivery, running) says to its user, as a key; the first that applies."""
    phases = ("OBSERVE", "SANITIZE", "EXECUTE", "VERIFY")
    return (
        F.when(c("error").isNotNull() | (c("phase") == "FAILED"), "STOPPED_EARLY").when(c("phase") == "STOPPED", "STOPPED_BY_USER").when(c("phase") == "COMPLETE", "COMPLETE").when(c("pending"), "PERMISSION_NEEDED")
        .when(c("phase").isin(*phases), c("phase")).when(c("phase") == "PLAN", F.when(c("delivery") == "LOCAL_ONLY", "PLAN_ON_DEVICE").otherwise("PLAN_ON_SERVER")).when(c("running"), "STARTING").otherwise("IDLE")
    )


def story() -> Column:
    """The four steps of a run (previewed, delivery, verified, phase, running): label, place, done and active."""
    local = c("delivery") == "LOCAL_ONLY"
    active = lambda *phases: c("running") & c("phase").isin(*phases)
    step = lambda label, place, done, on: F.struct(F.lit(label).alias("label"), place.alias("place"), F.coalesce(done, F.lit(False)).alias("done"), F.coalesce(on, F.lit(False)).alias("active"))
    return F.array(
        step("Read", F.lit("Device"), c("previewed"), active("OBSERVE")), step("Hide", F.lit("Device"), c("previewed"), active("SANITIZE")),
        step("Plan", F.when(local, "Device").otherwise("Server"), local | (c("delivery") == "ACKNOWLEDGED"), active("PLAN")), step("Act", F.lit("Browser"), c("verified") > 0, active("EXECUTE", "VERIFY")),
    )


def limited(steps: DataFrame, by: str, order: list[str], at: str, waited: str, most_steps: int = 40, most_ms: int = 120_000) -> DataFrame:
    """Adds outcome: STEP_LIMIT beyond `most_steps`, DEADLINE beyond `most_ms` after the first step, the time spent waiting for consent
    before (column `waited`, in ms) not counted; else RUN."""
    w = Window.partitionBy(by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    now = F.unix_millis(c(at).cast("timestamp"))
    spent = now - F.first(now).over(w) - F.coalesce(F.sum(waited).over(before), F.lit(0))
    return steps.withColumn("outcome", F.when(F.row_number().over(w) > most_steps, "STEP_LIMIT").when(spent > most_ms, "DEADLINE").otherwise("RUN"))


def confirmed(requests: DataFrame, answers: DataFrame, most_ms: int = 300_000) -> DataFrame:
    """request_id and whether its first answer (request_id, generation, at, yes) came within `most_ms` of the request (request_id,
    generation, at), in the same generation, and was yes. Unanswered requests are not confirmed."""
    first = answers.groupBy("request_id").agg(F.min_by(F.struct("generation", "at", "yes"), "at").alias("a"))
    ok = (c("a.generation") == c("generation")) & (F.unix_millis(c("a.at").cast("timestamp")) - F.unix_millis(c("at").cast("timestamp")) < most_ms) & (c("a.at") >= c("at")) & c("a.yes")
    return requests.join(first, "request_id", "left").select("request_id", F.coalesce(ok, F.lit(False)).alias("confirmed"))


def grants(events: DataFrame, scope: str = "session_id", order: str = "seq") -> DataFrame:
    """Adds granted to the RESOLVE events of a vault's log (scope, handle, kind APPROVE, RESOLVE or REVOKE, seq): an approval serves one
    resolution of its handle, and a revocation ends all approvals of its scope."""
    every = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(scope, "handle").orderBy(order)
    rows = events.withColumn("revoked_", F.max(F.when(c("kind") == "REVOKE", c(order))).over(every))
    calls = rows.filter("kind <> 'REVOKE'").withColumn("was_", F.lag("kind").over(own)).withColumn("was_at_", F.lag(order).over(own))
    good = (c("was_") == "APPROVE") & (c("revoked_").isNull() | (c("was_at_") > c("revoked_")))
    return calls.filter("kind = 'RESOLVE'").withColumn("granted", F.coalesce(good, F.lit(False))).drop("revoked_", "was_", "was_at_")


def page_signature(page: DataFrame) -> Column:
    """fp_ and the 32-bit FNV-1a hash of the JSON of origin, url, viewport {width, height} and elements (a list of structs)."""
    from sluice.functions.text import fnv1a

    one = lambda x: F.regexp_replace(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"^\[|\]$", "")
    many = lambda x: F.coalesce(F.to_json(x), F.lit("null"))
    fields = ("id", "role", "input_type", "text", "label", "enabled", "selected", "value_present")
    row = lambda e: F.concat(F.lit("["), F.concat_ws(",", *[one(e[f]) for f in fields], many(e["options"]), one(e["selected_option"]), one(e["control_value"])), F.lit("]"))
    body = F.concat(
        F.lit('{"origin":'), one(c("origin")), F.lit(',"url":'), one(c("url")), F.lit(',"viewport":'), F.to_json("viewport"), F.lit(',"elements":['), F.array_join(F.transform("elements", row), ","), F.lit("]}"),
    )
    return F.concat(F.lit("fp_"), fnv1a(body))


def fingerprint_changes(snapshots: DataFrame, by: str, order: list[str], at: str, acted: Column, most_ms: int = 1500) -> DataFrame:
    """Successive snapshots (with a fingerprint) of a session: adds changed (differs from the one before; null for the first), and for snapshots on
    which an action was taken (`acted`) the outcome: CHANGED if a later one differs within `most_ms`, with waited_ms to the first that does, UNCHANGED if there
    are later ones but none differs in time, null if there is none. Null fingerprints equal each other."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = snapshots.withColumn("changed", F.when(F.row_number().over(w) > 1, ~c("fingerprint").eqNullSafe(F.lag("fingerprint").over(w))))
    # Snapshots of one fingerprint in a row are a run; the first that differs from any of them begins the next one.
    rows = rows.withColumn("run_", F.sum(F.coalesce(c("changed"), F.lit(False)).cast("int")).over(w)).withColumn("ms_", F.unix_millis(c(at).cast("timestamp")))
    rows = rows.withColumn("later_", F.lead("run_").over(w).isNotNull())
    begins = rows.filter(F.coalesce("changed", F.lit(False))).select(c(by).alias("by_"), (c("run_") - 1).alias("before_"), c("ms_").alias("next_ms_"))
    both = rows.join(begins, c(by).eqNullSafe(c("by_")) & (c("run_") == c("before_")), "left")
    wait = c("next_ms_") - c("ms_")
    acted = F.coalesce(acted, F.lit(False))
    outcome = F.when(acted & (wait <= most_ms), "CHANGED").when(acted & c("later_"), "UNCHANGED")
    return both.withColumn("outcome", outcome).withColumn("waited_ms", F.when(c("outcome") == "CHANGED", wait)).drop("run_", "ms_", "later_", "by_", "before_", "next_ms_")
