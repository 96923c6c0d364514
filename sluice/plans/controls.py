"""Queries of the element, guard, rank and report operators over page controls made from the tables, with their SQL.

Each row of `part` stands for a control of a page snapshot of ten; orders, events, conversations and customers stand for
actions, samples, tasks and private values. The same expressions make the rows in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import elements, evaluate, evidence, guard, rank, spatial, tasks
from sluice.operators.spread import spread

c = F.col


def _pick(by: str, values: tuple[str | None, ...]) -> str:
    return f"CASE ({by}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


_DIV = "CAST(floor(p_partkey / {}.0) AS BIGINT)"
_TAGS = ("input", "button", "select", "textarea", "a", "h2", "div", "img")
_KINDS = ("email", "tel", "password", "text", "search", "checkbox", "radio", "submit", "range")
_LABELS = ("Email address", "Mobile number", "Full name", "First name", "Last name", "Home address", "UPI ID", "User name", "Search", "Password", "Text input", "Notes", "Submit order", None)
_TASKS = (
    "Fill the email and press continue", "Check the second checkbox and uncheck the 3rd radio button", "Do not click Submit order", "Type the phone number LOCAL_PHONE_1", "click the small ring", "Never press submit, find the cheapest red widget", "Please place the order",
)
#: Columns of a control; the second step reads those of the first. {list} opens an array.
_FIRST = {
    "k": "p_partkey", "snapshot_id": f"'snap_' || CAST({_DIV.format(10)} AS STRING)", "id": "'el_' || CAST(p_partkey AS STRING)", "tag": _pick(f"p_partkey + {_DIV.format(10)}", _TAGS), "label": _pick(f"p_partkey + {_DIV.format(14)}", _LABELS),
    "text": "CASE WHEN p_partkey % 6 <> 1 THEN p_name END", "enabled": "p_partkey % 9 <> 0", "visible": "p_partkey % 8 <> 0", "selected": "p_partkey % 4 = 1", "value_present": "p_partkey % 3 = 0", "dom_index": "CAST(p_partkey % 10 AS INT)",
    "given": "CASE WHEN p_partkey % 11 = 0 THEN 'tab' WHEN p_partkey % 11 = 1 THEN '  ' END", "kind": _pick(_DIV.format(7), _KINDS), "p_brand": "p_brand", "p_type": "p_type", "price": "'Rs. ' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)",
    "x": "CAST((p_partkey % 10) * 40 AS DOUBLE)", "y": "CAST(p_size * 3 AS DOUBLE)", "w": "CAST(30 + p_partkey % 50 AS DOUBLE)", "h": "CAST(10 + p_size % 17 AS DOUBLE)", "task": _pick(_DIV.format(10), _TASKS),
}
_SECOND = {
    "input_type": "CASE WHEN tag = 'input' THEN kind END", "options": "CASE WHEN tag = 'select' THEN {list}(price, p_brand, p_type) END", "selected_option": "CASE WHEN tag = 'select' AND k % 2 = 0 THEN p_brand END",
    "control_value": "CASE WHEN k % 5 = 0 THEN p_type END", "sources": "CASE WHEN k % 10 = 9 THEN {list}('OCR') WHEN k % 4 = 0 THEN {list}('DOM', 'OCR') ELSE {list}('DOM') END", "value": "CASE WHEN tag = 'input' AND k % 3 = 0 THEN p_brand WHEN k % 3 = 1 THEN ' ' END",
}
_ROLE = (
    "CASE WHEN trim(coalesce(given, '')) <> '' THEN trim(given) WHEN tag = 'a' THEN 'link' WHEN tag = 'button' THEN 'button' WHEN tag = 'select' THEN 'combobox' WHEN tag = 'textarea' THEN 'textbox' WHEN tag = 'img' THEN 'img' "
    "WHEN tag = 'input' AND input_type = 'submit' THEN 'button' WHEN tag = 'input' AND input_type IN ('checkbox', 'radio') THEN input_type WHEN tag = 'input' AND input_type = 'range' THEN 'slider' WHEN tag = 'input' THEN 'textbox' WHEN tag = 'h2' THEN 'heading' ELSE tag END"
)
_BASE = "SELECT *, " + ", ".join(f"{v} AS {n}" for n, v in _SECOND.items()).replace("{list}", "list_value") + " FROM (SELECT " + ", ".join(f"{v} AS {n}" for n, v in _FIRST.items()) + " FROM part)"
#: The controls in SQL, for use as `WITH el AS (...)`.
EL = f"WITH el AS (SELECT *, {_ROLE} AS role FROM ({_BASE}))"


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey").selectExpr(*[f"{v} AS {n}" for n, v in _FIRST.items()])
    rows = part.selectExpr("*", *[f"{v.replace('{list}', 'array')} AS {n}" for n, v in _SECOND.items()])
    box = F.struct(c("x"), c("y"), c("w").alias("width"), c("h").alias("height"))
    return rows.withColumn("role", elements.inferred_role(c("given"), c("tag"), c("input_type"))).withColumn("bbox", box).withColumn("value_handle", F.when(c("k") % 17 == 0, "LOCAL_EMAIL_1"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls(spark, sf_dir).select("snapshot_id", "task").distinct()


def element_roles(spark, sf_dir):
    return controls(spark, sf_dir).groupBy("tag", "role").agg(F.count("*").alias("n"))


def handle_kinds(spark, sf_dir):
    return controls(spark, sf_dir).select(elements.handle_kind(c("input_type"), c("label")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def field_kinds(spark, sf_dir):
    kinds = F.array_join(F.array_sort(elements.element_kinds(c("input_type"), c("label"), c("text"))), ",")
    return controls(spark, sf_dir).groupBy(kinds.alias("kinds")).agg(F.count("*").alias("n"))


def private_value_rows(spark, sf_dir):
    plain, side = elements.private_values(controls(spark, sf_dir))
    return side.groupBy("input_type").agg(F.count("*").alias("n"), F.count_if(F.lit("value" in plain.columns)).alias("leaked"))


def masked_inputs(spark, sf_dir):
    return controls(spark, sf_dir).groupBy("tag").agg(F.count_if(elements.is_masked_input()).alias("masked"))


def compact_elements(spark, sf_dir):
    j = lambda p: F.get_json_object("compact", f"$.{p}")
    return elements.compact(controls(spark, sf_dir)).select("id", j("text").alias("text"), j("label").alias("label"), j("options[1]").alias("option_1"), j("value_present").alias("value_present"), j("bbox.width").cast("double").alias("width"), c("compact").contains("null").alias("nulls"))


def risky_controls(spark, sf_dir):
    kind = F.when(c("k") % 5 == 0, "TYPE_HANDLE").otherwise("CLICK")
    found = controls(spark, sf_dir).select(kind.alias("kind"), elements.is_high_risk(kind, c("label"), elements.RISKY_VERBS).alias("risky"), elements.is_actionable().alias("actionable"))
    return found.groupBy("kind", "risky", "actionable").agg(F.count("*").alias("n"))


def contextual_kinds(spark, sf_dir):
    placeholder = F.concat(F.lit("["), F.element_at(F.array(*[F.lit(x) for x in _PLACED]), (c("k") % len(_PLACED) + 1).cast("int")), F.lit("_"), c("k") % 7, F.lit("]"))
    rows = controls(spark, sf_dir).withColumn("placeholder", placeholder)
    safe = elements.is_safe_control(F.lit("LABEL"), c("role"), c("tag"), c("label"), F.array("placeholder"))
    return rows.groupBy(elements.contextual_type(c("placeholder")).alias("type"), F.coalesce(safe, F.lit(False)).alias("safe")).agg(F.count("*").alias("n"))


_PLACED = ("GIVEN_NAME", "SURNAME", "PHONE", "EMAIL", "CREDIT_CARD", "BANK_ACCOUNT", "STREET_NAME", "TAX_ID")


def metadata_hits(spark, sf_dir):
    """Private values of controls whose labels tell the kind; every fifth already has a text hit."""
    rows = controls(spark, sf_dir)
    plain, side = elements.private_values(rows)
    told = rows.filter("k % 5 = 0").select("snapshot_id", c("id").alias("element_id"), F.lit("PRIVATE_VALUE").alias("field"), F.lit("EMAIL").alias("type"))
    return elements.metadata_entities(plain, side.drop("input_type").join(rows.select("snapshot_id", c("id").alias("element_id"), "input_type"), ["snapshot_id", "element_id"]), told).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.length("raw_value") > 0).alias("with_value"))


def attached_handles(spark, sf_dir):
    rows = controls(spark, sf_dir)
    vault = rows.select("snapshot_id").distinct().select("snapshot_id", F.lit("EMAIL").alias("kind"), F.lit("LOCAL_EMAIL_7").alias("handle"))
    return elements.attach_handles(rows.drop("value_handle", "task"), _tasks(spark, sf_dir), vault).filter("value_handle is not null").groupBy("value_handle").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def options_redacted(spark, sf_dir):
    """The selected option's text after redaction, and the cheapest option of each list."""
    rows = controls(spark, sf_dir).filter("tag = 'select'")
    redacted = F.transform("options", lambda o: F.upper(o))
    return rows.select("id", elements.remapped_option(c("options"), redacted, c("selected_option")).alias("selected"), elements.lowest_price(F.concat("options", F.array(F.lit("$ 950"), F.lit("$ 950.0 again"))), tx.price).alias("cheapest"))


def screen_summaries(spark, sf_dir):
    got = elements.screen_summary(controls(spark, sf_dir))
    return got.select("snapshot_id", "interactive", "visual", F.array_join("names", "|").alias("names"), F.array_join("readings", "|").alias("readings"))


def box_measures(spark, sf_dir):
    """Neighbouring controls of a snapshot: common area, share of the smaller, and union ratio."""
    rows = controls(spark, sf_dir).select("snapshot_id", "dom_index", "bbox")
    right = rows.select("snapshot_id", (c("dom_index") - 1).alias("dom_index"), c("bbox").alias("other"))
    both = rows.join(right, ["snapshot_id", "dom_index"])
    cut = spatial.clipped(spatial.rescaled(c("bbox"), F.lit(1.5), F.lit(0.5), 2.0, 1.0, 3.0), F.lit(500), F.lit(60))
    return both.select("snapshot_id", "dom_index", F.round(spatial.intersection(c("bbox"), c("other")), 6).alias("common"), F.round(spatial.overlap_ratio(c("bbox"), c("other")), 6).alias("of_smaller"), F.round(spatial.iou(c("bbox"), c("other")), 6).alias("iou"), (cut["right"] - cut["left"]).alias("px_wide"), (cut["bottom"] - cut["top"]).alias("px_high"))


def fused_screens(spark, sf_dir):
    """Page controls take the sources of the pixel records that lie on them; records on none stay."""
    rows = controls(spark, sf_dir)
    pixels = rows.filter("k % 3 = 0").withColumn("id", F.concat(F.lit("px_"), "k")).withColumn("sources", F.when(c("k") % 2 == 0, F.array(F.lit("VISION"))).otherwise(F.array(F.lit("OCR")))).withColumn("dom_index", c("dom_index") + 100)
    return spatial.fuse(rows.filter("k % 3 <> 1"), pixels).groupBy(F.array_join("sources", ",").alias("sources"), F.substring("id", 1, 2).alias("kind")).agg(F.count("*").alias("n"))


def region_caps(spark, sf_dir):
    rows = controls(spark, sf_dir).withColumn("region_no", c("dom_index"))
    return spatial.capped_regions(rows).groupBy("outcome").agg(F.count("*").alias("n"), F.min("region_no").alias("least"))


def planning_priorities(spark, sf_dir):
    return rank.ranked(controls(spark, sf_dir).drop("task"), _tasks(spark, sf_dir)).select("snapshot_id", "id", "score", "rank")


def budgeted_controls(spark, sf_dir):
    """A budget of 120 characters for controls of 10 to 58: what does not fit is passed over."""
    rows = controls(spark, sf_dir).drop("task").withColumn("compact", F.repeat(F.lit("x"), (10 + c("k") % 49).cast("int")))
    return rank.budgeted(rows, _tasks(spark, sf_dir), 120, 4).groupBy("snapshot_id").agg(F.count("*").alias("n"), F.sum(F.length("compact")).cast("long").alias("chars"))


def ordinal_controls(spark, sf_dir):
    rows = controls(spark, sf_dir).withColumn("role", F.when(c("k") % 2 == 0, "checkbox").otherwise("radio"))
    return rank.ordinal_targets(rows, _tasks(spark, sf_dir)).select("snapshot_id", "request_no", "id", "selected", "desired")


def named_controls(spark, sf_dir):
    """The control whose name a task mentions, the longest name first."""
    rows = controls(spark, sf_dir).drop("task").filter("text is not null")
    return rank.longest_named(rows, _tasks(spark, sf_dir), "text").select("snapshot_id", "id", c("text").alias("name"))


def prohibited_buttons(spark, sf_dir):
    rows = controls(spark, sf_dir)
    return rows.groupBy("task", "label").agg(F.count("*").alias("n"), F.bool_or(guard.button_prohibited(c("task"), c("label"))).alias("prohibited"))


def pending_buttons(spark, sf_dir):
    rows = controls(spark, sf_dir).withColumn("role", F.lit("button")).drop("task")
    return guard.pending_button(rows, _tasks(spark, sf_dir)).groupBy("pending").agg(F.count("*").alias("n"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as actions on controls."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[f"{v} AS {n}" for n, v in _ACTION.items()])


_ACTION = {
    "n": "o_orderkey", "action_id": "CASE WHEN o_orderkey % 31 = 0 THEN 'bad_' ELSE 'act_' END || CAST(o_orderkey AS STRING)", "session_id": "'s_' || CAST(o_custkey AS STRING)",
    "snapshot_id": "'snap_' || CAST(CAST(floor((o_custkey % 190) / 10.0) AS BIGINT) AS STRING)", "type": _pick("o_orderkey", ("CLICK", "TYPE_HANDLE", "SELECT", "SCROLL", "FINISH", "NONE")),
    "element_id": "CASE WHEN o_orderkey % 6 < 3 THEN 'el_' || CAST(o_custkey % 190 AS STRING) END", "handle": "CASE WHEN o_orderkey % 6 = 1 THEN CASE WHEN o_custkey % 17 = 0 THEN 'LOCAL_EMAIL_1' ELSE 'LOCAL_EMAIL_2' END END", "option": "CASE WHEN o_orderkey % 6 = 2 THEN 'ECONOMY' END",
    "direction": "CASE WHEN o_orderkey % 6 = 3 THEN 'DOWN' END", "amount": "CASE WHEN o_orderkey % 6 = 3 THEN CAST(o_orderkey % 6000 AS INT) END", "question": "CASE WHEN o_orderkey % 12 = 5 THEN 'which' END", "summary": "CASE WHEN o_orderkey % 6 = 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'It could not be done' ELSE 'Done' END END",
}
_ACT = "WITH act AS (SELECT " + ", ".join(f"{v} AS {n}" for n, v in _ACTION.items()) + " FROM orders)"


def valid_actions(spark, sf_dir):
    return _actions(spark, sf_dir).groupBy("type").agg(F.count_if(guard.action_valid()).alias("valid"), F.count("*").alias("n"), F.count_if(F.coalesce(guard.blocked_finish(F.lit(None).cast("string"), c("summary")), F.lit(False))).alias("blocked"))


def grounded_actions(spark, sf_dir):
    acts = _actions(spark, sf_dir)
    latest = acts.groupBy("session_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    return guard.grounding(acts, latest, controls(spark, sf_dir)).groupBy("type", "error").agg(F.count("*").alias("n"))


def fill_gates(spark, sf_dir):
    rows = _actions(spark, sf_dir).selectExpr(*[f"{v} AS {n}" for n, v in _FILL.items()])
    return rows.groupBy(guard.fill_gate().alias("outcome")).agg(F.count("*").alias("n"))


_FILL = {
    "valid": "n % 13 <> 0", "type": "CASE WHEN n % 11 = 0 THEN 'CLICK' ELSE 'TYPE_HANDLE' END", "is_current": "n % 17 <> 0", "document_id": "CASE WHEN n % 19 = 0 THEN '' ELSE 'd' END", "context_origin": "'o'", "local_origin": "CASE WHEN n % 23 = 0 THEN 'p' ELSE 'o' END",
    "action_snapshot": "'s'", "local_snapshot": "'s'", "context_snapshot": "CASE WHEN n % 29 = 0 THEN 't' ELSE 's' END", "enabled": "n % 7 <> 0", "visible": "true", "value_handle": "'LOCAL_EMAIL_1'", "handle": "CASE WHEN n % 5 = 0 THEN NULL ELSE 'LOCAL_EMAIL_1' END",
    "tag": "CASE WHEN n % 3 = 0 THEN 'div' ELSE 'input' END", "role": "'textbox'", "input_type": "CASE WHEN n % 6 = 0 THEN 'text' ELSE 'email' END", "confirmed": "n % 4 <> 0", "preflight_error": "CASE WHEN n % 37 = 0 THEN 'BLOCKED' END", "still_current": "n % 41 <> 0",
}


def deliveries(spark, sf_dir):
    rows = _actions(spark, sf_dir).select((c("n") % 2 == 0).alias("used_server"), (c("n") % 3 == 0).alias("dispatched"), (c("n") % 5 == 0).alias("acknowledged"), (c("n") % 7 == 0).alias("failed"))
    return rows.groupBy(guard.delivery_status().alias("status")).agg(F.count("*").alias("n"))


def stale_actions(spark, sf_dir):
    """An action is stale unless its snapshot, origin and fingerprint are those of the last event of its user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = e.select(c("user_id").alias("session_id"), c("event_type").alias("snapshot_id"), F.lit("o").alias("origin"), F.substring("props", 1, 7).alias("fingerprint"), c("event_id").alias("step"))
    return guard.staleness(seen, seen).groupBy("session_id").agg(F.count_if("stale").alias("stale"), F.count("*").alias("n"))


def grant_scopes(spark, sf_dir):
    """Hashes that bind a grant; the JSON keeps nulls."""
    return _actions(spark, sf_dir).select("n", guard.release_scope("action_id", "element_id", "handle").alias("scope"))


def known_secret_leaks(spark, sf_dir):
    """Customer names as payloads, names of those with a key divisible by 40 as secrets."""
    people = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")
    payloads = people.select(c("c_custkey").alias("payload_id"), F.concat(c("c_mktsegment"), F.lit(" of "), c("c_name"), F.lit(" and "), F.lit("Customer#000000040")).alias("payload"))
    found = guard.leaks(payloads, people.filter("c_custkey % 40 = 0").select(c("c_name").alias("secret")))
    return found.groupBy("secret_sha256").agg(F.count("*").alias("n"), F.min("payload_id").alias("first_id"))


def outbound_assertions(spark, sf_dir):
    """Payloads with keys that are forbidden but in the summary, and with text that holds obvious secrets."""
    rows = _actions(spark, sf_dir)
    key = F.when(c("n") % 4 == 0, "auth_token").when(c("n") % 4 == 1, "note").when(c("n") % 4 == 2, "Cookie").otherwise("kind")
    human = F.when(c("n") % 9 == 0, F.concat(F.lit("write to a"), c("n"), F.lit("@mail.example"))).otherwise("nothing")
    payload = F.concat(F.lit('{"'), key, F.lit('":"x","privacy_summary":{"OTP":2},"text":"'), human, F.lit('"}'))
    told = guard.outbound(rows.select("n", payload.alias("payload"), human.alias("human")), "payload", "human")
    return told.groupBy("status", "reason").agg(F.count("*").alias("n"))


def session_resources(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("rss", (c("value") * 100).cast("long"))
    return evaluate.resources(e, ["event_type"], "rss", "value").join(e.groupBy("event_type").agg(F.round(evaluate.clamped_sum(c("value") - 5), 4).alias("over_five")), "event_type")


def control_recall(spark, sf_dir):
    """Controls found of those expected in each scenario, and in all: the ratio of sums."""
    rows = controls(spark, sf_dir).groupBy(c("tag").alias("scenario")).agg(F.count_if("enabled").alias("found"), F.count("*").alias("expected"))
    return evaluate.ratio_of_sums(rows, ["scenario"], "found", "expected").unionByName(evaluate.ratio_of_sums(rows.withColumn("scenario", F.lit("all")), ["scenario"], "found", "expected"))


def removal_report(spark, sf_dir):
    """Cases: parts with a label are critical; predicted types lose every seventh and gain a false one in every tenth without."""
    rows = controls(spark, sf_dir).select(
        c("id").alias("case_id"), c("label").isNotNull().alias("critical"), F.when(c("label").isNotNull(), F.array(F.lit("LABEL"))).otherwise(F.array().cast("array<string>")).alias("expected"),
        F.when(c("label").isNotNull() & (c("k") % 7 != 0), F.array(F.lit("LABEL"))).when(c("label").isNull() & (c("k") % 10 == 0), F.array(F.lit("OTHER"))).otherwise(F.array().cast("array<string>")).alias("predicted"),
    )
    return evaluate.case_report(rows)


def pixel_report(spark, sf_dir):
    """Boxes as sensitive areas, shifted ones as masks: recall of sensitive pixels, and the share of others left alone."""
    rows = controls(spark, sf_dir).select("tag", (c("w") * c("h")).alias("sensitive"), spatial.intersection(c("bbox"), spatial.rescaled(c("bbox"), F.lit(1.0), F.lit(1.0), 3.0, 2.0)).alias("covered"), (c("w") * c("h")).alias("masked"), F.lit(20000.0).alias("pixels"))
    return evaluate.pixel_coverage(rows, ["tag"])


def evidence_maps(spark, sf_dir):
    """Entities of controls summed to maps of type to count."""
    rows = controls(spark, sf_dir).select("snapshot_id", F.coalesce("label", F.lit("OTHER")).alias("type"), F.lit("DOM").alias("source"), F.lit(0.9).alias("confidence"), c("p_brand").alias("raw_value"), c("id").alias("element_id"))
    m = evidence.as_maps(evidence.summarise(rows, ["snapshot_id"], False), ["snapshot_id"])
    text = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("snapshot_id", text("unique_items").alias("unique_items"), text("detector_hits").alias("detector_hits"), F.size("review_items").alias("in_review"), F.aggregate(F.map_values("detector_hits"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def blocked_visuals(spark, sf_dir):
    rows = controls(spark, sf_dir).select("tag", F.lit("VISUAL").alias("field"), F.when(c("k") % 3 == 0, "DROP").otherwise("ABSTRACT").alias("decision"), F.when(c("k") % 2 == 0, c("p_brand")).alias("evidence_id"), c("id").alias("region_id"))
    return evidence.blocked_regions(rows, ["tag"])


def clarified_tasks(spark, sf_dir):
    """Tasks with the last three turns of a conversation as answers, and whether a comparison word is lost."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("answers"))
    task = F.concat(F.lit("Find the cheapest "), c("conv_id"))
    return turns.select("conv_id", F.sha2(tasks.with_clarifications(task, c("answers"), 900), 256).alias("task_sha256"), tasks.comparison_lost(task, F.when(c("conv_id") % 2 == 0, task).otherwise("Find it")).alias("lost"))


def marked_segments(spark, sf_dir):
    text = F.concat(c("text"), F.lit(" <EMAIL>"), c("p_brand"), F.lit("[GIVEN_NAME_1] LOCAL_PHONE_"), c("k"))
    rows = controls(spark, sf_dir).filter("text is not null").select("id", text.alias("whole_text")).withColumn("parts", tasks.segments(c("whole_text")))
    join = lambda xs, by: F.array_join(F.transform(xs, lambda s: s["part"]), by)
    return rows.select("id", F.size("parts").alias("parts"), join(F.filter("parts", lambda s: s["is_marker"]), "|").alias("markers"), (join(c("parts"), "") == c("whole_text")).alias("whole"))


def grouped_names(spark, sf_dir):
    """Spans that only blanks, commas or hyphens part become one item."""
    rows = controls(spark, sf_dir).filter("text is not null").select("id", F.concat(c("text"), F.lit(", "), c("p_brand"), F.lit(" is "), c("p_type")).alias("text"), F.length("text").alias("a"), F.length("p_brand").alias("b"), F.length("p_type").alias("d"))
    span = lambda x, y: F.struct(F.lit("PERSON_NAME").alias("type"), x.cast("int").alias("start"), y.cast("int").alias("stop"))
    spans = rows.select("id", "text", F.explode(F.array(span(F.lit(0), c("a")), span(c("a") + 2, c("a") + 2 + c("b")), span(c("a") + c("b") + 6, c("a") + c("b") + 6 + c("d")))).alias("s")).select("id", "text", "s.*")
    return tasks.grouped_spans(spans, ["id"]).groupBy("id").agg(F.countDistinct("group_start").alias("items"), F.max(c("group_stop") - c("group_start")).alias("longest"))


def formatted_metrics(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    bytes_ = c("p_size").cast("long") * 7_654_321
    return p.select("p_partkey", tx.share(F.when(c("p_partkey") % 5 != 0, c("p_size") / F.lit(64))).alias("share"), tx.seconds(c("p_partkey") * 10).alias("seconds"), tx.mebibytes(bytes_).alias("mebibytes"), tx.gibibytes(bytes_).alias("gibibytes"), tx.price(F.concat(F.lit("only ₹ "), F.format_number("p_retailprice", 2))).alias("price"))


def journey_dates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    iso = F.when(c("o_orderkey") % 10 == 0, "2026-02-30").when(c("o_orderkey") % 10 == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.groupBy(tx.is_iso_date(iso).alias("valid"), tx.month_label(F.when(F.coalesce(tx.is_iso_date(iso), F.lit(False)), iso)).alias("month")).agg(F.count("*").alias("n"))


def scrubbed_logs(spark, sf_dir):
    """Metadata of events with the values of telling keys replaced."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = tx.scrubbed(F.create_map(F.lit("user"), c("user_id").cast("string"), F.lit("auth_token"), c("event_type"), F.lit("rawText"), c("event_type"), F.lit("kind"), c("event_type")))
    return e.groupBy(m["user"].alias("user"), m["auth_token"].alias("token"), m["rawText"].alias("raw"), m["kind"].alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        element_roles, handle_kinds, field_kinds, private_value_rows, masked_inputs, compact_elements, risky_controls, contextual_kinds, metadata_hits, attached_handles, options_redacted, screen_summaries, box_measures, fused_screens,
        region_caps, planning_priorities, budgeted_controls, ordinal_controls, named_controls, prohibited_buttons, pending_buttons, valid_actions, grounded_actions, fill_gates, deliveries, stale_actions, grant_scopes,
        known_secret_leaks, outbound_assertions, session_resources, control_recall, removal_report, pixel_report, evidence_maps, blocked_visuals, clarified_tasks, marked_segments, grouped_names, formatted_metrics, journey_dates, scrubbed_logs,
    )
}


def _kind_sql(label: str = "lower(coalesce(label, ''))") -> str:
    has = lambda w: f"contains({label}, '{w}')"
    t = "coalesce(input_type, '')"
    return (
        f"CASE WHEN {t} = 'email' OR {has('email')} THEN 'EMAIL' WHEN {t} = 'tel' OR {has('phone')} OR {has('mobile')} THEN 'PHONE' WHEN {t} = 'password' OR {has('password')} THEN 'PASSWORD' WHEN {has('upi')} THEN 'UPI_ID' "
        f"WHEN {has('first name')} THEN 'GIVEN_NAME' WHEN {has('last name')} THEN 'SURNAME' WHEN {has('address')} THEN 'ADDRESS' WHEN {has('username')} OR {has('user name')} THEN 'USERNAME' WHEN {has('name')} THEN 'PERSON_NAME' "
        f"WHEN {t} = 'search' OR {has('search')} THEN 'TEXT' WHEN {t} = 'text' AND {has('text input')} THEN 'TEXT' END"
    )


def _kinds_sql() -> str:
    has = lambda w: f"contains(name, '{w}')"
    t = "coalesce(input_type, '')"
    first = (
        f"[CASE WHEN {t} = 'email' OR {has('email')} THEN 'EMAIL' END, CASE WHEN {t} = 'tel' OR regexp_matches(name, '\\b(phone|mobile)\\b') THEN 'PHONE' END, CASE WHEN {t} = 'password' OR {has('password')} THEN 'PASSWORD' END, "
        f"CASE WHEN {has('first name')} THEN 'GIVEN_NAME' END, CASE WHEN {has('last name')} THEN 'SURNAME' END, CASE WHEN {has('first name')} OR {has('last name')} THEN 'PERSON_NAME' END]"
    )
    rest = (
        f"[CASE WHEN {has('full name')} OR ({has('name')} AND len(list_filter({first}, lambda v: v IS NOT NULL)) = 0) THEN 'PERSON_NAME' END, CASE WHEN {has('address')} THEN 'ADDRESS' END, CASE WHEN {has('upi')} THEN 'UPI_ID' END, CASE WHEN {has('otp')} THEN 'OTP' END, "
        f"CASE WHEN {has('username')} OR {has('user name')} THEN 'USERNAME' END, CASE WHEN {t} = 'search' OR {has('search')} OR {has('text input')} THEN 'TEXT' END]"
    )
    return f"array_to_string(list_sort(list_distinct(list_filter(list_concat({first}, {rest}), lambda v: v IS NOT NULL))), ',')"


_TASK = f"{EL}, t AS (SELECT DISTINCT snapshot_id, task FROM el)"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda v: length(v) >= {}))"
_SCORE = (
    "20 * len(list_intersect(" + _WORDS.format("t.task", 3) + ", " + _WORDS.format("concat_ws(' ', text, label, selected_option, control_value, array_to_string(coalesce(options, []), ' '))", 1) + ")) + CASE WHEN k % 17 = 0 THEN 1000 ELSE 0 END "
    "+ CASE WHEN input_type IS NOT NULL AND NOT value_present THEN 800 ELSE 0 END + CASE WHEN len(coalesce(options, [])) > 0 THEN 700 ELSE 0 END "
    "+ CASE WHEN role IN ('button', 'textbox', 'combobox', 'checkbox', 'radio', 'slider') THEN 500 WHEN role = 'link' THEN 100 ELSE 0 END - CASE WHEN NOT enabled THEN 200 ELSE 0 END"
)
_RANKED = f"{_TASK}, r AS (SELECT el.*, {_SCORE} AS score FROM el JOIN t USING (snapshot_id)), q AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, dom_index, id) AS rank FROM r)"
_SPAN = lambda a, b, s, n: f"greatest(0, least({a}.{s} + {a}.{n}, {b}.{s} + {b}.{n}) - greatest({a}.{s}, {b}.{s}))"
_NEG = r"(do\s+not|don''t|never)\s+(click\s+|press\s+)?(the\s+)?"
_BLOCKED = r"(?i)\b(cannot|can''t|could not|couldn''t|unable|failed|failure|not possible|not completed|incomplete|blocked)\b"
_ESCAPED = r"regexp_replace({}, '([.*+?^${{}}()|\[\]\\/-])', '\\\1', 'g')"

ORACLE_SQL = {
    "element_roles": f"{EL} SELECT tag, role, count(*) AS n FROM el GROUP BY tag, role",
    "handle_kinds": f"{EL} SELECT {_kind_sql()} AS kind, count(*) AS n FROM el GROUP BY 1",
    "field_kinds": f"{EL}, e AS (SELECT *, trim(regexp_replace(replace(lower(concat_ws(' ', label, text)), '-', ' '), '\\s+', ' ', 'g')) AS name FROM el) SELECT {_kinds_sql()} AS kinds, count(*) AS n FROM e GROUP BY 1",
    "private_value_rows": f"{EL} SELECT coalesce(input_type, 'text') AS input_type, count(*) AS n, 0::BIGINT AS leaked FROM el WHERE trim(value) <> '' GROUP BY 1",
    "masked_inputs": f"{EL} SELECT tag, count(*) FILTER (visible AND (input_type = 'password' OR (value_present AND (role = 'textbox' OR tag = 'textarea' OR (tag = 'input' AND input_type NOT IN ('checkbox', 'radio', 'submit', 'range')))))) AS masked FROM el GROUP BY tag",
    "compact_elements": f"{EL} SELECT id, text, label, options[2] AS option_1, value_present::VARCHAR AS value_present, w AS width, false AS nulls FROM el",
    "risky_controls": f"""{EL}, e AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'TYPE_HANDLE' ELSE 'CLICK' END AS what FROM el)
SELECT what AS kind, what = 'TYPE_HANDLE' OR coalesce(regexp_matches(label, '(?i)\\b({"|".join(elements.RISKY_VERBS)})\\b'), false) AS risky, enabled AND (len(coalesce(options, [])) > 0 OR role IN ('button', 'textbox', 'checkbox', 'radio')) AS actionable, count(*) AS n FROM e GROUP BY ALL""",
    "contextual_kinds": f"""{EL}, e AS (SELECT *, {_pick("k", _PLACED)} AS p FROM el)
SELECT CASE WHEN p IN ('GIVEN_NAME', 'SURNAME') THEN 'PERSON_NAME' WHEN p IN ('PHONE', 'EMAIL') THEN p WHEN p = 'CREDIT_CARD' THEN 'PAYMENT_CARD' WHEN p = 'BANK_ACCOUNT' THEN 'ACCOUNT_ID' WHEN p = 'STREET_NAME' THEN 'ADDRESS' ELSE 'OTHER' END AS type,
role IN ('combobox', 'checkbox', 'radio', 'button', 'option') AND NOT regexp_matches(coalesce(label, ''), '(?i)\\b(name|address)\\b') AND p IN ('GIVEN_NAME', 'SURNAME', 'STREET_NAME') AS safe, count(*) AS n FROM e GROUP BY ALL""",
    "metadata_hits": f"""{EL}, v AS (SELECT *, CASE WHEN input_type = 'password' THEN 'PASSWORD' WHEN {_kind_sql()} IN ('GIVEN_NAME', 'SURNAME', 'PERSON_NAME') THEN 'PERSON_NAME' WHEN {_kind_sql()} = 'ADDRESS' THEN 'ADDRESS' END AS type FROM el),
f AS (SELECT id, type, true AS with_value FROM v WHERE trim(value) <> '' AND k % 5 <> 0 AND type IS NOT NULL),
a AS (SELECT * FROM f UNION ALL SELECT id, 'PASSWORD', false FROM el WHERE input_type = 'password' AND id NOT IN (SELECT id FROM f WHERE type = 'PASSWORD'))
SELECT type, count(*) AS n, count(*) FILTER (with_value) AS with_value FROM a GROUP BY type""",
    "attached_handles": f"""{EL}, e AS (SELECT *, {_kind_sql()} AS what FROM el), g AS (SELECT *, sum((NOT value_present)::INT) OVER (PARTITION BY snapshot_id, what) AS empty FROM e),
h AS (SELECT *, CASE WHEN what = 'PHONE' AND contains(task, 'LOCAL_PHONE_1') THEN 'LOCAL_PHONE_1' END AS own, CASE WHEN what = 'EMAIL' THEN 'LOCAL_EMAIL_7' END AS vault,
regexp_matches(task, '(?i)\\b(fill|enter|type|use|add|provide)\\b') AND ((what = 'EMAIL' AND regexp_matches(task, '(?i)\\bemail\\b')) OR (what = 'PHONE' AND regexp_matches(task, '(?i)\\b(phone|mobile)\\b'))) AS asked FROM g)
SELECT coalesce(own, vault) AS value_handle, count(*) AS n, min(id) AS first_id FROM h WHERE NOT value_present AND what IS NOT NULL AND (own IS NOT NULL OR asked) AND empty = 1 AND coalesce(own, vault) IS NOT NULL GROUP BY 1""",
    "options_redacted": f"{EL} SELECT id, upper(selected_option) AS selected, CASE WHEN substr(price, 5)::BIGINT <= 950 THEN price ELSE '$ 950' END AS cheapest FROM el WHERE tag = 'select'",
    "screen_summaries": f"""{EL}, e AS (SELECT *, role IN ('button', 'link', 'textbox', 'combobox', 'checkbox', 'radio', 'switch', 'tab') AS inter, list_contains(sources, 'OCR') AS vis, trim(concat_ws(' ', label, text, control_value)) AS name FROM el),
f AS (SELECT *, count(*) FILTER (inter AND name <> '') OVER (PARTITION BY snapshot_id ORDER BY dom_index) AS nth FROM e),
w AS (SELECT snapshot_id, text, min(dom_index) AS seen FROM e WHERE vis AND text IS NOT NULL GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY seen) AS nth FROM w),
y AS (SELECT snapshot_id, string_agg(text, '|' ORDER BY nth) AS readings FROM x WHERE nth <= 6 GROUP BY snapshot_id)
SELECT snapshot_id, count(*) FILTER (inter) AS interactive, count(*) FILTER (vis) AS visual, coalesce(string_agg(name, '|' ORDER BY dom_index) FILTER (inter AND name <> '' AND nth <= 6), '') AS names, coalesce(any_value(readings), '') AS readings FROM f LEFT JOIN y USING (snapshot_id) GROUP BY snapshot_id""",
    "box_measures": f"""{EL}, p AS (SELECT a.snapshot_id, a.dom_index, {_SPAN("a", "b", "x", "w")} * {_SPAN("a", "b", "y", "h")} AS c, a.w * a.h AS p, b.w * b.h AS q, a.x * 1.5 - 1 AS l, a.y * 0.5 - 2 AS t, a.w * 1.5 + 6 AS wide, a.h * 0.5 + 6 AS high FROM el a JOIN el b ON a.snapshot_id = b.snapshot_id AND b.dom_index = a.dom_index + 1)
SELECT snapshot_id, dom_index, round(c, 6) AS common, round(c / least(p, q), 6) AS of_smaller, round(c / greatest(1, p + q - c), 6) AS iou, (least(500, ceil(l + wide)) - greatest(0, floor(l)))::INT AS px_wide, (least(60, ceil(t + high)) - greatest(0, floor(t)))::INT AS px_high FROM p""",
    "fused_screens": rf"""{EL}, e AS (SELECT *, trim(regexp_replace(lower(concat_ws(' ', text, label, control_value)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS name FROM el), d AS (SELECT * FROM e WHERE k % 3 <> 1), p AS (SELECT *, k % 2 = 0 AS vision FROM e WHERE k % 3 = 0),
m AS (SELECT d.snapshot_id, d.id, p.k AS pk, p.vision, p.dom_index AS pi FROM d JOIN p ON d.snapshot_id = p.snapshot_id AND {_SPAN("d", "p", "x", "w")} * {_SPAN("d", "p", "y", "h")} / least(d.w * d.h, p.w * p.h) >= 0.3
  AND CASE WHEN p.vision THEN d.role = 'img' OR d.tag = 'img' ELSE d.name <> '' AND p.name <> '' AND (contains(d.name, p.name) OR contains(p.name, d.name)) END),
s AS (SELECT id, list(CASE WHEN vision THEN 'VISION' ELSE 'OCR' END ORDER BY pi, 'px_' || pk) AS added FROM m GROUP BY id),
u AS (SELECT list_concat(sources, coalesce(added, [])) AS l, 'el' AS kind FROM d LEFT JOIN s USING (id) UNION ALL SELECT [CASE WHEN vision THEN 'VISION' ELSE 'OCR' END], 'px' FROM p WHERE k NOT IN (SELECT pk FROM m)),
v AS (SELECT kind, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM u)
SELECT array_to_string(l[1:3], ',') AS sources, kind, count(*) AS n FROM v GROUP BY ALL""",
    "region_caps": f"{EL} SELECT CASE WHEN dom_index < 8 THEN 'ANALYSED' ELSE 'PRIVATE_DOCUMENT' END AS outcome, count(*) AS n, min(dom_index) AS least FROM el GROUP BY 1",
    "planning_priorities": f"{_RANKED} SELECT snapshot_id, id, score::INT AS score, rank::INT AS rank FROM q",
    "budgeted_controls": f"""WITH RECURSIVE {_RANKED[5:]}, z AS (SELECT snapshot_id, rank, 10 + k % 49 AS size FROM q),
b AS (SELECT snapshot_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0::BIGINT AS n FROM (SELECT DISTINCT snapshot_id FROM q) UNION ALL
SELECT b.snapshot_id, z.rank, CASE WHEN b.n < 4 AND b.used + z.size <= 120 THEN b.used + z.size ELSE b.used END, CASE WHEN b.n < 4 AND b.used + z.size <= 120 THEN b.n + 1 ELSE b.n END FROM b JOIN z ON z.snapshot_id = b.snapshot_id AND z.rank = b.rank + 1)
SELECT snapshot_id, max(n) AS n, max(used) AS chars FROM b GROUP BY snapshot_id""",
    "ordinal_controls": f"""{_TASK}, e AS (SELECT snapshot_id, id, selected, CASE WHEN k % 2 = 0 THEN 'checkbox' ELSE 'radio' END AS what, row_number() OVER (PARTITION BY snapshot_id, k % 2 ORDER BY dom_index, id) - 1 AS nth FROM el WHERE enabled)
SELECT snapshot_id, r.no::INT AS request_no, id, selected, r.desired FROM t JOIN e USING (snapshot_id) JOIN (VALUES (0, 'checkbox', 1, true), (1, 'radio', 2, false)) r(no, what, nth, desired) USING (what, nth) WHERE contains(task, 'second checkbox')""",
    "named_controls": f"""{_TASK}, m AS (SELECT el.snapshot_id, id, text, row_number() OVER (PARTITION BY el.snapshot_id ORDER BY length(text) DESC, dom_index, id) AS nth FROM el JOIN t USING (snapshot_id) WHERE length(text) >= 2 AND regexp_matches(t.task, '(?i)\\b' || text || '\\b'))
SELECT snapshot_id, id, text AS name FROM m WHERE nth = 1""",
    "prohibited_buttons": rf"""{EL}, e AS (SELECT *, replace(lower(task), '-', ' ') AS t, trim(lower(label)) AS l FROM el)
SELECT task, label, count(*) AS n, bool_or(coalesce(regexp_matches(t, '(?i)\b{_NEG}["''“]?' || l || '\b') OR (contains(l, 'submit') AND regexp_matches(t, '(?i)\b{_NEG}submit\b')), false)) AS prohibited FROM e GROUP BY task, label""",
    "pending_buttons": rf"""{_TASK}, e AS (SELECT el.snapshot_id, t.task, concat_ws(' ', text, label) AS name, text, label FROM el JOIN t USING (snapshot_id) WHERE enabled),
f AS (SELECT *, list_filter([text, label], lambda x: x IS NOT NULL AND trim(x) <> '') AS parts FROM e),
g AS (SELECT snapshot_id, len(list_filter(parts, lambda x: regexp_matches(task, '(?i)\b(click|press)\s+(the\s+)?["''“]?' || trim(x) || '\b') AND NOT regexp_matches(task, '(?i)\b(do\s+not|don''t|never)\s+(click|press)\s+(the\s+)?["''“]?' || trim(x) || '\b'))) > 0
 OR len(list_filter([['continue', 'continue', 'continue'], ['place\s+(the\s+)?order', '(place\s+(the\s+)?order|order)', 'place\s+order'], ['submit', 'submit', 'submit']], lambda w: regexp_matches(task, '(?i)\b' || w[1] || '\b') AND NOT regexp_matches(task, '(?i)\b{_NEG}' || w[2] || '\b') AND regexp_matches(name, '(?i)\b' || w[3] || '\b'))) > 0 AS p FROM f)
SELECT pending, count(*) AS n FROM (SELECT t.snapshot_id, coalesce(bool_or(p), false) AS pending FROM t LEFT JOIN g USING (snapshot_id) GROUP BY t.snapshot_id) GROUP BY pending""",
    "valid_actions": f"""{_ACT} SELECT type, count(*) FILTER (n % 31 <> 0 AND type <> 'NONE' AND (type <> 'SCROLL' OR amount BETWEEN 1 AND 5000) AND question IS NULL) AS valid, count(*) AS n, count(*) FILTER (regexp_matches(summary, '{_BLOCKED}')) AS blocked FROM act GROUP BY type""",
    "grounded_actions": f"""{EL}, act AS {_ACT[12:]}, l AS (SELECT session_id, max(snapshot_id) AS latest FROM act GROUP BY session_id)
SELECT type, CASE WHEN a.snapshot_id IS DISTINCT FROM latest THEN 'STALE_SNAPSHOT' WHEN type IN ('CLICK', 'TYPE_HANDLE', 'SELECT') AND (el.id IS NULL OR NOT el.enabled) THEN 'UNAVAILABLE_ELEMENT' WHEN type = 'TYPE_HANDLE' AND handle IS DISTINCT FROM CASE WHEN el.k % 17 = 0 THEN 'LOCAL_EMAIL_1' END THEN 'UNAVAILABLE_HANDLE'
WHEN type = 'SELECT' AND NOT coalesce(list_contains(el.options, option), false) THEN 'UNAVAILABLE_OPTION' WHEN type = 'SELECT' AND option IS NOT DISTINCT FROM el.selected_option THEN 'REPEATED_OPTION' END AS error, count(*) AS n
FROM act a LEFT JOIN l USING (session_id) LEFT JOIN el ON el.snapshot_id = a.snapshot_id AND el.id = a.element_id GROUP BY ALL""",
    "fill_gates": f"""WITH f AS (SELECT {", ".join(f"{v} AS {n}" for n, v in _FILL.items())} FROM (SELECT o_orderkey AS n FROM orders))
SELECT CASE WHEN NOT valid OR type <> 'TYPE_HANDLE' THEN 'INVALID_AGENT_ACTION' WHEN NOT is_current OR document_id = '' OR local_origin <> 'o' OR context_snapshot <> 's' THEN 'STALE_SNAPSHOT' WHEN NOT enabled OR handle IS NULL OR NOT (tag = 'input' OR input_type = 'text') THEN 'PRIVACY_ASSERTION_FAILED'
WHEN NOT confirmed THEN 'CONFIRMATION_REQUIRED' WHEN preflight_error IS NOT NULL THEN preflight_error WHEN NOT still_current THEN 'STALE_SNAPSHOT' END AS outcome, count(*) AS n FROM f GROUP BY 1""",
    "deliveries": "SELECT CASE WHEN n % 2 <> 0 THEN 'LOCAL_ONLY' WHEN n % 5 = 0 THEN 'ACKNOWLEDGED' WHEN n % 3 = 0 AND n % 7 = 0 THEN 'UNCONFIRMED' WHEN n % 3 = 0 THEN 'DISPATCHED' ELSE 'PREPARED' END AS status, count(*) AS n FROM (SELECT o_orderkey AS n FROM orders) GROUP BY 1",
    "stale_actions": "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t, arg_max(substring(props, 1, 7), event_id) AS p FROM events GROUP BY user_id) SELECT user_id AS session_id, count(*) FILTER (event_type <> t OR substring(props, 1, 7) <> p) AS stale, count(*) AS n FROM events JOIN l USING (user_id) GROUP BY user_id",
    "grant_scopes": _ACT + """ SELECT n, sha256('{"action_id":"' || action_id || '","element_id":' || coalesce('"' || element_id || '"', 'null') || ',"handle":' || coalesce('"' || handle || '"', 'null') || '}') AS scope FROM act""",
    "known_secret_leaks": "WITH p AS (SELECT c_custkey, c_mktsegment || ' of ' || c_name || ' and Customer#000000040' AS payload FROM customer), s AS (SELECT DISTINCT c_name AS secret FROM customer WHERE c_custkey % 40 = 0) SELECT sha256(secret) AS secret_sha256, count(*) AS n, min(c_custkey) AS first_id FROM p JOIN s ON contains(payload, secret) GROUP BY secret",
    "outbound_assertions": """SELECT CASE WHEN n % 9 = 0 OR n % 4 IN (0, 2) THEN 422 ELSE 200 END AS status, CASE WHEN n % 9 = 0 THEN 'SECRET' WHEN n % 4 IN (0, 2) THEN 'FORBIDDEN_KEY' END AS reason, count(*) AS n FROM (SELECT o_orderkey AS n FROM orders) GROUP BY ALL""",
    "session_resources": "SELECT event_type, count(*) AS samples, max(trunc(value * 100)::BIGINT) AS peak_rss, round(avg(value), 6) AS mean_cpu, round(sum(greatest(0, value - 5)), 4) AS over_five, max(trunc(value * 100)::BIGINT) - min(trunc(value * 100)::BIGINT) AS rss_spread FROM events GROUP BY event_type",
    "control_recall": f"{EL}, s AS (SELECT tag AS scenario, count(*) FILTER (enabled) AS f, count(*) AS e FROM el GROUP BY tag UNION ALL SELECT 'all', count(*) FILTER (enabled), count(*) FROM el) SELECT scenario, round(f / e, 9) AS ratio FROM s",
    "removal_report": f"""{EL}, s AS (SELECT *, label IS NOT NULL AS e, label IS NOT NULL AND k % 7 <> 0 AS p, label IS NULL AND k % 10 = 0 AS f FROM el)
SELECT count(*) AS cases, count(*) FILTER (p) AS tp, count(*) FILTER (f) AS fp, count(*) FILTER (e AND NOT p) AS fn, round(count(*) FILTER (f) / greatest(1, count(*) FILTER (NOT e)), 9) AS false_positive_case_rate, round(count(*) FILTER (p) / greatest(1, count(*) FILTER (e)), 9) AS critical_recall, round(count(*) FILTER (p) / greatest(1, count(*) FILTER (e)), 9) AS removal_recall FROM s""",
    "pixel_report": f"{EL}, s AS (SELECT tag, w * h AS a, greatest(0, w - 3) * greatest(0, h - 2) AS v FROM el) SELECT tag, round(sum(v) / greatest(1, sum(a)), 9) AS pixel_recall, round(sum(v) / greatest(1, sum(a)), 9) AS pixel_precision, round(1 - (sum(a) - sum(v)) / greatest(1, 20000 * count(*) - sum(a)), 9) AS preserved FROM s GROUP BY tag",
    "evidence_maps": f"""{EL}, h AS (SELECT snapshot_id, coalesce(label, 'OTHER') AS type, count(*) AS hits, count(DISTINCT lower(p_brand)) AS items FROM el GROUP BY ALL)
SELECT snapshot_id, string_agg(type || '=' || items, ',' ORDER BY type) AS unique_items, string_agg(type || '=' || hits, ',' ORDER BY type) AS detector_hits, 0::INT AS in_review, sum(hits)::BIGINT AS total FROM h GROUP BY snapshot_id""",
    "blocked_visuals": f"{EL} SELECT tag, count(DISTINCT CASE WHEN k % 2 = 0 THEN p_brand ELSE id END) AS blocked_regions FROM el WHERE k % 3 = 0 GROUP BY tag",
    "clarified_tasks": r"""WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(substring('Find the cheapest ' || conv_id || chr(10) || 'User clarification: ' || array_to_string(l[-3:], chr(10) || 'User clarification: '), 1, 900)) AS task_sha256, conv_id % 2 <> 0 AS lost FROM a""",
    "marked_segments": f"{EL} SELECT id, 6 AS parts, '<EMAIL>|[GIVEN_NAME_1]|LOCAL_PHONE_' || k AS markers, true AS whole FROM el WHERE text IS NOT NULL",
    "grouped_names": f"{EL} SELECT id, 2::BIGINT AS items, greatest(length(text) + 2 + length(p_brand), length(p_type))::INT AS longest FROM el WHERE text IS NOT NULL",
    "formatted_metrics": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN printf('%.1f', p_size * 100 / 64) || '%' ELSE 'Unavailable' END AS share, format('{:,.2f}', p_partkey / 100) || ' s' AS seconds, printf('%.1f', p_size * 7654321::BIGINT / 1048576) || ' MiB' AS mebibytes, printf('%.2f', p_size * 7654321::BIGINT / 1073741824) || ' GiB' AS gibibytes, round(p_retailprice, 2) AS price FROM part",
    "journey_dates": "WITH o AS (SELECT CASE o_orderkey % 10 WHEN 0 THEN false WHEN 1 THEN false ELSE true END AS valid, strftime(o_orderdate, '%B %Y') AS m FROM orders) SELECT valid, CASE WHEN valid THEN m END AS month, count(*) AS n FROM o GROUP BY ALL",
    "scrubbed_logs": """SELECT user_id::VARCHAR AS "user", '[REDACTED]' AS token, '[REDACTED]' AS raw, event_type AS kind, count(*) AS n FROM events GROUP BY ALL""",
}
