"""Queries of planner, limit, source and vision operators over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.validators import VALIDATORS
from sluice.operators import detect, elements, guard, planner, spatial, tasks
from sluice.operators.spread import spread
from sluice.plans.controls import EL, controls
from sluice.sources.png import png_pixels
from sluice.sources import checked_artifacts, directory_bytes, flat_reports, fresh, image_bytes, paced, process_tree, processes

c = F.col


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planned_actions(spark, sf_dir):
    """The next action of each snapshot's task, and how many have an id of their own."""
    rows = controls(spark, sf_dir)
    asked = rows.select("snapshot_id", "task").distinct()
    return planner.plan(rows, asked)


def unique_action_ids(spark, sf_dir):
    rows = controls(spark, sf_dir)
    acts = planner.planned(rows, rows.select("snapshot_id", "task").distinct())
    return acts.agg(F.count("*").alias("actions"), F.countDistinct("action_id").alias("ids"), F.count_if(c("action_id").rlike("^act_[0-9a-f]{32}$")).alias("well_formed"))


def fares_by_departure(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm").alias("departure"), F.round("value", 2).alias("fare"))
    return planner.fares(e, True, "fare").groupBy(F.substring("departure", 1, 2).alias("hour")).agg(F.count("*").alias("n"), F.round(F.min("total"), 2).alias("least"))


_PERSON = {
    "name": "CASE WHEN c_custkey % 7 = 0 THEN ' x ' ELSE c_name END", "email": "CASE WHEN c_custkey % 5 = 0 THEN 'no mail' ELSE 'a' || CAST(c_custkey AS STRING) || '@b.example' END", "phone": "CASE WHEN c_custkey % 3 = 0 THEN '12345' ELSE '98765' || CAST(10000 + c_custkey AS STRING) END",
    "age": "CAST(c_custkey % 130 AS STRING)", "gender": "CASE WHEN c_custkey % 11 <> 0 THEN 'any' ELSE '' END", "berth": "'lower'",
}


def valid_passengers(spark, sf_dir):
    people = _table(spark, sf_dir, "customer").selectExpr("c_mktsegment", *[f"{v} AS {n}" for n, v in _PERSON.items()])
    return people.groupBy("c_mktsegment").agg(F.count_if(planner.is_passenger()).alias("valid"), F.count("*").alias("n"))


_STATE = {
    "error": "CASE WHEN event_id % 23 = 0 THEN 'x' END", "phase": "CASE event_id % 10 WHEN 0 THEN 'OBSERVE' WHEN 1 THEN 'SANITIZE' WHEN 2 THEN 'PLAN' WHEN 3 THEN 'EXECUTE' WHEN 4 THEN 'VERIFY' WHEN 5 THEN 'COMPLETE' WHEN 6 THEN 'STOPPED' WHEN 7 THEN 'FAILED' ELSE 'IDLE' END",
    "pending": "event_id % 9 = 0", "delivery": "CASE event_id % 4 WHEN 0 THEN 'LOCAL_ONLY' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'PREPARED' END", "running": "event_id % 2 = 0", "previewed": "event_id % 3 = 0", "verified": "event_id % 5",
}


def agent_statuses(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {n}" for n, v in _STATE.items()])
    story = planner.story()
    flags = F.array_join(F.transform(story, lambda s: F.concat(s["place"], F.lit(":"), s["done"].cast("int"), s["active"].cast("int"))), " ")
    return rows.groupBy(planner.status().alias("status"), flags.alias("story")).agg(F.count("*").alias("n"))


def _fare_screen(spark, sf_dir) -> DataFrame:
    label = F.when(c("k") % 5 == 0, F.concat(F.lit("Choose train "), c("k"))).when(c("k") % 5 == 1, "Untrusted page instruction").when(c("k") % 5 == 2, "Unrelated notes").otherwise(c("label"))
    return controls(spark, sf_dir).withColumn("label", label).withColumn("role", F.when(c("k") % 10 < 7, "button").otherwise(c("role"))).withColumn("text", F.repeat(F.lit("t"), (c("k") % 500).cast("int")))


def comparison_screens(spark, sf_dir):
    rows = planner.minimal(planner.comparison_screen(_fare_screen(spark, sf_dir), "Compare")).withColumn("kind", F.substring("label", 1, 6))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars"))


def scoped_actions(spark, sf_dir):
    """Actions on a comparison screen, of which only clicks on fare buttons are in scope."""
    rows = spread(_fare_screen(spark, sf_dir), "snapshot_id", "id")  # texts of one letter are packed so well that small shuffles would be merged into few large tasks
    acts = rows.select("snapshot_id", c("id").alias("element_id"), F.when(c("k") % 3 == 0, "TYPE_HANDLE").otherwise("CLICK").alias("type"))
    return planner.with_target(planner.in_scope(acts, rows), rows).groupBy("type", "allowed").agg(F.count("*").alias("n"), F.count("target").alias("targets"), F.min("target").alias("first_target"))


def overlaid_controls(spark, sf_dir):
    """Sanitised options give way to those on the device for journey controls alone."""
    local = controls(spark, sf_dir).withColumn("label", F.when(c("k") % 3 == 0, "Quota").when(c("k") % 3 == 1, F.concat(F.lit("Journey date 2026-01-"), F.lpad((c("k") % 28 + 1).cast("string"), 2, "0"))).otherwise(c("label")))
    clean = local.withColumn("label", F.lit("<OTHER>")).withColumn("options", F.when(c("options").isNotNull(), F.array(F.lit("<OTHER>")))).withColumn("selected_option", F.lit(None).cast("string"))
    return planner.local_overlay(clean, local).select("id", "label", F.size(F.coalesce("options", F.array())).alias("options"), "selected_option")


def step_limits(spark, sf_dir):
    """Events of a user as steps, of which errors wait an hour for consent."""
    e = _table(spark, sf_dir, "events").withColumn("waited", F.when(c("event_type") == "error", 3_600_000).otherwise(0).cast("long"))
    return planner.limited(e, "user_id", ["ts", "event_id"], "ts", "waited", 40, 48 * 3_600_000).groupBy("outcome").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def confirmed_requests(spark, sf_dir):
    """Clicks as requests, answered by the user's next event."""
    e = _table(spark, sf_dir, "events")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("next_id", F.lead("event_id").over(w)).withColumn("next_at", F.lead("ts").over(w)).withColumn("next_value", F.lead("value").over(w)).filter("event_type = 'click'")
    requests = rows.select(c("event_id").alias("request_id"), (c("event_id") % 50).alias("generation"), c("ts").alias("at"))
    answers = rows.filter("next_id is not null").select(c("event_id").alias("request_id"), F.when(c("next_id") % 9 == 0, -1).otherwise(c("event_id") % 50).alias("generation"), c("next_at").alias("at"), (c("next_value") > 3).alias("yes"))
    return planner.confirmed(requests, answers, 20_000_000).groupBy("confirmed").agg(F.count("*").alias("n"), F.min("request_id").alias("first_id"))


def vault_grants(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    kind = F.when(c("event_type") == "error", "REVOKE").when(c("event_id") % 2 == 0, "APPROVE").otherwise("RESOLVE")
    log = e.select(c("user_id").alias("session_id"), (c("event_id") % 3).alias("handle"), kind.alias("kind"), c("event_id").alias("seq"))
    return planner.grants(log).groupBy("session_id").agg(F.count_if("granted").alias("granted"), F.count("*").alias("n"))


def paced_shots(spark, sf_dir):
    return paced(_table(spark, sf_dir, "events"), "user_id", "ts", 600_000).groupBy("user_id").agg(F.count_if("early").alias("early"), F.count("*").alias("n"))


def page_signatures(spark, sf_dir):
    rows = controls(spark, sf_dir).select("snapshot_id", F.struct("dom_index", "id", "role", "input_type", "text", "label", "enabled", "selected", "value_present", "options", "selected_option", "control_value").alias("e"))
    pages = rows.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("e")).alias("elements")).withColumn("origin", F.lit("https://x.example")).withColumn("url", F.concat(F.lit("https://x.example/"), "snapshot_id")).withColumn("viewport", F.struct(F.lit(800).alias("width"), F.lit(600).alias("height")))
    return pages.select("snapshot_id", planner.page_signature(pages).alias("signature"))


def scanned_fields(spark, sf_dir):
    rows = controls(spark, sf_dir)
    seen = rows.groupBy("snapshot_id").agg(F.collect_list(F.struct("id", "sources", "text", "label", "options", "control_value")).alias("elements"))
    _, side = elements.private_values(rows)
    found = detect.field_texts(seen, rows.select("snapshot_id", "task").distinct(), side)
    return found.groupBy("field", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def contextual_hits(spark, sf_dir):
    """Words of a list protected in texts; in tasks their placeholders become handles."""
    rows = controls(spark, sf_dir).filter("text is not null").select("snapshot_id", c("id").alias("element_id"), F.when(c("k") % 2 == 0, "TASK").otherwise("TEXT").alias("field"), F.concat(c("text"), F.lit(" for Asha")).alias("text"))
    safe = tasks.protect(rows, "text", tasks.gazetteer({"GIVEN_NAME": ["Asha"], "SURNAME": ["ring", "widget"]}))
    told = detect.contextual_entities(safe, elements.contextual_type)
    other = rows.select("snapshot_id", "element_id", "field", F.lit("EMAIL").alias("type"), F.lit("DOM").alias("source"), F.lit(0.99).alias("confidence"), c("text").alias("raw_value"))
    union = detect.all_entities(told, other.filter(c("field") == "TASK"))
    handles = F.create_map(F.lit("[GIVEN_NAME_1]"), F.lit("LOCAL_GIVEN_NAME_1"))
    task = safe.filter("field = 'TASK'").agg(F.count_if(detect.handled_task(c("protected.text"), c("protected.found"), handles).contains("LOCAL_GIVEN_NAME_1")).alias("handled"))
    return union.groupBy("type", "confidence", "decision").agg(F.count("*").alias("n"), F.countDistinct("snapshot_id", "entity_id").alias("ids")).crossJoin(F.broadcast(task))


def document_masks(spark, sf_dir):
    """Read texts on line items' boxes: a tax id turns the regions of its order that it meets into private documents."""
    lines = spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"), "l_orderkey").withColumn("bbox", F.struct((c("l_quantity") * 20).alias("x"), (c("l_discount") * 1000).alias("y"), (c("l_tax") * 5000 + 1).alias("width"), (c("l_quantity") * 7).alias("height")))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    text = F.when(c("l_partkey") % 3 == 0, "PAN ABCDE1234F").when(c("l_partkey") % 3 == 1, "mail a@b.example").otherwise("nothing")
    texts = lines.filter("l_linenumber % 2 = 1").select(c("l_orderkey").alias("snapshot_id"), key.alias("text_id"), text.alias("text"), "bbox")
    regions = lines.filter("l_linenumber % 2 = 0").select(c("l_orderkey").alias("snapshot_id"), key.alias("region_id"), "bbox")
    found, marked = spatial.document_regions(texts, regions)
    hits = found.agg(F.count_if(c("type") == "PAN").alias("pans"), F.count_if(c("type") == "EMAIL").alias("mails"))
    return marked.groupBy("type", "crop").agg(F.count("*").alias("n")).crossJoin(F.broadcast(hits))


def capped_pixel_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(c("user_id").alias("snapshot_id"), c("value").alias("confidence"), c("event_id").alias("id"))
    return spatial.capped_pixels(e, 40).groupBy("snapshot_id").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.sum("id").alias("ids"))


def read_texts(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.floor(c("p_partkey") / 10).alias("image_id"), c("p_name").alias("text"), (c("p_size") * 0.01).cast("double").alias("confidence"), (c("p_size") % 5).alias("y"), c("p_partkey").alias("x"))
    return spatial.reading_order(p)


def decoded_symbols(spark, sf_dir):
    """Events of a user as symbols (click is the blank): repeats and blanks go."""
    kinds = F.array(F.lit("click"), *[F.lit(x) for x in _SYMBOLS])
    e = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("e"))
    read = spatial.ctc_text(F.transform("e", lambda x: (F.array_position(kinds, x["event_type"]) - 1).cast("int")), F.transform("e", lambda x: x["value"]), F.array(*[F.lit(x[:1]) for x in _SYMBOLS]))
    return e.select("user_id", F.sha2(read["text"], 256).alias("text_sha256"), F.round(read["confidence"], 6).alias("confidence"))


_SYMBOLS = ("error", "purchase", "signup", "view")


def suppressed_pairs(spark, sf_dir):
    """Two detections an image: the weaker goes if it is of the type of the stronger and lies on it."""
    p = spread(_table(spark, sf_dir, "part").filter("p_partkey % 2 = 0"), "p_partkey")
    box = lambda i, dx: F.struct(F.concat(F.lit("d"), F.lit(i)).alias("det_id"), F.when(c("p_partkey") % 3 == 0, F.lit("CARD") if i else F.lit("FACE")).otherwise("FACE").alias("type"), F.lit(0.9 - i / 10).alias("confidence"), (F.lit(0.0) + dx).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("width"), F.lit(20.0).alias("height"))
    pairs = p.select(c("p_partkey").alias("image_id"), "p_size", F.explode(F.array(box(0, F.lit(0)), box(1, c("p_size")))).alias("d")).select("image_id", "d.*")
    kept = spatial.suppress(pairs).groupBy("image_id").agg(F.count("*").alias("kept"))
    merged = spatial.merge_detections(pairs, "image_id").groupBy("image_id").agg(F.count("*").alias("merged"), F.max("width").alias("widest"))
    return kept.join(merged, "image_id")


def masked_rasters(spark, sf_dir):
    """Four by four grey pixels of which a box of p_size is black: the pixels of the PNG files of verified crops, read again."""
    p = spread(_table(spark, sf_dir, "part"), "p_partkey")
    images = p.select(c("p_partkey").alias("image_id"), F.lit(4).alias("width"), F.lit(4).alias("height"), F.unhex(F.lit("7f" * 64)).alias("rgba"))
    boxes = p.select(c("p_partkey").alias("image_id"), (c("p_size") % 4).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("width"), F.lit(2.0).alias("height"))
    crops = spatial.crop_records(spatial.masked(images, boxes)).withColumn("content", F.unbase64("data_base64")).filter(F.sha2("content", 256) == c("sha256"))
    return png_pixels(crops).groupBy(F.sha2("rgba", 256).alias("sha256"), "mime_type", "redaction_verified").agg(F.count("*").alias("n"))


def flattened_reports(spark, sf_dir):
    """Orders of a customer as tests of nested suites."""
    o = _table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0")
    test = F.struct(F.concat(F.lit("t"), "o_orderkey").alias("title"), F.array(F.struct(c("o_orderstatus").alias("status"), F.array(F.struct(F.lit(1.0).alias("duration")), F.struct(c("o_totalprice").alias("duration"))).alias("results"))).alias("tests"))
    inner = o.groupBy("o_custkey", "o_orderpriority").agg(F.struct(c("o_orderpriority").alias("title"), F.collect_list(test).alias("specs")).alias("s"))
    outer = inner.groupBy("o_custkey").agg(F.to_json(F.struct(F.array(F.struct(F.lit("top").alias("title"), F.collect_list("s").alias("suites"))).alias("suites"))).alias("json"))
    return flat_reports(outer, c("json"), 3).groupBy("suite", "status").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 2).alias("duration"))


def process_descendants(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    line = F.concat(F.lit("  "), c("s_suppkey") + 1, F.lit(" "), F.floor((c("s_suppkey") + 1) / 2), F.lit(" "), c("s_nationkey") * 100, F.lit(" 0.5 run "), c("s_name"))
    return process_tree(processes(s.select(line.alias("value"))), 2).agg(F.count("*").alias("n"), F.sum("rss_bytes").alias("rss_bytes"), F.max("pid").alias("last"))


def artifact_checks(spark, sf_dir):
    """Part names as artifacts: every fifth is altered, every seventh missing."""
    p = _table(spark, sf_dir, "part")
    files = p.filter("p_partkey % 7 <> 0").select(F.concat(F.lit("f/"), "p_partkey").alias("path"), F.when(c("p_partkey") % 5 == 0, "altered").otherwise(c("p_name")).cast("binary").alias("content"), F.length("p_name").alias("length"))
    manifest = p.select(c("p_brand").alias("name"), F.concat(F.lit("f/"), "p_partkey").alias("path"), F.upper(F.sha2("p_name", 256)).alias("sha256"))
    return checked_artifacts(files, manifest).groupBy("name").agg(F.count_if("found").alias("found"), F.count_if("intact").alias("intact"), F.count("*").alias("n")).crossJoin(F.broadcast(directory_bytes(files)))


def fresh_reports(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return fresh(e, "ts", F.lit("2024-01-05 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n"))


def data_url_images(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    url = F.concat(F.when(c("p_partkey") % 3 == 0, "data:text/plain;base64,").when(c("p_partkey") % 3 == 1, "data:image/png;base64,").otherwise("data:image/jpeg;base64,"), F.base64(c("p_name").cast("binary")))
    return p.select("p_partkey", image_bytes(url).cast("string").alias("content"))


def checksums(spark, sf_dir):
    """Numbers of customers under the three checksums."""
    p = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("2345"), F.lpad((c("c_custkey") * 7919 % 100_000_000).cast("string"), 8, "0")).alias("twelve"), F.concat(F.lit("27AAPFU"), F.lpad((c("c_custkey") % 10_000).cast("string"), 4, "0"), F.lit("F1ZV")).alias("fifteen"), F.concat(F.lit("4111 1111 "), F.lpad(c("c_custkey").cast("string"), 8, "0")).alias("sixteen"))
    return p.select("c_custkey", *[VALIDATORS[v](c(n)).alias(v) for v, n in (("verhoeff", "twelve"), ("gstin", "fifteen"), ("luhn", "sixteen"))])


def texts_before_guard(spark, sf_dir):
    """Documents of each language that hold an obvious secret."""
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count_if(guard.has_obvious_secret(c("text"))).alias("stopped"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        planned_actions, unique_action_ids, fares_by_departure, valid_passengers, agent_statuses, comparison_screens, scoped_actions, overlaid_controls, step_limits, confirmed_requests, vault_grants, paced_shots, page_signatures,
        scanned_fields, contextual_hits, document_masks, capped_pixel_rows, read_texts, decoded_symbols, suppressed_pairs, masked_rasters, flattened_reports, process_descendants, artifact_checks, fresh_reports, data_url_images, checksums,
        texts_before_guard,
    )
}

_NEG = r"(do\s+not|don''t|never)\s+(click\s+|press\s+)?(the\s+)?"
_J = lambda x: f"coalesce(to_json({x}), 'null')"
_ROWS = "[{}]"

ORACLE_SQL = {
    # Tasks of these snapshots cannot finish by sight; buttons' names hold no digits.
    "planned_actions": rf"""{EL}, e AS (SELECT *, replace(lower(task), '-', ' ') AS t, CASE WHEN k % 17 = 0 THEN 'LOCAL_EMAIL_1' END AS vh, lower(concat_ws(' ', text, label)) AS vis, coalesce(enabled, false) AS on_ FROM el),
o AS (SELECT *, list_filter(coalesce(options, []), lambda x: NOT contains(lower(x), 'select')) AS opts FROM e),
w AS (SELECT *, list_filter(opts, lambda x: contains(t, lower(x)))[1] AS asked, CASE WHEN contains(t, 'cheap') OR contains(t, 'lowest') OR contains(t, 'least expensive') THEN opts[1] END AS cheapest FROM o),
n AS (SELECT *, coalesce(asked, cheapest) AS want, list_sort(list_filter([lower(label), lower(control_value), lower(text)], lambda x: x IS NOT NULL AND length(x) >= 2 AND regexp_matches(t, '\b' || x || '\b')), 'ASC') AS named FROM w),
c AS (
  SELECT snapshot_id, 0 AS r, 0 AS p, 0 AS d, NULL AS id, 'FINISH' AS type, NULL AS handle, NULL AS option FROM n WHERE regexp_matches(t, '\b(complete|finish|order|book|submit|continue)\b') AND regexp_matches(vis, '\b(controlled demo complete|order (was )?placed|booking confirmed)\b')
  UNION ALL SELECT snapshot_id, 1, 0, dom_index, id, 'TYPE_HANDLE', vh, NULL FROM n WHERE on_ AND vh IS NOT NULL
  UNION ALL SELECT snapshot_id, 2, 0, dom_index, id, 'SELECT', NULL, want FROM n WHERE on_ AND want IS NOT NULL AND want IS DISTINCT FROM selected_option
  UNION ALL SELECT snapshot_id, 3, q.no, 0, id, 'CLICK', NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, role ORDER BY dom_index) - 1 AS nth FROM n WHERE on_ AND role IN ('checkbox', 'radio')) JOIN (VALUES (0, 'checkbox', 1, true), (1, 'radio', 2, false)) q(no, role, nth, want_) USING (role, nth) WHERE contains(t, 'second checkbox') AND selected IS DISTINCT FROM want_
  UNION ALL SELECT snapshot_id, 4, 0, dom_index, id, 'CLICK', NULL, NULL FROM n WHERE on_ AND role IN ('checkbox', 'radio') AND len(named) > 0 AND selected IS DISTINCT FROM (NOT regexp_matches(t, '\b(clear|uncheck|untick|deselect|disable)\s+(the\s+)?' || named[1] || '\b'))
  UNION ALL SELECT snapshot_id, 5, i.no, dom_index, id, 'CLICK', NULL, NULL FROM n, (VALUES (0, '\bcontinue\b', 'continue', 'continue'), (1, '\bplace\s+(the\s+)?order\b', 'place order', '(place\s+(the\s+)?order|order)'), (2, '\bsubmit\b', 'submit', 'submit')) i(no, pat, name, neg)
    WHERE on_ AND role = 'button' AND regexp_matches(t, i.pat) AND contains(vis, i.name) AND NOT regexp_matches(t, '\b{_NEG}' || i.neg || '\b') AND NOT regexp_matches(t, '\b{_NEG}["''“]?' || vis || '\b')
  UNION ALL SELECT snapshot_id, 6, 0, min(dom_index), min(id), 'CLICK', NULL, NULL FROM n WHERE on_ AND role = 'button' AND len(list_filter([lower(text), lower(label)], lambda x: x IS NOT NULL AND regexp_matches(t, '\b(click|press)\s+(the\s+)?["''“]?' || x || '\b') AND NOT regexp_matches(t, '\b{_NEG}["''“]?' || x || '\b') AND NOT (contains(x, 'submit') AND regexp_matches(t, '\b{_NEG}submit\b')))) > 0 GROUP BY snapshot_id HAVING count(*) = 1
  UNION ALL SELECT DISTINCT snapshot_id, 7, 0, 0, NULL, 'FINISH', NULL, NULL FROM n WHERE (on_ AND want IS NOT NULL) OR (on_ AND role IN ('checkbox', 'radio') AND len(named) > 0)
  UNION ALL SELECT DISTINCT snapshot_id, 7, 0, 0, NULL, 'FINISH', NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, role ORDER BY dom_index) - 1 AS nth FROM n WHERE on_ AND role IN ('checkbox', 'radio')) WHERE contains(t, 'second checkbox') AND ((role = 'checkbox' AND nth = 1) OR (role = 'radio' AND nth = 2))
  UNION ALL SELECT DISTINCT snapshot_id, 8, 0, 0, NULL, 'FINISH', NULL, NULL FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY r, p, d, id) AS nth FROM c)
SELECT snapshot_id, ['VISIBLY_DONE', 'FILL', 'CHOOSE', 'ORDINAL', 'NAMED_STATE', 'BUTTON_INTENT', 'NAMED_BUTTON', 'SATISFIED', 'NO_RULE'][r + 1] AS rule, type, id AS element_id, handle, option FROM b WHERE nth = 1""",
    "unique_action_ids": f"{EL} SELECT count(DISTINCT snapshot_id) AS actions, count(DISTINCT snapshot_id) AS ids, count(DISTINCT snapshot_id) AS well_formed FROM el",
    "fares_by_departure": "SELECT strftime(ts, '%H') AS hour, count(*) AS n, round(min(round(value, 2) + 35), 2) AS least FROM events WHERE hour(ts) < 12 GROUP BY 1",
    "valid_passengers": "SELECT c_mktsegment, count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 130 BETWEEN 1 AND 120 AND c_custkey % 11 <> 0 AND length('98765' || (10000 + c_custkey)) = 10) AS valid, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "agent_statuses": f"""WITH s AS (SELECT {", ".join(f"{v} AS {n}" for n, v in _STATE.items())} FROM events)
SELECT CASE WHEN error IS NOT NULL OR phase = 'FAILED' THEN 'STOPPED_EARLY' WHEN phase = 'STOPPED' THEN 'STOPPED_BY_USER' WHEN phase = 'COMPLETE' THEN 'COMPLETE' WHEN pending THEN 'PERMISSION_NEEDED' WHEN phase = 'PLAN' THEN CASE WHEN delivery = 'LOCAL_ONLY' THEN 'PLAN_ON_DEVICE' ELSE 'PLAN_ON_SERVER' END
WHEN phase <> 'IDLE' THEN phase WHEN running THEN 'STARTING' ELSE 'IDLE' END AS status, 'Device:' || previewed::INT || (running AND phase = 'OBSERVE')::INT || ' Device:' || previewed::INT || (running AND phase = 'SANITIZE')::INT || ' ' || CASE WHEN delivery = 'LOCAL_ONLY' THEN 'Device:' ELSE 'Server:' END
|| (delivery IN ('LOCAL_ONLY', 'ACKNOWLEDGED'))::INT || (running AND phase = 'PLAN')::INT || ' Browser:' || (verified > 0)::INT || (running AND phase IN ('EXECUTE', 'VERIFY'))::INT AS story, count(*) AS n FROM s GROUP BY ALL""",
    "comparison_screens": f"""{EL}, s AS (SELECT CASE k % 5 WHEN 0 THEN 'Choose' WHEN 1 THEN 'Untrus' ELSE 'Unrela' END AS kind, CASE WHEN k % 5 = 1 THEN least(320, k % 500) ELSE k % 500 END AS n FROM el WHERE k % 5 IN (1, 2) OR (k % 5 = 0 AND enabled AND (k % 10 < 7 OR role = 'button')))
SELECT kind, count(*) AS n, max(n)::INT AS longest, sum(n)::BIGINT AS chars FROM s GROUP BY kind""",
    "scoped_actions": f"""{EL}, s AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'TYPE_HANDLE' ELSE 'CLICK' END AS type, CASE WHEN k % 10 < 7 THEN 'button' ELSE role END AS role, enabled, repeat('t', (k % 500)::INT) AS text, CASE k % 5 WHEN 0 THEN 'Choose train ' || k WHEN 1 THEN 'Untrusted page instruction' WHEN 2 THEN 'Unrelated notes' ELSE label END AS label FROM el)
SELECT type, type = 'CLICK' AND k % 5 = 0 AND enabled AND role = 'button' AS allowed, count(*) AS n, count(*) AS targets, min(concat_ws('|', role, text, label)) AS first_target FROM s GROUP BY ALL""",
    "overlaid_controls": f"""{EL}, s AS (SELECT *, CASE k % 3 WHEN 0 THEN 'Quota' WHEN 1 THEN 'Journey date 2026-01-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') ELSE label END AS own FROM el), f AS (SELECT *, visible AND enabled AND role = 'combobox' AND tag = 'select' AND k % 3 = 0 AS sel, visible AND enabled AND role = 'button' AND tag = 'button' AND k % 3 = 1 AS dat FROM s)
SELECT id, CASE WHEN sel OR dat THEN own ELSE '<OTHER>' END AS label, CASE WHEN sel THEN 3 WHEN tag = 'select' THEN 1 ELSE 0 END::INT AS options, CASE WHEN sel THEN selected_option END AS selected_option FROM f""",
    "step_limits": """WITH w AS (SELECT event_id, row_number() OVER o AS n, epoch_us(ts) // 1000 - epoch_us(first_value(ts) OVER o) // 1000 AS ms, coalesce(sum(CASE WHEN event_type = 'error' THEN 3600000 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS waited
FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT CASE WHEN n > 40 THEN 'STEP_LIMIT' WHEN ms - waited > 172800000 THEN 'DEADLINE' ELSE 'RUN' END AS outcome, count(*) AS n, min(event_id) AS first_id FROM w GROUP BY 1""",
    "confirmed_requests": """WITH w AS (SELECT *, lead(event_id) OVER o AS ni, lead(ts) OVER o AS na, lead(value) OVER o AS nv FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT coalesce(ni % 9 <> 0 AND epoch_us(na) // 1000 - epoch_us(ts) // 1000 < 20000000 AND nv > 3, false) AS confirmed, count(*) AS n, min(event_id) AS first_id FROM w WHERE event_type = 'click' GROUP BY 1""",
    "vault_grants": """WITH e AS (SELECT user_id, event_id % 3 AS h, CASE WHEN event_type = 'error' THEN 'REVOKE' WHEN event_id % 2 = 0 THEN 'APPROVE' ELSE 'RESOLVE' END AS kind, event_id FROM events),
g AS (SELECT r.user_id, (SELECT a.kind = 'APPROVE' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = r.user_id AND x.kind = 'REVOKE' AND x.event_id > a.event_id AND x.event_id < r.event_id) FROM e a WHERE a.user_id = r.user_id AND a.h = r.h AND a.kind <> 'REVOKE' AND a.event_id < r.event_id ORDER BY a.event_id DESC LIMIT 1) AS ok FROM e r WHERE kind = 'RESOLVE')
SELECT user_id AS session_id, count(*) FILTER (coalesce(ok, false)) AS granted, count(*) AS n FROM g GROUP BY user_id""",
    "paced_shots": "SELECT user_id, count(*) FILTER (d < 600000) AS early, count(*) AS n FROM (SELECT user_id, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) // 1000 AS d FROM events) GROUP BY user_id",
    "page_signatures": f"""{EL}, j AS (SELECT snapshot_id, string_agg('[' || concat_ws(',', {", ".join(_J(x) for x in ("id", "role", "input_type", "text", "label", "enabled", "selected", "value_present", "options", "selected_option", "control_value"))}) || ']', ',' ORDER BY dom_index) AS e FROM el GROUP BY snapshot_id),
b AS (SELECT snapshot_id, '{{"origin":"https://x.example","url":"https://x.example/' || snapshot_id || '","viewport":{{"width":800,"height":600}},"elements":[' || e || ']}}' AS s FROM j)
SELECT snapshot_id, 'fp_' || printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda x: unicode(x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295)) AS signature FROM b""",
    "scanned_fields": f"""{EL}, f AS (SELECT 'TEXT' AS field, text, sources = ['OCR'] AS o FROM el UNION ALL SELECT 'LABEL', label, sources = ['OCR'] FROM el UNION ALL SELECT 'CONTROL_VALUE', control_value, sources = ['OCR'] FROM el UNION ALL SELECT 'OPTION', unnest(options), sources = ['OCR'] FROM el
UNION ALL SELECT 'PRIVATE_VALUE', value, false FROM el WHERE trim(value) <> '' UNION ALL SELECT 'TASK', task, false FROM (SELECT DISTINCT snapshot_id, task FROM el))
SELECT field, CASE WHEN o THEN 'OCR' ELSE 'DOM' END AS source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM f WHERE length(text) > 0 GROUP BY ALL""",
    "contextual_hits": f"""{EL}, t AS (SELECT k % 2 = 0 AS task, regexp_matches(text, '\\b(ring|widget)\\b') AS s FROM el WHERE text IS NOT NULL), h AS (SELECT count(*) AS handled FROM t WHERE task),
u AS (SELECT 'PERSON_NAME' AS type, 0.9::DOUBLE AS confidence, 'ABSTRACT' AS decision, count(*) + count(*) FILTER (s) AS n FROM t UNION ALL SELECT 'EMAIL', 0.99, NULL, count(*) FROM t WHERE task)
SELECT type, confidence, decision, n, n AS ids, handled FROM u, h""",
    "document_masks": """WITH b AS (SELECT l_orderkey AS s, l_linenumber % 2 AS odd, l_partkey % 3 AS m, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_quantity * 20 AS x, l_discount * 1000 AS y, l_tax * 5000 + 1 AS w, l_quantity * 7 AS h FROM lineitem),
met AS (SELECT DISTINCT r.s, r.id FROM b t JOIN b r ON t.s = r.s AND t.odd = 1 AND t.m = 0 AND r.odd = 0 AND least(t.x + t.w, r.x + r.w) > greatest(t.x, r.x) AND least(t.y + t.h, r.y + r.h) > greatest(t.y, r.y)),
q AS (SELECT CASE WHEN met.id IS NOT NULL THEN 'PRIVATE_DOCUMENT' END AS type FROM b LEFT JOIN met USING (s, id) WHERE odd = 0)
SELECT type, type IS NULL AS crop, count(*) AS n, (SELECT count(*) FROM b WHERE odd = 1 AND m = 0) AS pans, (SELECT count(*) FROM b WHERE odd = 1 AND m = 1) AS mails FROM q GROUP BY ALL""",
    "capped_pixel_rows": "SELECT user_id AS snapshot_id, count(*) AS n, min(value) AS least, sum(event_id)::BIGINT AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events) WHERE nth <= 40 GROUP BY user_id",
    "read_texts": "SELECT p_partkey // 10 AS image_id, string_agg(p_name, ' ' ORDER BY p_size % 5, p_partkey) AS text, round(avg(p_size * 0.01::DOUBLE), 6) AS confidence FROM part GROUP BY 1",
    "decoded_symbols": f"""WITH e AS (SELECT user_id, event_type, value, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT * FROM e WHERE event_type IN {_SYMBOLS} AND event_type IS DISTINCT FROM b), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, sha256(coalesce(string_agg(event_type[1], '' ORDER BY n), '')) AS text_sha256, round(coalesce(avg(value), 0), 6) AS confidence FROM u LEFT JOIN k USING (user_id) GROUP BY user_id""",
    "suppressed_pairs": """WITH p AS (SELECT p_partkey AS image_id, p_size AS d, p_partkey % 3 <> 0 AS same, greatest(0, 40 - p_size) * 20.0 AS c FROM part WHERE p_partkey % 2 = 0), q AS (SELECT *, same AND c / (1600 - c) > 0.45 AS over FROM p)
SELECT image_id, CASE WHEN over THEN 1 ELSE 2 END::BIGINT AS kept, CASE WHEN over THEN 1 ELSE 2 END::BIGINT AS merged, CASE WHEN over THEN 40.0 + d ELSE 40.0 END::DOUBLE AS widest FROM q""",
    "masked_rasters": """WITH x AS (SELECT p_size % 4 AS x FROM part), r AS (SELECT x, array_to_string(list_transform(range(16), lambda i: CASE WHEN i % 4 = x AND i // 4 IN (1, 2) THEN '000000ff' ELSE '7f7f7f7f' END), '') AS h FROM x)
SELECT sha256(unhex(h)) AS sha256, 'image/png' AS mime_type, true AS redaction_verified, count(*) AS n FROM r GROUP BY h""",
    "flattened_reports": "SELECT 'top > ' || o_orderpriority AS suite, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS duration FROM orders WHERE o_custkey % 3 = 0 GROUP BY ALL",
    "process_descendants": """WITH RECURSIVE p AS (SELECT s_suppkey + 1 AS pid, (s_suppkey + 1) // 2 AS ppid, s_nationkey * 100 * 1024 AS rss FROM supplier), t AS (SELECT pid, rss FROM p WHERE pid = 2 UNION ALL SELECT p.pid, p.rss FROM p JOIN t ON p.ppid = t.pid)
SELECT count(*) AS n, sum(rss)::BIGINT AS rss_bytes, max(pid) AS last FROM t""",
    "artifact_checks": "WITH b AS (SELECT sum(length(p_name))::BIGINT AS bytes FROM part WHERE p_partkey % 7 <> 0) SELECT p_brand AS name, count(*) FILTER (p_partkey % 7 <> 0) AS found, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) AS intact, count(*) AS n, any_value(bytes) AS bytes FROM part, b GROUP BY p_brand",
    "fresh_reports": "SELECT event_type, count(*) AS n FROM events WHERE abs(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-05') // 1000) < 86400000 GROUP BY event_type",
    "data_url_images": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS content FROM part",
    "checksums": f"""WITH n AS (SELECT c_custkey, '2345' || lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS a, '27AAPFU' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F1ZV' AS b, '41111111' || lpad(c_custkey::VARCHAR, 8, '0') AS d FROM customer),
t AS (SELECT [[0,1,2,3,4,5,6,7,8,9],[1,2,3,4,0,6,7,8,9,5],[2,3,4,0,1,7,8,9,5,6],[3,4,0,1,2,8,9,5,6,7],[4,0,1,2,3,9,5,6,7,8],[5,9,8,7,6,0,4,3,2,1],[6,5,9,8,7,1,0,4,3,2],[7,6,5,9,8,2,1,0,4,3],[8,7,6,5,9,3,2,1,0,4],[9,8,7,6,5,4,3,2,1,0]] AS m,
[[0,1,2,3,4,5,6,7,8,9],[1,5,7,6,2,8,3,0,9,4],[5,8,0,3,7,9,6,1,4,2],[8,9,1,6,0,4,3,5,2,7],[9,4,5,3,1,2,6,8,7,0],[4,2,8,6,5,7,3,9,0,1],[2,7,9,3,8,0,6,4,1,5],[7,0,4,6,9,1,3,2,5,8]] AS p)
SELECT c_custkey, list_reduce(list_prepend(0, list_transform(range(12), lambda i: p[i % 8 + 1][a[12 - i]::INT + 1])), lambda x, y: m[x + 1][y + 1]) = 0 AS verhoeff,
'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[(36 - list_sum(list_transform(range(14), lambda i: (i % 2 + 1) * (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', b[i + 1]) - 1) // 36 + (i % 2 + 1) * (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', b[i + 1]) - 1) % 36))::INT % 36) % 36 + 1] = b[15] AS gstin,
list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN d[16 - i]::INT * 2 - CASE WHEN d[16 - i]::INT > 4 THEN 9 ELSE 0 END ELSE d[16 - i]::INT END)) % 10 = 0 AS luhn FROM n, t""",
    "texts_before_guard": r"""SELECT lang, count(*) FILTER (coalesce(regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') OR regexp_matches(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b') OR regexp_matches(text, '(?i)\b[A-Z0-9][A-Z0-9._-]{1,}@[A-Z]{2,}\b')
OR regexp_matches(text, '(^|[^0-9])(\+?91[\s\x{00A0}-]?)?[6-9][0-9]{4}[\s\x{00A0}-]?[0-9]{5}($|[^0-9])') OR regexp_matches(text, '\b([0-9][ -]*?){13,19}\b') OR regexp_matches(text, '(?i)\b(password|otp)\s*[:=]\s*[^\s]+'), false)) AS stopped, count(*) AS n FROM documents GROUP BY lang""",
}
