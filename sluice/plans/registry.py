"""The registered queries and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.functions.patterns import TYPES
from sluice.operators import detect, elements, evaluate, evidence, guard, ledger, policy, rank, sessions, spatial
from sluice.plans import actions, controls, corpus, planted
from sluice.sources import page_elements

c = F.col
FOUND = ("EMAIL", "PAYMENT_CARD")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def redaction_evidence_by_lang(spark, sf_dir):
    """Detect, resolve, decide and summarise: hits and distinct items by language and type."""
    found = policy.decide(detect.entities(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang"], FOUND))
    return evidence.summarise(found, ["lang"]).select("lang", "type", "detector_hits", "unique_items", "review_items")


def all_evidence_by_lang(spark, sf_dir):
    """The same by all detectors, overlaps resolved among all."""
    found = policy.decide(detect.entities(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang"]))
    return evidence.summarise(found, ["lang"]).select("lang", "type", "detector_hits", "unique_items", "review_items")


def email_hits_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("hits", F.size(detect.detect(c("text"), ("EMAIL",))))
    return docs.filter("hits > 0").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("hits").cast("long").alias("hits"))


def redact_email_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clean = policy.redact(c("text"), detect.detect(c("text"), ("EMAIL",)))
    return docs.select("doc_id", F.sha2(clean, 256).alias("redacted_sha256"), F.length(clean).cast("long").alias("n_chars_redacted"))


def policy_by_type(spark, sf_dir):
    kinds = spark.createDataFrame([(t, h) for t in TYPES for h in (True, False)], "type string, handled boolean")
    return kinds.select("type", "handled", policy.decision(c("type"), c("handled")).alias("decision"), policy.replacement(c("type")).alias("replacement"))


def detection_cases(spark, sf_dir):
    """Confusion counts of the detectors on the generated cases."""
    cases = corpus.cases(spark)
    return evaluate.set_confusion(cases.withColumn("predicted", F.transform(detect.detect(c("text")), lambda s: s["type"])))


def label_confusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    out = evaluate.confusion(rows, ["lang"], c("toxic") == 1, c("quality") == 0)
    return out.select("lang", "tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def attempts_by_mode(spark, sf_dir):
    return evaluate.attempts(table(spark, sf_dir, "events"), ["event_type"], c("value") > 10, "value")


def stage_medians(spark, sf_dir):
    return evaluate.stage_medians(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])


def planner_round_trips(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    trips = rank.round_trips(e, "user_id", ["ts", "event_id"], "ts", c("event_type") == "click", c("event_type") == "error")
    return trips.groupBy("user_id").agg(F.count("*").alias("trips"), F.min("elapsed_ms").alias("fastest_ms"), F.max("elapsed_ms").alias("slowest_ms"))


def repeated_actions(spark, sf_dir):
    found = rank.repeats(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], c("event_type"), F.substring("props", 1, 7))
    return found.filter("repeated").select("user_id", "event_id", "event_type")


def ring_buffer_last_100(spark, sf_dir):
    return rank.last_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def session_latest_state(spark, sf_dir):
    return sessions.latest(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def session_outcomes(spark, sf_dir):
    """Events read as requests of sessions of four, folded through the state machine."""
    e = table(spark, sf_dir, "events")
    session, step = F.floor(c("event_id") / 4), c("event_id") % 4
    kind = F.when(step == 0, "START").when(step == 2, "STEP").otherwise("VERIFY")
    action = F.concat(F.lit("act_"), (c("event_id") - F.when(step.isin(1, 3), 1).otherwise(0)).cast("string"))
    asked = e.select(session.cast("string").alias("session_id"), step.cast("long").alias("seq"), kind.alias("kind"), F.concat(F.lit("snap_"), c("event_id")).alias("snapshot_id"), action.alias("action_id"), F.when(c("value") > 40, "FINISH").otherwise("ACT").alias("plan"), (c("event_type") != "error").alias("success"))
    return sessions.outcomes(asked).groupBy("kind", "status", "state").agg(F.count("*").alias("n"))


def _blocks(e: DataFrame) -> DataFrame:
    """A ledger of events: previous is the hash before, and hash that of a block with zeros as previous, so windows
    alone make it; every 97th event is altered after hashing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = e.select(c("user_id").cast("string").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("index"), c("event_id").alias("at"), c("event_type").alias("event"), F.lit("CLICK").alias("action"), F.lit(None).cast("string").alias("action_commitment"))
    zero = own.withColumn("hash", ledger.digest({k: c(k) for k in ledger.BODY}, F.lit(ledger.ZEROS)))
    return zero.withColumn("previous", F.lit(ledger.ZEROS)).withColumn("event", F.when(c("at") % 97 == 0, "altered").otherwise(c("event")))


def ledger_first_breaks(spark, sf_dir):
    """First blocks of each session only link to zeros, so the second breaks the link unless the first was altered."""
    return ledger.inspect(_blocks(table(spark, sf_dir, "events")))


def ledger_rebuilt(spark, sf_dir):
    """The same ledger hashed anew, block after block, is whole."""
    return ledger.inspect(ledger.rehash(_blocks(table(spark, sf_dir, "events"))))


def ledger_heads(spark, sf_dir):
    """Safe events of each user as a chained ledger: index and hash of its last block, which depend on every block before."""
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), c("event_id") % len(names))
    e = table(spark, sf_dir, "events").select(
        c("user_id").cast("string").alias("session"), c("event_id").alias("seq"), c("event_id").alias("at"), F.when(c("event_id") % 50 == 0, "NOTE").otherwise(pick(ledger.EVENTS)).alias("event"), pick(ledger.ACTIONS).alias("action"),
        F.when(c("event_id") % 3 == 0, F.sha2(c("event_id").cast("string"), 256)).alias("action_commitment"),
    )
    return ledger.ledger_heads(ledger.append(e.filter(ledger.is_safe()))).drop("seq")


def mask_region_overlaps(spark, sf_dir):
    """Boxes and regions of a snapshot: common area of each region with its boxes."""
    lines = table(spark, sf_dir, "lineitem").withColumn("bbox", F.struct(*[x.cast("double").alias(n) for x, n in ((c("l_quantity") * 20, "x"), (c("l_discount") * 1000, "y"), (c("l_tax") * 5000 + 1, "width"), (c("l_quantity") * 7, "height"))]))
    key = F.concat_ws("-", c("l_orderkey"), c("l_linenumber"))
    boxes = lines.filter("l_linenumber % 2 = 1").select(c("l_orderkey").alias("snapshot_id"), key.alias("box_id"), "bbox")
    regions = lines.filter("l_linenumber % 2 = 0").select(c("l_orderkey").alias("snapshot_id"), key.alias("region_id"), "bbox")
    part = spatial.masks_in_regions(boxes, regions)
    return part.groupBy("snapshot_id", "region_id").agg(F.count("*").alias("boxes"), F.round(F.sum(spatial.area(c("part"))), 3).alias("area"))


def unhinted_regions(spark, sf_dir):
    """Customers without an order stand for regions without a hint: each fails closed as a private document."""
    none = lambda df: df.select(c("o_custkey").cast("string").alias("region_id"), F.lit("s").alias("snapshot_id"), F.lit("FACE").alias("type"), F.lit(None).cast("string").alias("evidence_id"), F.lit(1.0).alias("confidence"), F.lit("").alias("raw_value"))
    hints = none(table(spark, sf_dir, "orders").select("o_custkey").distinct())
    regions = table(spark, sf_dir, "customer").select(F.lit("s").alias("snapshot_id"), c("c_custkey").cast("string").alias("region_id"), F.lit(True).alias("requires_analysis"))
    return elements.visual_entities(hints, hints.limit(0), regions).groupBy("type", "source").agg(F.count("*").alias("entities"), F.countDistinct("region_id").alias("regions"))


def top_parts_by_brand(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return rank.top(parts, ["p_brand"], [c("p_retailprice").desc(), c("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice")


def endpoint_rule(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(guard.endpoint_allowed(c("url")).alias("allowed")).agg(F.count("*").alias("pages"))


def url_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.fnv1a(c("url")).alias("fingerprint"))


def unknown_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.explode(guard.strict_keys(c("props"), ("value", "id"))).alias("key"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"))


def normalised_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("role", tx.normalised(c("text")).alias("t"))
    return turns.groupBy("role", "t").agg(F.count("*").alias("n"))


def page_controls(spark, sf_dir):
    found = page_elements(table(spark, sf_dir, "pages"))
    return found.groupBy("tag", "role").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def page_texts(spark, sf_dir):
    """The texts of each page's paragraphs, items, links and headings, in document order, as one hash a tag."""
    found = page_elements(table(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("dom_index", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return found.select("page_id", "tag", "n", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), 256).alias("texts_sha256"))


def outbound_guard(spark, sf_dir):
    """Documents that the outbound guard would stop, and those clean after redaction of all types."""
    docs = table(spark, sf_dir, "documents").select("lang", c("text"), policy.redact(c("text"), detect.detect(c("text"))).alias("clean"))
    flags = docs.select("lang", guard.payload_status(c("text"), c("text")).alias("before"), guard.payload_status(c("clean"), c("clean")).alias("after"))
    return flags.groupBy("lang", "before", "after").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        redaction_evidence_by_lang, all_evidence_by_lang, email_hits_by_lang, redact_email_text, policy_by_type, detection_cases, label_confusion, latency_percentiles, attempts_by_mode, stage_medians,
        planner_round_trips, repeated_actions, ring_buffer_last_100, session_latest_state, session_outcomes, ledger_first_breaks, ledger_rebuilt, ledger_heads, mask_region_overlaps, unhinted_regions,
        top_parts_by_brand, endpoint_rule, url_fingerprints, unknown_props, normalised_turns, page_controls, page_texts, outbound_guard,
    )
}

QUERIES |= controls.QUERIES | actions.QUERIES | planted.QUERIES

_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_CARD = r"\b(?:[0-9]{4}[ -]){3}[0-9]{4}\b|\b[0-9]{13,19}\b"  # RE2 looks neither ahead nor behind: the two usual forms
_BLOCK = """'{"session":"' || user_id || '","index":' || i || ',"at":' || event_id || ',"event":"' || EVENT || '","action":"CLICK","actionCommitment":null,"previous":"' || repeat('0', 64) || '"}'"""

ORACLE_SQL = {
    "redaction_evidence_by_lang": rf"""
WITH e AS (SELECT lang, 'EMAIL' AS type, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents),
k AS (SELECT lang, unnest(regexp_extract_all(text, '{_CARD}')) AS v FROM documents),
d AS (SELECT lang, v, list_transform(list_reverse(string_split(regexp_replace(v, '[^0-9]', '', 'g'), '')), lambda x: x::INT) AS n FROM k),
p AS (SELECT lang, 'PAYMENT_CARD' AS type, v FROM d WHERE list_sum(list_transform(n, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END)) % 10 = 0 AND len(list_distinct(n)) > 1)
SELECT lang, type, count(*) AS detector_hits, count(DISTINCT lower(trim(v))) AS unique_items, 0::BIGINT AS review_items FROM (SELECT * FROM e UNION ALL SELECT * FROM p) GROUP BY lang, type""",
    "email_hits_by_lang": f"SELECT lang, count(*) AS docs, sum(n)::BIGINT AS hits FROM (SELECT lang, len(regexp_extract_all(text, '{_EMAIL}')) AS n FROM documents) WHERE n > 0 GROUP BY lang",
    "redact_email_text": f"SELECT doc_id, sha256(t) AS redacted_sha256, length(t)::BIGINT AS n_chars_redacted FROM (SELECT doc_id, regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g') AS t FROM documents)",
    "policy_by_type": "SELECT type, handled, CASE WHEN handled THEN 'LOCAL_HANDLE' WHEN type IN ('PASSWORD', 'OTP', 'PAYMENT_CARD', 'AADHAAR_LIKE', 'PRIVATE_DOCUMENT', 'FACE') THEN 'DROP' WHEN type = 'OTHER' THEN 'ASK' ELSE 'ABSTRACT' END AS decision, CASE WHEN type <> 'OTHER' THEN '<' || type || '>' END AS replacement FROM (VALUES "
    + ", ".join(f"('{t}')" for t in TYPES) + ") t(type), (VALUES (true), (false)) h(handled)",
    "label_confusion": """
WITH r AS (SELECT lang, coalesce(toxic = 1, false) AS e, coalesce(quality = 0, false) AS p FROM labels JOIN documents USING (doc_id)),
t AS (SELECT lang, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM r GROUP BY lang),
q AS (SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS re FROM t)
SELECT lang, tp, fp, fn, round(pr, 9) AS "precision", round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1 FROM q""",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "attempts_by_mode": "SELECT event_type, count(*) AS attempts, count(*) FILTER (value > 10) AS completed, round(quantile_cont(value, 0.5) FILTER (value > 10), 6) AS median, round(quantile_cont(value, 0.95) FILTER (value > 10), 6) AS p95 FROM events GROUP BY event_type",
    "stage_medians": "SELECT l_returnflag, stage, round(quantile_cont(value, 0.5), 6) AS median FROM (UNPIVOT (SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME stage VALUE value) GROUP BY l_returnflag, stage",
    "planner_round_trips": """
WITH r AS (SELECT user_id, ts, event_type = 'click' AS sent, lead(event_type = 'click') OVER w AS nxt, lead(ts) OVER w AS back FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, epoch_us(back) // 1000 - epoch_us(ts) // 1000 AS ms FROM r WHERE sent AND NOT nxt)
SELECT user_id, count(*) AS trips, min(ms) AS fastest_ms, max(ms) AS slowest_ms FROM p GROUP BY user_id""",
    "repeated_actions": """
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w = event_type AND lag(substring(props, 1, 7)) OVER w = substring(props, 1, 7) AS rep FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rep""",
    "ring_buffer_last_100": "SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100 GROUP BY user_id",
    "session_latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY user_id",
    "ledger_first_breaks": f"""
WITH b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
h AS (SELECT *, sha256({_BLOCK.replace("EVENT", "event_type")}) AS hash, sha256({_BLOCK.replace("EVENT", "CASE WHEN event_id % 97 = 0 THEN 'altered' ELSE event_type END")}) AS again FROM b),
k AS (SELECT user_id, i, CASE WHEN i > 0 THEN 'LINK' WHEN hash <> again THEN 'HASH' END AS bad FROM h)
SELECT user_id::VARCHAR AS session, count(*) AS n_blocks, count(bad) = 0 AS valid, min(i) FILTER (bad IS NOT NULL) AS first_bad, arg_min(bad, i) FILTER (bad IS NOT NULL) AS "check" FROM k GROUP BY user_id""",
    "ledger_rebuilt": """SELECT user_id::VARCHAR AS session, count(*) AS n_blocks, true AS valid, NULL::BIGINT AS first_bad, NULL::VARCHAR AS "check" FROM events GROUP BY user_id""",
    "ledger_heads": f"""
WITH RECURSIVE s AS (SELECT user_id::VARCHAR AS session, event_id AS t, {list(ledger.EVENTS)}[event_id % {len(ledger.EVENTS)} + 1] AS event, {list(ledger.ACTIONS)}[event_id % {len(ledger.ACTIONS)} + 1] AS action,
CASE WHEN event_id % 3 = 0 THEN '"' || sha256(event_id::VARCHAR) || '"' ELSE 'null' END AS commitment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE event_id % 50 <> 0),
h AS (SELECT session, -1::BIGINT AS i, repeat('0', 64) AS hash FROM (SELECT DISTINCT session FROM s) UNION ALL
SELECT s.session, s.i, sha256('{{"session":"' || s.session || '","index":' || s.i || ',"at":' || s.t || ',"event":"' || s.event || '","action":"' || s.action || '","actionCommitment":' || commitment || ',"previous":"' || h.hash || '"}}') FROM h JOIN s ON s.session = h.session AND s.i = h.i + 1)
SELECT session, max(i) AS "index", arg_max(hash, i) AS hash FROM h GROUP BY session""",
    "mask_region_overlaps": """
WITH b AS (SELECT l_orderkey AS s, l_linenumber AS n, l_orderkey || '-' || l_linenumber AS id, (l_quantity * 20)::DOUBLE AS x, (l_discount * 1000)::DOUBLE AS y, (l_tax * 5000 + 1)::DOUBLE AS w, (l_quantity * 7)::DOUBLE AS h FROM lineitem),
p AS (SELECT DISTINCT r.s, r.id, a.id AS box, greatest(a.x, r.x) AS px, greatest(a.y, r.y) AS py, least(a.x + a.w, r.x + r.w) - greatest(a.x, r.x) AS dx, least(a.y + a.h, r.y + r.h) - greatest(a.y, r.y) AS dy FROM b a JOIN b r ON a.s = r.s AND a.n % 2 = 1 AND r.n % 2 = 0)
SELECT s AS snapshot_id, id AS region_id, count(*) AS boxes, round(sum(dx * dy), 3) AS area FROM p WHERE dx > 0 AND dy > 0 GROUP BY s, id""",
    "unhinted_regions": """
SELECT 'FACE' AS type, 'VISION' AS source, count(*) AS entities, count(DISTINCT o_custkey) AS regions FROM (SELECT DISTINCT o_custkey FROM orders) HAVING count(*) > 0
UNION ALL SELECT 'PRIVATE_DOCUMENT', 'VISION', count(*), count(DISTINCT c_custkey) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) HAVING count(*) > 0""",
    "top_parts_by_brand": "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3",
    "endpoint_rule": "SELECT coalesce(regexp_matches(url, '^https:') OR regexp_matches(url, '^[a-z]+://(127\\.0\\.0\\.1|localhost)([:/?#]|$)'), false) AS allowed, count(*) AS pages FROM pages GROUP BY 1",
    "url_fingerprints": "SELECT page_id, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda x: unicode(x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295)) AS fingerprint FROM pages",
    "unknown_props": "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('value', 'id') GROUP BY event_type, key",
    "normalised_turns": r"SELECT role, t, count(*) AS n FROM (SELECT role, nullif(trim(regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]+', ' ', 'g')), '') AS t FROM conversations) GROUP BY role, t",
}
ORACLE_SQL["detection_cases"] = "SELECT type, n AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1::DOUBLE AS precision, 1::DOUBLE AS recall, 1::DOUBLE AS f1 FROM (VALUES " + ", ".join(f"('{kind}', {n}::BIGINT)" for kind, (n, _, _) in corpus.POSITIVES.items()) + ") t(type, n)"
ORACLE_SQL["session_outcomes"] = """
WITH e AS (SELECT event_id // 4 AS s, event_id % 4 AS i, value > 40 AS done, event_type <> 'error' AS ok FROM events),
w AS (SELECT s, max(CASE WHEN i = 0 THEN done::INT END) AS d0, max(CASE WHEN i = 1 THEN ok::INT END) AS o1, max(CASE WHEN i = 2 THEN done::INT END) AS d2, max(CASE WHEN i = 3 THEN ok::INT END) AS o3 FROM e GROUP BY s),
a AS (SELECT *, CASE WHEN d0 IS NULL THEN 'NONE' WHEN d0 = 1 THEN 'COMPLETE' ELSE 'EXECUTE' END AS s0 FROM w),
b AS (SELECT *, CASE WHEN o1 IS NULL OR s0 <> 'EXECUTE' THEN s0 WHEN o1 = 1 THEN 'OBSERVE' ELSE 'FAILED' END AS s1 FROM a),
c AS (SELECT *, CASE WHEN d2 IS NULL OR s1 <> 'OBSERVE' THEN s1 WHEN d2 = 1 THEN 'COMPLETE' ELSE 'EXECUTE' END AS s2 FROM b),
d AS (SELECT *, CASE WHEN o3 IS NULL OR s2 <> 'EXECUTE' OR s1 <> 'OBSERVE' THEN s2 WHEN o3 = 1 THEN 'OBSERVE' ELSE 'FAILED' END AS s3 FROM c),
r AS (SELECT 'START' AS kind, 200 AS status, s0 AS state FROM d WHERE d0 IS NOT NULL
UNION ALL SELECT 'VERIFY', CASE WHEN s0 = 'NONE' THEN 404 WHEN s0 = 'EXECUTE' THEN 200 ELSE 409 END, s1 FROM d WHERE o1 IS NOT NULL
UNION ALL SELECT 'STEP', CASE WHEN s1 = 'NONE' THEN 404 WHEN s1 = 'OBSERVE' THEN 200 ELSE 409 END, s2 FROM d WHERE d2 IS NOT NULL
UNION ALL SELECT 'VERIFY', CASE WHEN s2 = 'NONE' THEN 404 WHEN s2 = 'EXECUTE' AND s1 = 'OBSERVE' THEN 200 ELSE 409 END, s3 FROM d WHERE o3 IS NOT NULL)
SELECT kind, status::INT AS status, state, count(*) AS n FROM r GROUP BY ALL"""
# These pages have paragraphs without end tags, plain links, items and headings, and no fields.
_PAGE = r"""
WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<br>', ' ', 'g') AS h FROM pages),
l AS (SELECT page_id, 'a' AS tag, regexp_extract_all(h, '(?s)<a [^>]*>(.*?)</a>', 1) AS t FROM h UNION ALL SELECT page_id, 'li', regexp_extract_all(h, '(?s)<li>(.*?)</li>', 1) FROM h
UNION ALL SELECT page_id, 'h1', regexp_extract_all(h, '(?s)<h1>(.*?)</h1>', 1) FROM h
UNION ALL SELECT page_id, 'p', list_transform(string_split(h, '<p>')[2:], lambda x: regexp_extract(x, '(?s)^(.*?)(?:</?(?:p|article|footer|div|ul|h1)>|$)', 1)) FROM h),
e AS (SELECT page_id, tag, generate_subscripts(t, 1) AS i, replace(replace(replace(replace(replace(replace(regexp_replace(unnest(t), '<[^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM l),
n AS (SELECT page_id, tag, i, rtrim(left(trim(regexp_replace(t, '\s+', ' ', 'g')), 2000)) AS t FROM e)"""
ORACLE_SQL["page_controls"] = f"{_PAGE} SELECT tag, CASE tag WHEN 'a' THEN 'link' WHEN 'h1' THEN 'heading' ELSE tag END AS role, count(*) AS n, count(DISTINCT page_id) AS pages FROM n GROUP BY tag"
ORACLE_SQL["page_texts"] = f"{_PAGE} SELECT page_id, tag, count(*) AS n, sha256(string_agg(t, chr(10) ORDER BY i)) AS texts_sha256 FROM n GROUP BY page_id, tag"
ORACLE_SQL["all_evidence_by_lang"] = ORACLE_SQL["redaction_evidence_by_lang"]  # the corpus holds no value of the other types
ORACLE_SQL |= controls.ORACLE_SQL | actions.ORACLE_SQL | planted.ORACLE_SQL
