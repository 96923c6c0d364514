"""Queries over texts that hold one value of each detector's kind, made of customers' numbers, and over successive snapshots of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.functions.patterns import BASE36, VERHOEFF_PERMUTATION, VERHOEFF_PRODUCT
from sluice.operators import detect, planner, policy, tagger
from sluice.operators.spread import spread

c = F.col


def _digits(number: str, n: int) -> str:
    return f"lpad(CAST({number} AS STRING), {n}, '0')"


_TEN = "CAST(9000000000 + k * 7919 % 1000000000 AS STRING)"
#: Type, words before the value, the value, and what ends it, in SQL that both engines read (k is a customer's number). The last two kinds
#: hold a second candidate that overlaps and gives way.
KINDS = (
    ("EMAIL", "'write to '", "'u' || CAST(k AS STRING) || '.x@mail.example'", "''"),
    ("PHONE", "'call '", f"'+91 ' || {_digits('60000 + k % 40000', 5)} || '-' || {_digits('k * 7919 % 100000', 5)}", "''"),
    ("PHONE", "'call '", _TEN, "''"),
    ("PAN", "'tax '", f"'ABCDE' || {_digits('k % 10000', 4)} || 'F'", "''"),
    ("GSTIN", "'firm '", f"'27AAPFU' || {_digits('k % 10000', 4)} || 'F1Z' || substr('{BASE36}', CAST(k % 36 + 1 AS INT), 1)", "''"),
    ("IFSC", "'branch '", f"'HDFC0' || {_digits('k * 31 % 1000000', 6)}", "''"),
    ("UPI_ID", "'pay '", "'pay.u' || CAST(k AS STRING) || '@okbank'", "''"),
    ("PAYMENT_CARD", "'card '", f"'41111111' || {_digits('k * 37 % 100000000', 8)}", "'.'"),
    ("AADHAAR_LIKE", "'number '", f"'2345' || {_digits('k * 7919 % 100000000', 8)}", "''"),
    ("OTP", "'the otp is '", _digits("k * 101 % 1000000", 6), "''"),
    ("PASSWORD", "'password: '", "'pw' || CAST(k AS STRING) || '!x'", "''"),
    ("ACCOUNT_ID", "'customer id: '", "'AB-' || CAST(10000 + k AS STRING)", "''"),
    ("PERSON_NAME", "'name: '", "CASE k % 3 WHEN 0 THEN 'Asha Rao' WHEN 1 THEN 'Ben Okafor' ELSE 'Lena Vogt Ortiz' END", "'.'"),
    ("ADDRESS", "'address: '", "'House ' || CAST(k % 90 AS STRING) || ', Mill Lane'", "chr(10)"),
    ("MEDICAL", "'diagnosis: '", "'mild asthma, type ' || CAST(k % 4 AS STRING)", "chr(10)"),
    ("PASSWORD", "'password: '", "'u' || CAST(k AS STRING) || '@mail.example'", "''"),
    ("PHONE", "'address: Flat 3, '", _TEN, "chr(10)"),
)


def _case(column: int) -> str:
    return "CASE k % " + str(len(KINDS)) + " " + " ".join(f"WHEN {i} THEN {kind[column]}" for i, kind in enumerate(KINDS)) + " END"


_ROWS = f"SELECT k, segment, {_case(1)} AS words, {_case(2)} AS value, {_case(3)} AS ends FROM (SELECT c_custkey AS k, c_mktsegment AS segment FROM {{customer}})"


def _planted(spark, sf_dir):
    rows = spark.sql(_ROWS, customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey"))
    return rows.select("k", F.concat(F.lit("Note "), "segment", F.lit("\n"), "words", "value", "ends", F.lit(" seen on file")).alias("text"))


def planted_entities(spark, sf_dir):
    """All detectors over the texts: each accepted span, where it lies, and what policy decides."""
    found = policy.decide(detect.entities(_planted(spark, sf_dir), "text", ["k"]))
    return found.select(c("k").alias("custkey"), "type", F.sha2("raw_value", 256).alias("value_sha256"), "start", "stop", "decision", "replacement")


def planted_redacted(spark, sf_dir):
    """The texts after redaction of all types."""
    return _planted(spark, sf_dir).select(c("k").alias("custkey"), policy.redact(c("text"), detect.detect(c("text"))).alias("clean"))


def tagged_values(spark, sf_dir):
    """A tagger, trained on what the detectors find in three quarters of the documents (at most 2000 of them), against the detectors on all: learned and held-out documents apart."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("text", (F.crc32(c("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"))
    found = docs.withColumn("known", F.transform(detect.detect(c("text")), lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), (s["start"] + F.length(F.regexp_replace(s["value"], "[ -]+$", ""))).alias("stop"))))  # a card's shape takes the blank after it, too
    model = tagger.train(found.filter(~c("held_out")), "text", "known", rounds=8, parts=2, bits=18, most_docs=2000, spanned=True)
    return tagger.span_scores(tagger.tag(found, "text", model), "known", "spans", ("held_out",))


def fingerprint_changes(spark, sf_dir):
    """Snapshots of sessions (events of a user): those whose fingerprint differs from the one before, and how soon after an action (click) the page first changed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("user_id", "event_id", "ts", c("event_type").alias("kind"), tx.fnv1a(F.concat_ws("|", F.substring("event_type", 1, 1), F.round(c("value") / 20).cast("int").cast("string"))).alias("fingerprint"))
    return planner.fingerprint_changes(rows, "user_id", ["ts", "event_id"], "ts", c("kind") == "click", most_ms=3_600_000).groupBy("user_id").agg(
        F.count_if("changed").alias("changes"), F.count_if(c("outcome") == "CHANGED").alias("in_time"), F.count_if(c("outcome") == "UNCHANGED").alias("unchanged"), F.sum("waited_ms").alias("waited_ms")
    )


QUERIES = {f.__name__: f for f in (planted_entities, planted_redacted, tagged_values, fingerprint_changes)}

_VALID = f"""CASE k % {len(KINDS)}
WHEN 4 THEN '{BASE36}'[(36 - list_sum(list_transform(range(14), lambda i: (i % 2 + 1) * (instr('{BASE36}', value[i + 1]) - 1) // 36 + (i % 2 + 1) * (instr('{BASE36}', value[i + 1]) - 1) % 36))::INT % 36) % 36 + 1] = value[15]
WHEN 7 THEN list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN value[16 - i]::INT * 2 - CASE WHEN value[16 - i]::INT > 4 THEN 9 ELSE 0 END ELSE value[16 - i]::INT END)) % 10 = 0
WHEN 8 THEN list_reduce(list_prepend(0, list_transform(range(12), lambda i: {[list(r) for r in VERHOEFF_PERMUTATION]}[i % 8 + 1][value[12 - i]::INT + 1])), lambda x, y: {[list(r) for r in VERHOEFF_PRODUCT]}[x + 1][y + 1]) = 0
ELSE true END"""
_TYPED = f"""WITH r AS ({_ROWS.format(customer='customer')}), t AS (SELECT *, 'Note ' || segment || chr(10) || words AS before, [{', '.join(f"'{kind[0]}'" for kind in KINDS)}][k % {len(KINDS)} + 1] AS type,
CASE k % {len(KINDS)} WHEN 4 THEN length(value) = 15 WHEN 7 THEN length(value) = 16 WHEN 8 THEN length(value) = 12 ELSE true END AND {_VALID} AS ok FROM r)"""
ORACLE_SQL = {
    "planted_entities": f"""{_TYPED} SELECT k AS custkey, type, sha256(value) AS value_sha256, length(before)::INT AS "start", (length(before) + length(value))::INT AS stop,
CASE WHEN type IN ('PASSWORD', 'OTP', 'PAYMENT_CARD', 'AADHAAR_LIKE') THEN 'DROP' ELSE 'ABSTRACT' END AS decision, '<' || type || '>' AS replacement FROM t WHERE ok""",
    "planted_redacted": f"{_TYPED} SELECT k AS custkey, before || CASE WHEN ok THEN '<' || type || '>' ELSE value END || ends || ' seen on file' AS clean FROM t",
    "fingerprint_changes": """
WITH s AS (SELECT user_id, event_id, ts, event_type, event_type[1] || '|' || round(value / 20)::INT AS page FROM events),
b AS (SELECT *, page <> lag(page) OVER w AS changed, lag(page) OVER w AS was, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT a.user_id, a.event_id, a.page, a.ts, (SELECT arg_min(b.ts, b.n) FROM b WHERE b.user_id = a.user_id AND b.n > a.n AND b.page <> a.page) AS first_ts, (SELECT max(n) FROM b WHERE b.user_id = a.user_id) > n AS more FROM b a WHERE a.event_type = 'click'),
o AS (SELECT user_id, CASE WHEN epoch_us(first_ts) // 1000 - epoch_us(ts) // 1000 <= 3600000 THEN 'CHANGED' WHEN more THEN 'UNCHANGED' END AS outcome, CASE WHEN epoch_us(first_ts) // 1000 - epoch_us(ts) // 1000 <= 3600000 THEN epoch_us(first_ts) // 1000 - epoch_us(ts) // 1000 END AS waited FROM a)
SELECT c.user_id, changes, coalesce(in_time, 0) AS in_time, coalesce(unchanged, 0) AS unchanged, waited_ms FROM (SELECT user_id, count(*) FILTER (changed) AS changes FROM b GROUP BY user_id) c
LEFT JOIN (SELECT user_id, count(*) FILTER (outcome = 'CHANGED') AS in_time, count(*) FILTER (outcome = 'UNCHANGED') AS unchanged, sum(waited)::BIGINT AS waited_ms FROM o GROUP BY user_id) o USING (user_id)""",
}
