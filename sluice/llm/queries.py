"""One query for each training-data operator, with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import conversations, decontaminate, filteraudit, fingerprint, jaccardjoin, langid, lattice, linededup, lmscore, packing, sharding, suffixdedup, toxicity
from sluice.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(table(spark, sf_dir, "documents"), length=50)


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), n_shards=40)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(table(spark, sf_dir, "documents"), order=3, alpha=0.4, least=2)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.near_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_language_id, op3_fingerprints, op4_line_dedup, op5_benchmark_decontamination, op6_suffix_array_dedup, op7_nnls_packing, op8_hilbert_sharding, op9_lm_scoring, op10_ngram_jaccard_join,
        op11_conversation_repair, op12_lattice_near_dedup, op13_filter_audit,
    )
}


def _repair_sql() -> str:
    """Forward costs of the four states, each with the first of its cheapest audits as one string (nine digits of cost, then the edits): row by row by
    recursion. Of two audits over the same rows neither begins the other, so the least string is the least by cost and then ASCII."""
    add = lambda f, cost, edit: f"lpad((substr({f}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({f}, 10) || '{edit}'"
    pay = lambda cost: f"{cost} + CASE WHEN truncated THEN 5 ELSE 0 END"
    when = lambda cond, value: f"CASE WHEN {cond} THEN {value} END"
    n, s, u, a = "n", "s", "u", "a"

    # States once turns may have been inserted: u after the start, s or a; a after u.
    to_u = {q: add(q, 5, "I") for q in "nsa"}
    c = {n: n, s: s, u: f"least(u, {to_u[n]}, {to_u[s]}, {to_u[a]})", a: f"least(a, {add(u, 5, 'I')}, {add(f'({to_u[n]})', 5, 'I')}, {add(f'({to_u[s]})', 5, 'I')})"}
    step = {
        n: add("cn", 2, "D"),
        s: f"least({add('cs', 2, 'D')}, {when('NOT gone AND kind = chr(115)', add('cn', pay(0), 'K'))})",
        u: "least(" + ", ".join([add("cu", 2, "D"), *(when("NOT gone AND kind = chr(117)", add(f"c{q}", pay(0), "K")) for q in "nsa"), *(when("NOT gone", add(f"c{q}", pay(1), "R")) for q in "nsa")]) + ")",
        a: f"least({add('ca', 2, 'D')}, {when('NOT gone AND kind = chr(97)', add('cu', pay(0), 'K'))}, {when('NOT gone', add('cu', pay(1), 'R'))})",
    }
    return rf"""
WITH RECURSIVE tabs AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i))
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), hashed AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS h FROM raw, tabs
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE h <> 0
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows_
), faults AS (
  SELECT *, role[1] AS kind, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate, bare <> '' AND nth = 1 AND bare[-1] NOT IN ('.', '!', '?') AS truncated FROM seen
), f AS (
  SELECT *, blank OR duplicate AS gone, coalesce(lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults
), told AS (
  SELECT conv_id, count(*) AS rows_in, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id
), walk(conv_id, i, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM told
  UNION ALL
  SELECT conv_id, i, {step[n]}, {step[s]}, {step[u]}, {step[a]}
  FROM (SELECT w.conv_id, f.i, kind, gone, truncated, {c[n]} AS cn, {c[s]} AS cs, {c[u]} AS cu, {c[a]} AS ca FROM walk w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)
), ended AS (
  SELECT conv_id, best[1:9]::BIGINT AS cost, best[10:] AS audit FROM (SELECT w.conv_id, least({c[n]}, {c[a]}) AS best FROM walk w JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.rows_in)
), edits AS (
  SELECT conv_id, p, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS m
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p FROM ended WHERE audit <> '')
), made AS (
  SELECT e.conv_id, p, edit, m, CASE WHEN edit = 'I' THEN NULL ELSE f.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
    max((m = 1 AND edit = 'K' AND f.kind = 's')::INT) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i WHERE edit <> 'D'
), hashes AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS sha FROM made GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN hashes h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, i, line, {_LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), k AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id
""",
    "op5_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, win)
), hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_lm_scoring": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w3,
    CASE WHEN i > 1 THEN w[i - 1] END AS c1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS c2
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), n1 AS (SELECT w1, count(*) AS n FROM t GROUP BY w1), n2 AS (SELECT w2, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY w2),
n3 AS (SELECT w3, count(*) AS n FROM t WHERE w3 IS NOT NULL GROUP BY w3), s AS (
  SELECT t.doc_id,
    CASE WHEN n3.n >= 2 THEN ln(n3.n / p2.n::DOUBLE)
         WHEN n2.n >= 2 THEN ln(n2.n / p1.n::DOUBLE) + CASE WHEN i > 2 THEN ln(0.4::DOUBLE) ELSE 0 END
         ELSE ln(n1.n / (SELECT count(*) FROM t)::DOUBLE) + least(i - 1, 2) * ln(0.4::DOUBLE) END AS log,
    (i > 2 AND n3.n < 2 OR i = 2 AND n2.n < 2)::INT AS backed
  FROM t JOIN n1 USING (w1) LEFT JOIN n2 USING (w2) LEFT JOIN n3 USING (w3) LEFT JOIN n1 p1 ON p1.w1 = t.c1 LEFT JOIN n2 p2 ON p2.w2 = t.c2
), a AS (SELECT doc_id, sum(log) AS log, sum(backed) AS backed, count(*) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(backed, 0)::BIGINT AS n_backed_off, round(coalesce(log, 0), 4) AS log_score, round(log / n, 4) AS log_score_per_token
FROM d LEFT JOIN a USING (doc_id)
""",
    "op6_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, o, least(1000, len(h) // 2 - o) AS n, len(h) // 2 - 49 - o AS last, h[2 * o + 1:2 * o + 2098] AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS o FROM d)),
b AS (SELECT doc_id, o, last, h, unnest(range(1, n + 1)) AS j FROM p),
w AS (SELECT doc_id, o + j AS i, h[2 * j - 1:2 * j] AS byte, CASE WHEN j <= last THEN md5_number(h[2 * j - 1:2 * j + 98]) END AS win FROM b),
f AS (SELECT win, min(doc_id) AS first FROM w WHERE win IS NOT NULL GROUP BY win),
c AS (SELECT doc_id, i, byte, coalesce(first < doc_id, false)::INT AS covered FROM w LEFT JOIN f USING (win)),
g AS (SELECT doc_id, i, byte, max(covered) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM c),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM g),
t AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone = 1) AS n_removed, count(*) FILTER (gone = 1 AND was = 0) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
""",
    "op10_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (x + y - c)), both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS least FROM s UNION SELECT b, least FROM r JOIN both_ ON node = a WHERE least < b)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, min(least) AS component_id FROM s JOIN r ON node = s.doc_id GROUP BY ALL
""",
    "op11_conversation_repair": _repair_sql(),
    "op12_lattice_near_dedup": """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.i AS a, b.i AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.i <> b.i AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (WITH RECURSIVE w AS (SELECT i AS node, vec_id AS least FROM v UNION SELECT b, least FROM w JOIN l ON node = a) SELECT node, min(least) AS component_id FROM w GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN r ON node = i LEFT JOIN n ON a = i
""",
    "op13_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w JOIN first USING (text) LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS many FROM m GROUP BY ALL
), f AS (SELECT unnest(range(1, 6)) AS f), o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (SELECT o, array_to_string(list_transform(o, lambda x: chr((64 + x)::INT)), '') AS filter_order, step, o[step] AS f, o[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), t AS (
  SELECT part, filter_order, step::INT AS step, f, n, good, toxic, many, fails[f] AS now, len(list_filter(earlier, lambda x: fails[x])) > 0 AS before FROM c, s
), g AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT now AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (now AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (now AND many = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (now AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT before), 0)::BIGINT AS toxic_lost FROM t GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
""",
}
