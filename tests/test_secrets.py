"""Known secrets and forbidden keys in payloads, exact percentiles of large groups."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import evaluate, guard


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_secrets_by_brute_force(spark):
    rng = random.Random(5)
    letter = lambda n: "".join(rng.choice("abcé🙂 0") for _ in range(n))
    secrets = [letter(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 60])) for _ in range(300)] + ["", None, "aaaaaaaa", "a" * 40, "never"]
    secrets += secrets[:20]
    payloads = []
    for i in range(400):
        text = letter(rng.choice([0, 1, 5, 40, 300]))
        for s in rng.sample(secrets, 2):
            if s and rng.random() < 0.6:
                at = rng.randrange(len(text) + 1)
                text = text[:at] + s + text[at:]
        payloads.append((rng.choice([i, i, i, None, 7]), text))
    payloads += [(1000, None), (1001, "a" * 39), (1002, "a" * 41), (1003, "x" * 5000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in payloads], "payload_id long, payload string, secret string, level int")
    found = {tuple(r) for r in guard.leaks(df, spark.createDataFrame([(s,) for s in secrets], "secret string")).collect()}
    assert found == {(i, sha(s)) for i, text in payloads for s in set(secrets) if text is not None and s and s in text}


def test_many_secrets_in_one_plan(spark):
    """The plan and its broadcasts do not grow with the secrets."""
    secrets = spark.range(300_000).select(F.concat(F.lit("key-"), F.sha2(F.col("id").cast("string"), 256)).alias("secret"))
    payloads = spark.range(200).select(F.col("id").alias("payload_id"), F.concat(F.lit("text before key-"), F.sha2((F.col("id") * 5000).cast("string"), 256), F.lit(" and after")).alias("payload"))
    found = guard.leaks(payloads, secrets)
    rows = found.collect()
    assert sorted(r["payload_id"] for r in rows) == list(range(60))
    assert all(r["secret_sha256"] == sha("key-" + sha(str(r["payload_id"] * 5000))) for r in rows)


def test_secrets_that_begin_alike(spark):
    """A payload meets secrets of a common beginning once for each size and place, not once each."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0"))
    secrets = spark.range(2000).select(name.alias("secret"))
    payloads = spark.range(2000, 4000).select(F.col("id").alias("payload_id"), F.concat(name, F.lit(" and "), F.lit("Customer#000000040")).alias("payload"))
    rows = payloads.withColumn("text_hash", F.xxhash64("payload"))
    assert guard.possible_places(rows, secrets, "payload_id").count() <= 3 * 2000
    assert {(r["secret_sha256"]) for r in guard.leaks(payloads, secrets).collect()} == {sha("Customer#000000040")}


def test_odd_secrets(spark):
    none = spark.createDataFrame([], "secret string")
    df = spark.createDataFrame([(1, "abc")], "payload_id long, payload string")
    assert guard.leaks(df, none).collect() == [] and guard.leaks(df.limit(0), spark.createDataFrame([("abc",)], "secret string")).collect() == []


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ('{"a":{"token":1}}', ["token"]), (r'{"token":"x"}', [r"token"]), ('{"a":"token"}', []), ('{"privacy_summary":{"PASSWORD":2,"OTP":1}}', []), ('{"privacy_summary":[{"password":1}]}', []),
        ('{"privacy_summary":[[{"password":1}]]}', []), ('{"privacy_summary":{"x":{"password":1}}}', ["password"]), ('{"a":[{"b":[{"Cookie":1,"raw_dom":2}]}]}', ["Cookie", "raw_dom"]), ('{"a":{"privacy_summary":{"otp":1}}}', []),
        ('{"otp": not json', ["otp"]), ("", []), ("[" * 500 + '{"authorization":1}' + "]" * 500, ["authorization"]), ('{"x\\"token":1}', ['x"token']), ('"token"', []), ("null", []), ('{"privacy_summary":{},"mytokens":{}}', ["mytokens"]),
    ],
)
def test_forbidden_keys(text, keys):
    assert guard.forbidden_keys(text) == keys


def test_forbidden_properties_of_rows(spark):
    rows = [(1, r'{"token":"x"}'), (2, None), (3, '{"fine":"token"}'), (4, json.dumps({"a": {"b": {"password": 1}}}))]
    got = spark.createDataFrame(rows, "n int, j string").select("n", guard.forbidden_properties(F.col("j")).alias("k")).orderBy("n").collect()
    assert [r["k"] for r in got] == [["token"], [], [], ["password"]]


def test_percentiles_of_a_large_group(spark):
    """A million values: few of them are ranked in one task, and the ranks are exact."""
    n = 1_000_000
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(10**7)) / 7).alias("v"))
    want = np.array([r[0] for r in df.collect()])
    got = evaluate.percentiles(df, [], "v", {"p01": 0.01, "p50": 0.5, "p999": 0.999}).first()
    for name, p in (("p01", 0.01), ("p50", 0.5), ("p999", 0.999)):
        assert abs(got[name] - np.percentile(want, 100 * p)) < 1e-5
    low, high = np.quantile(want, [0.5 - 3 / evaluate.SKETCH, 0.5 + 3 / evaluate.SKETCH])
    assert ((want >= low) & (want <= high)).sum() < n / 1000
