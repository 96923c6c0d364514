"""Streams against their batch forms: deadlines, confirmations, ledgers, distinct requests, windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluice import streaming
from sluice.operators import ledger
from sluice.streaming import timers


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get(*timers.STORE)
    for k, v in timers.STORE.items():
        spark.conf.set(k, v)
    yield spark
    spark.conf.set(next(iter(timers.STORE)), before)


def streamed(spark, tmp_path, parts, schema, query):
    """The rows that a stream makes of files, one a trigger."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    run = query(stream).writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out", format="parquet")
    assert run.awaitTermination(240)
    return spark.read.parquet(f"file://{tmp_path}/out")


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def dealt(rng, rows, n, jitter):
    """Rows in n parts, about in order of time."""
    rows = sorted(rows, key=lambda r: r[1] + rng.uniform(0, jitter))
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_deadlines_of_a_run(store):
    s = 1000
    rows = [
        ("a", 0, 1, "START", None), ("a", 60 * s, 2, "STEP", None), ("a", 70 * s, 3, "ASK", None), ("a", 270 * s, 4, "ANSWER", None), ("a", 319 * s, 5, "STEP", None), ("a", 321 * s, 6, "STEP", None),
        ("b", 0, 1, "START", "JOURNEY"), ("b", 239 * s, 2, "STEP", None), ("b", 240 * s, 3, "STEP", None), ("c", 0, 1, "STEP", None), ("d", 0, 1, "START", None), ("d", 5, 2, "FINISH", None), ("d", 6, 3, "STEP", None),
        ("d", 7, 4, "START", "REHEARSAL"), ("e", 0, 1, "START", None), ("e", 1, 2, "ASK", None), ("e", 500 * s, 3, "STEP", None), (None, 0, 1, "START", None), ("f", None, 1, "START", None), ("f", 1, 1, "OTHER", None),
    ]
    got = {(r["run_id"], r["at_ms"], r["kind"]): r["outcome"] for r in timers.run_outcomes(store.createDataFrame(rows, timers.RUN_IN), F.lit(1000 * s)).collect()}
    assert got == {
        ("a", 0, "START"): "STARTED", ("a", 60 * s, "STEP"): "RUN", ("a", 70 * s, "ASK"): "WAITING", ("a", 270 * s, "ANSWER"): "ANSWERED", ("a", 319 * s, "STEP"): "RUN", ("a", 320 * s, "TIMER"): "DEADLINE", ("a", 321 * s, "STEP"): "ENDED",
        ("b", 0, "START"): "STARTED", ("b", 239 * s, "STEP"): "RUN", ("b", 240 * s, "TIMER"): "DEADLINE", ("b", 240 * s, "STEP"): "ENDED", ("c", 0, "STEP"): "UNKNOWN",
        ("d", 0, "START"): "STARTED", ("d", 5, "FINISH"): "FINISHED", ("d", 6, "STEP"): "ENDED", ("d", 7, "START"): "STARTED", ("d", 300 * s + 7, "TIMER"): "DEADLINE",
        ("e", 0, "START"): "STARTED", ("e", 1, "ASK"): "WAITING", ("e", 500 * s, "STEP"): "RUN",
    }
    steps = [("g", i, i, "STEP" if i else "START", None) for i in range(45)]
    many = [r["outcome"] for r in timers.run_outcomes(store.createDataFrame(steps, timers.RUN_IN), F.lit(100)).orderBy("seq").collect()]
    assert many == ["STARTED"] + ["RUN"] * 40 + ["STEP_LIMIT"] + ["ENDED"] * 3


def test_deadline_stream_equals_batch(store, tmp_path):
    rng = random.Random(1)
    rows = []
    for run in range(25):
        at = rng.randrange(60_000)
        for seq in range(rng.randrange(2, 20)):
            rows.append((f"r{run}", at, seq, rng.choice(["START", "STEP", "STEP", "STEP", "ASK", "ANSWER", "FINISH"]) if seq else "START", rng.choice([None, "JOURNEY"])))
            at += rng.choice([0, 1, 5_000, 40_000, 90_000])
    last = max(r[1] for r in rows)
    end = [("z", last + 400_000, 0, "START", None), ("y", last + 420_000, 0, "START", None)]
    got = streamed(store, tmp_path, [*dealt(rng, rows, 4, 8_000), end[:1], end[1:]], timers.RUN_IN, lambda s: timers.run_deadlines(s, "10 seconds"))
    assert values(got.filter("run_id < 's'")) == values(timers.run_outcomes(store.createDataFrame(rows, timers.RUN_IN), F.lit(last + 300_000)).select(*got.columns))


def test_confirmations(store, tmp_path):
    s = 1000
    rows = [
        ("a", 1, 0, "RUN", None, None), ("a", 1, 1, "REQUEST", "q1", None), ("a", 299 * s, 2, "ANSWER", "q1", True), ("a", 300 * s, 3, "ANSWER", "q1", True), ("a", 400 * s, 4, "REQUEST", "q2", None), ("a", 700 * s, 5, "ANSWER", "q2", True),
        ("a", 701 * s, 6, "REQUEST", "q3", None), ("a", 702 * s, 7, "RUN", None, None), ("a", 703 * s, 8, "ANSWER", "q3", True), ("a", 704 * s, 9, "REQUEST", "q4", None), ("a", 705 * s, 10, "ANSWER", "q4", False), ("a", 706 * s, 11, "REQUEST", "q5", None),
        ("a", 706 * s, 12, "REQUEST", "q6", None), ("b", 5, 0, "ANSWER", "q1", True), ("b", 1, 1, "ANSWER", None, True),
    ]
    wanted = [
        ("a", 1006 * s, "q5", "EXPIRED", False), ("a", 1006 * s, "q6", "EXPIRED", False), ("a", 299 * s, "q1", "CONFIRMED", True), ("a", 300 * s, "q1", "UNKNOWN", False), ("a", 700 * s, "q2", "EXPIRED", False), ("a", 700 * s, "q2", "UNKNOWN", False),
        ("a", 703 * s, "q3", "STALE", False), ("a", 705 * s, "q4", "DENIED", False), ("b", 5, "q1", "UNKNOWN", False),
    ]
    assert values(timers.confirmation_outcomes(store.createDataFrame(rows, timers.ASKED_IN))) == sorted(wanted, key=str)
    rng = random.Random(2)
    for session in range(15):
        at = rng.randrange(60_000)
        for seq in range(20):
            rows.append((f"s{session}", at, seq, rng.choice(["RUN", "REQUEST", "REQUEST", "ANSWER", "ANSWER"]), f"q{rng.randrange(4)}", rng.choice([True, False, None])))
            at += rng.choice([0, 1, 50_000, 200_000])
    last = max(r[1] for r in rows)
    end = [("z", last + 700_000, 0, "RUN", None, None), ("y", last + 720_000, 0, "RUN", None, None)]
    got = streamed(store, tmp_path, [*dealt(rng, rows, 4, 8_000), end[:1], end[1:]], timers.ASKED_IN, lambda s: timers.confirmations(s, "10 seconds"))
    assert values(got) == values(timers.confirmation_outcomes(store.createDataFrame(rows, timers.ASKED_IN), F.lit(last + 500_000)).select(*got.columns))


def events(rng, sessions=6, n=30):
    return [(f"s{i}", seq, 1000 + 7 * seq, rng.choice(ledger.EVENTS), rng.choice(ledger.ACTIONS), rng.choice([None, "ab" * 32])) for i in range(sessions) for seq in range(rng.randrange(1, n))]


def test_ledger_continues(store, tmp_path):
    rng = random.Random(3)
    rows = events(rng)
    unsafe = [("s0", 900, 1, "EXECUTED", "CLICK", "A" * 64), ("s0", 901, 1, "TASK", "CLICK", None), ("s0", 902, 1, "DENIED", None, None), (None, 1, 1, "DENIED", "NONE", None), ("s0", 903, 1, "DENIED", "NONE", "ab" * 32 + "\n")]
    thirds = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 5), (5, 17), (17, 99))]
    got = streamed(store, tmp_path, [thirds[0] + unsafe, thirds[1], thirds[1] + thirds[0], thirds[2]], timers.LEDGER_IN, timers.ledger_blocks)
    once = ledger.append(store.createDataFrame(rows, timers.LEDGER_IN), checked=True)
    assert values(got) == values(once.select(*got.columns))
    assert all(r["valid"] for r in ledger.inspect(got).collect())
    first = ledger.append(store.createDataFrame(thirds[0], timers.LEDGER_IN))
    rest = ledger.append(store.createDataFrame(thirds[0] + thirds[1] + thirds[2], timers.LEDGER_IN), ledger.ledger_heads(first.join(store.createDataFrame(thirds[0], timers.LEDGER_IN).select("session", "seq", F.col("seq").alias("index")), ["session", "index"]), "seq"))
    assert values(first.union(rest).select(*got.columns)) == values(got)
    with pytest.raises(Exception, match="UNSAFE_LEDGER_METADATA"):
        ledger.append(store.createDataFrame(unsafe, timers.LEDGER_IN), checked=True).collect()


def test_distinct_requests_and_windows(spark, tmp_path):
    schema = "id long, at timestamp, kind string"
    import datetime as dt

    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    parts = [[(1, t(0), "a"), (1, t(1), "a"), (2, t(2), "b")], [(1, t(3), "a"), (3, t(40), "b")], [(4, t(59), "a")]]
    got = streamed(spark, tmp_path / "d", parts, schema, lambda s: streaming.distinct_requests(s, ["id"], "at", "30 minutes"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4]
    got = streamed(spark, tmp_path / "w", [*parts, [(5, dt.datetime(2026, 1, 1, 5), "z")], [(6, dt.datetime(2026, 1, 1, 6), "z")]], schema, lambda s: streaming.windowed_counts(s, "at", ["kind"], "30 minutes", "30 minutes"))
    assert values(got.filter("kind <> 'z'").selectExpr("minute(begins)", "kind", "n")) == [(0, "a", 3), (0, "b", 1), (30, "a", 1), (30, "b", 1)]
