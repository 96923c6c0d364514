"""The session log: commits, stale writers, lookups that open few files."""

from __future__ import annotations

import pytest

from sluice.operators import sessionlog, sessions


def start(i, seq=0):
    return (f"s{i}", seq, "START", f"snap{i}", f"a{i}", "ACT", None)


def test_commits_and_lookups(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert sessionlog.version(spark, path) == 0 and sessionlog.events(spark, path).count() == 0 and sessionlog.lookup(spark, path, "s1").count() == 0
    one = spark.createDataFrame([start(i) for i in range(300)] + [(None, 0, "START", None, None, "ACT", None)], sessionlog.SCHEMA)
    assert sessionlog.commit(one, path, 0) == 1
    two = spark.createDataFrame([(f"s{i}", 1, "VERIFY", None, f"a{i}", None, True) for i in range(0, 300, 2)], sessionlog.SCHEMA)
    assert sessionlog.commit(two, path, 1) == 2
    assert sessionlog.events(spark, path).count() == 451 and sessionlog.events(spark, path, as_of=1).count() == 301
    assert [tuple(r) for r in sessionlog.lookup(spark, path, "s4").collect()] == [("s4", "OBSERVE", None)]
    assert [tuple(r) for r in sessionlog.lookup(spark, path, "s5").collect()] == [("s5", "EXECUTE", "a5")]
    whole = {tuple(r) for r in sessions.outcomes(sessionlog.events(spark, path)).filter("session_id = 's4'").collect()}
    assert whole == {tuple(r) for r in sessions.outcomes(sessionlog.session_events(spark, path, "s4")).collect()}
    # A lookup opens the files of one bucket of each commit.
    files, all_ = len(sessionlog.session_events(spark, path, "s4").inputFiles()), len(sessionlog.events(spark, path).inputFiles())
    assert files <= 8 and all_ >= 64


def test_one_of_two_writers_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    df = lambda i: spark.createDataFrame([start(i)], sessionlog.SCHEMA)
    base = sessionlog.version(spark, path)
    assert sessionlog.commit(df(1), path, base) == 1
    with pytest.raises(sessionlog.StaleVersion):
        sessionlog.commit(df(2), path, base)
    assert [r["session_id"] for r in sessionlog.events(spark, path).collect()] == ["s1"]
    assert len(list((tmp_path / "log" / "data").iterdir())) == 1  # the refused writer's files are gone
    assert sessionlog.commit(df(2), path, sessionlog.version(spark, path)) == 2
    # A commit whose writer died before it named its folder holds nothing, and the log goes on after it.
    (tmp_path / "log" / "commits" / f"{3:012}").touch()
    with pytest.raises(sessionlog.StaleVersion):
        sessionlog.commit(df(3), path, 2)
    assert sessionlog.commit(df(3), path, 3) == 4 and sessionlog.events(spark, path).count() == 3


def test_sessions_are_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    first, refused = sessionlog.create(spark.createDataFrame([start(1), start(2), start(2, 5), ("s9", 0, "STEP", None, None, None, None)], sessionlog.SCHEMA), path, 0)
    assert first == 1 and [(r["session_id"], r["seq"]) for r in refused.collect()] == [("s2", 5)]
    second, refused = sessionlog.create(spark.createDataFrame([start(2, 7), start(3)], sessionlog.SCHEMA), path, 1)
    assert second == 2 and [(r["session_id"], r["seq"]) for r in refused.collect()] == [("s2", 7)]
    assert sorted(r["session_id"] for r in sessionlog.events(spark, path).collect()) == ["s1", "s2", "s3"]
    with pytest.raises(sessionlog.StaleVersion):
        sessionlog.create(spark.createDataFrame([start(4)], sessionlog.SCHEMA), path, 1)
