"""Costly work on the rows of a small file is dealt over tasks; percentiles leave values where they are; images and groups travel in lots."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import detect, evaluate, tasks
from sluice.plans import controls, planted


@pytest.mark.parametrize("n", [1001, 2006, 9999, 10_001, 12_345])
def test_percentiles_of_groups_of_any_size(spark, n):
    values = np.random.default_rng(n).permutation(n) * 1.5
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    row = evaluate.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()[0]
    assert list(row[2:]) == pytest.approx(np.quantile(values, [0.5, 0.95, 0.99]), abs=1e-6)


def test_percentiles_broadcast_their_brackets(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount")
    plan = evaluate.stage_medians(lines, ["l_returnflag"], ["l_quantity", "l_discount"])._jdf.queryExecution().executedPlan().toString()
    near = plan[plan.index("BroadcastHashJoin [k0_"):] if "BroadcastHashJoin [k0_" in plan else ""
    assert "Expand" in near or "Generate" in near, plan


def test_rows_of_small_files_are_dealt_over_tasks(spark, sf_dir):
    assert controls.controls(spark, sf_dir).rdd.getNumPartitions() == 8
    assert planted._planted(spark, sf_dir).rdd.getNumPartitions() == 8


def test_segments_and_spans_of_texts_with_the_mark(spark):
    texts = ["", "a\x01b <EMAIL>", "<EMAIL>x\x01", "<EMAIL><PHONE>", "no\x01ne", "x LOCAL_PHONE_1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = [[s["part"] for s in r[0]] for r in df.select(tasks.segments(F.col("t"))).collect()]
    assert ["".join(p) for p in parts] == texts and parts[1] == ["a\x01b ", "<EMAIL>"] and parts[3] == ["<EMAIL>", "<PHONE>"]
    spans = [[(s["value"], s["start"]) for s in r[0]] for r in df.select(detect.spans_of(F.col("t"), "<[A-Z]+>")).collect()]
    assert spans == [[], [("<EMAIL>", 4)], [("<EMAIL>", 0)], [("<EMAIL>", 0), ("<PHONE>", 7)], [], []]


def test_cards_beside_other_digits(spark):
    texts = ["4451718024887799 27.65.93.188", "38.253.197.126 4880761348116108", "at 4451718024887799.", "4451718024887798 at"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [[s["value"].strip() for s in r[0]] for r in df.select(detect.detect(F.col("t"), ("PAYMENT_CARD",))).collect()]
    assert found == [["4451718024887799"], ["4880761348116108"], ["4451718024887799"], []]


def test_detections_are_folded_in_lots_without_pandas_calls(spark):
    from sluice.operators import spatial

    box = "image_id long, det_id string, type string, confidence double, x int, y int, width int, height int"
    rows = [(i, f"d{j}", "FACE" if j < 2 else "CARD", 0.9 - j / 10, 5 * j, 0, 40, 20) for i in range(50) for j in range(3)] + [(None, "a", None, None, 0, 0, 4, 4), (None, "b", None, 0.5, None, 0, 4, 4)]
    df = spark.createDataFrame(rows, box)
    for got, n in ((spatial.suppress(df), 2), (spatial.merge_detections(df, "image_id"), 2)):
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
        counts = {r["image_id"]: r["count"] for r in got.groupBy("image_id").count().collect()}
        assert counts == {i: n for i in range(50)} | {None: 2}
    merged = spatial.merge_detections(df, "image_id").filter("image_id = 3 and type = 'FACE'").collect()
    assert [(r["x"], r["width"], r["evidence_id"]) for r in merged] == [(0, 45, "visual_0")]


def test_small_images_leave_a_task_in_lots(spark):
    import pyarrow as pa

    from sluice.sources import png

    image = png.encode(np.zeros((2, 2, 4), np.uint8))
    batch = pa.RecordBatch.from_pydict({"id": list(range(100)), "content": [image] * 99 + [b"x"]})
    seen = png.lots(batch, "content", ["id"], png.MOST_PIXELS)
    out = list(seen)
    assert len(out) == 1 and out[0].num_rows == 100 and out[0].column("error").null_count == 99


def test_obvious_secrets_pass_their_hints(spark):
    from sluice.functions.patterns import OBVIOUS_SECRETS, SECRET_HINTS
    from sluice.operators import guard

    texts = ["mail a.b@c.example", "tax ABCDE1234F", "pay x1@bank", "+91 98765-43210", "4111 1111 - 1111 1111", "4111111111111", "PassWord : x", "otp=1", "plain 1234 text", "a @ b", "ABCDE12345", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.lit(False)
    for p in OBVIOUS_SECRETS:
        plain = plain | F.col("t").rlike(p)
    rows = df.select(guard.has_obvious_secret(F.col("t")), F.coalesce(plain, F.lit(False))).collect()
    assert len(SECRET_HINTS) == len(OBVIOUS_SECRETS) and [r[0] for r in rows] == [r[1] for r in rows] and sum(r[0] for r in rows) == 8
    column = str(guard.has_obvious_secret(F.col("t")))
    assert column.lower().count("contains") == 2  # patterns are tried where their hint is found


def test_cheap_tests_pass_what_patterns_match(spark):
    from sluice.functions.patterns import DETECTORS
    from sluice.plans import corpus

    texts = ["PAſſWORD: hidden1", "pın = 7777", "patİent: Ann Lee", "HıSTORY", "Patient hıſtory: mild cough", "PassKode", "reſİdıng at: 5 Mill Lane, Town", "OTP 1234", "u@x.example", "DEMO0123456"]
    df = spark.createDataFrame([(t,) for t in texts + [r[1] for r in corpus.rows()]], "t string")
    for d in DETECTORS:
        spans = F.filter(detect.spans_of(F.col("t"), d.pattern, d.group), lambda x: F.length(x["value"]) > 0)
        want = F.size(F.filter(spans, lambda x: detect.VALIDATORS[d.validator](x["value"])) if d.validator else spans)  # noqa: B023
        got = F.size(detect._let(detect._tested(F.col("t"), [d]), lambda t: detect._candidates(t, d)))  # noqa: B023
        assert df.filter(got != want).count() == 0, d.type
