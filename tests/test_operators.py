"""Detectors, policy, guards, ranking, boxes, ledger, sessions and sources on small inputs with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.functions.validators import VALIDATORS
from sluice.operators import detect, elements, evaluate, evidence, guard, ledger, policy, rank, runs, sessions, spatial, tasks
from sluice.plans import corpus
from sluice.sources import image_bytes, page_elements, process_tree, processes

c = F.col


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def spans(spark, text, types=None):
    return [(s["type"], s["value"], s["start"], s["stop"]) for s in one(spark, text).select(detect.detect(c("v"), types)).first()[0]]


@pytest.mark.parametrize(
    "name,value,ok",
    [
        ("gstin", "27AAPFU0939F1ZV", True), ("gstin", "27AAPFU0939F1ZA", False), ("verhoeff", "9999 4105 7058", True), ("verhoeff", "9999 4105 7059", False),
        ("luhn", "4111 1111 1111 1111", True), ("luhn", "4111 1111 1111 1112", False), ("luhn", "0000000000000000", False), ("gstin", "", False), ("verhoeff", "12", False),
    ],
)
def test_validators(spark, name, value, ok):
    assert one(spark, value).select(VALIDATORS[name](c("v"))).first()[0] is ok


def test_cases_are_all_found(spark):
    cases = corpus.cases(spark)
    assert cases.count() == 315
    found = cases.withColumn("predicted", F.transform(detect.detect(c("text")), lambda s: s["type"]))
    wrong = found.filter(F.array_sort("predicted") != F.array_sort("expected")).collect()
    assert not wrong
    by = {r["type"]: r for r in evaluate.set_confusion(found).collect()}
    assert set(by) == set(corpus.POSITIVES) and all(r["precision"] == r["recall"] == r["f1"] == 1 for r in by.values())


def test_overlaps_and_offsets(spark):
    assert spans(spark, "id 27AAPFU0939F1ZV.") == [("GSTIN", "27AAPFU0939F1ZV", 3, 18)]  # the tax id inside it loses
    assert spans(spark, "😀 mail a@b.example, éabc@x.com") == [("EMAIL", "a@b.example", 7, 18), ("EMAIL", "abc@x.com", 21, 30)]
    assert spans(spark, None) == spans(spark, "") == []
    found = one(spark, "1111 x 11112 1111").select(detect.spans_of(c("v"), r"(?<!\d)\d{4}(?!\d)")).first()[0]
    assert [(s["start"], s["stop"]) for s in found] == [(0, 4), (13, 17)]


def test_redaction_and_evidence(spark):
    df = spark.createDataFrame([(1, "from A@b.example to a@B.example", "en"), (2, None, "en"), (3, "card 4111 1111 1111 1111", "fr")], "doc_id long, text string, lang string")
    clean = {r[0]: r[1] for r in df.select("doc_id", policy.redact(c("text"), detect.detect(c("text")))).collect()}
    assert clean == {1: "from <EMAIL> to <EMAIL>", 2: None, 3: "card <PAYMENT_CARD>"}
    found = policy.decide(detect.entities(df, "text", ["doc_id", "lang"]))
    assert {(r["type"], r["decision"], r["replacement"]) for r in found.collect()} == {("EMAIL", "ABSTRACT", "<EMAIL>"), ("PAYMENT_CARD", "DROP", "<PAYMENT_CARD>")}
    by = {r["type"]: (r["detector_hits"], r["unique_items"], r["review_items"]) for r in evidence.summarise(found, ["lang"]).collect()}
    assert by == {"EMAIL": (2, 1, 0), "PAYMENT_CARD": (1, 1, 0)}
    put_back = policy.redact_entities(df.select("doc_id", "text"), found, ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in put_back.collect()} == clean


def test_handles_and_tasks(spark):
    values = spark.createDataFrame([("s", "EMAIL", "a", 2), ("s", "EMAIL", "b", 1), ("s", "EMAIL", "a", 3), ("s", "PHONE", "a", 4)], "scope string, kind string, value string, n int")
    got = {(r["kind"], r["value"]): r["handle"] for r in policy.handles(values, "scope", ["n"]).collect()}
    assert got == {("EMAIL", "b"): "LOCAL_EMAIL_1", ("EMAIL", "a"): "LOCAL_EMAIL_2", ("PHONE", "a"): "LOCAL_PHONE_1"}
    asked = spark.createDataFrame([(1, "Fill first name is Asha and email is asha@mail.example, then click submit"), (2, "Open the page")], "task_id int, task string")
    done, vault = tasks.localise(asked)
    text = {r["task_id"]: r["task"] for r in done.collect()}
    assert text[2] == "Open the page" and "Asha" not in text[1] and "asha@" not in text[1] and "LOCAL_GIVEN_NAME_1" in text[1] and "LOCAL_EMAIL_1" in text[1]
    assert {r["value"] for r in vault.collect()} == {"Asha", "asha@mail.example"}
    both = spark.createDataFrame([("Pick the cheapest one", "Pick the <OTHER> one"), ("Pick the cheapest", "The CHEAPEST")], "a string, b string")
    assert [r[0] for r in both.select(tasks.comparison_lost(c("a"), c("b"))).collect()] == [True, False]


def test_contextual_scanner(spark):
    df = spark.createDataFrame([("Meet Asha near <EMAIL> or LOCAL_EMAIL_1",), (None,), ("",)], "t string")
    got = [r["protected"] for r in tasks.protect(df, "t", tasks.gazetteer({"GIVEN_NAME": ["Asha"]})).collect()]
    assert got[0]["text"] == "Meet [GIVEN_NAME_1] near <EMAIL> or LOCAL_EMAIL_1" and got[0]["found"][0]["value"] == "Asha" and got[1]["text"] is None
    parts = df.select(tasks.segments(c("t")).alias("s")).first()["s"]
    assert "".join(p["part"] for p in parts) == "Meet Asha near <EMAIL> or LOCAL_EMAIL_1" and [p["is_marker"] for p in parts] == [False, True, False, True]


def test_guards(spark):
    texts = ["mail a@b.example", "otp: 1234", "4111 1111 1111 1112", "nothing here", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(guard.payload_status(c("t"), c("t"))).collect()] == [422, 422, 422, 200, 200]
    urls = ["https://x.example/a", "http://x.example", "http://127.0.0.1:8000/", "http://localhost/", "not a url", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(guard.endpoint_allowed(c("u"))).collect()] == [True, False, True, True, False, False]
    keys = one(spark, '{"task":"say \\"token\\": now","Cookie":1,"a":{"password":"x"},"privacy_summary":{"OTP":2}}').select(guard.forbidden_properties(c("v"))).first()[0]
    assert sorted(k.lower() for k in keys) == ["cookie", "password"]
    both = spark.createDataFrame([("do not click submit", "Submit form"), ("click submit", "Submit form"), ("never press the Save", "Save")], "t string, n string")
    assert [r[0] for r in both.select(guard.button_prohibited(c("t"), c("n"))).collect()] == [True, False, True]
    leaks = guard.leaks(spark.createDataFrame([(1, "has hunter2 in"), (2, "clean")], "payload_id int, payload string"), spark.createDataFrame([("hunter2",), ("",)], "secret string"))
    assert [r["payload_id"] for r in leaks.collect()] == [1]


ELEMENT = "snapshot_id string, id string, role string, tag string, text string, label string, input_type string, value_handle string, enabled boolean, visible boolean, selected boolean, value_present boolean, options array<string>, selected_option string, control_value string, dom_index int, bbox struct<x:double,y:double,width:double,height:double>, sources array<string>"


def element(i, role="button", text=None, label=None, sources=("DOM",), box=(0.0, 0.0, 10.0, 10.0), **more):
    row = dict(snapshot_id="snap_1", id=f"el_{i}", role=role, tag=None, text=text, label=label, input_type=None, value_handle=None, enabled=True, visible=True, selected=None, value_present=False, options=None, selected_option=None, control_value=None, dom_index=i, bbox=box, sources=list(sources))
    return tuple((row | more).values())


def test_budget_skips_and_goes_on(spark):
    rows = [element(i, text=f"Button {i}") for i in range(100)] + [element(100 + i, "visual_text", f"reading {i}", sources=["OCR"]) for i in range(20)]
    frame = elements.compact(spark.createDataFrame(rows, ELEMENT))
    asked = spark.createDataFrame([("snap_1", "press button 7")], "snapshot_id string, task string")
    got = rank.budgeted(frame, asked)
    listed = got.collect()
    assert len(listed) == 80 and sum(r["role"] == "visual_text" for r in listed) == 12 and sum(len(r["compact"]) for r in listed) <= 20_000
    sizes = frame.withColumn("compact", F.when(c("dom_index") == 3, F.repeat(F.lit("x"), 90)).otherwise("y" * 20))
    few = {r["dom_index"] for r in rank.budgeted(sizes.filter("role = 'button' and dom_index < 6"), asked, 100).collect()}
    assert 3 not in few and len(few) == 5


def test_ordinals(spark):
    rows = [element(i, "checkbox", f"Box {i}", selected=False) for i in range(4)]
    asked = spark.createDataFrame([("snap_1", "check the second checkbox and uncheck the 3rd checkbox")], "snapshot_id string, task string")
    got = {(r["request_no"], r["id"], r["desired"]) for r in rank.ordinal_targets(spark.createDataFrame(rows, ELEMENT), asked).collect()}
    assert got == {(0, "el_1", True), (1, "el_2", False)}


def test_fusion(spark):
    dom = spark.createDataFrame([element(0, text="Pay now"), element(1, "img", "", box=(300.0, 300.0, 50.0, 50.0))], ELEMENT)
    px = [element(10, "visual_text", "pay", sources=["OCR"], box=(2.0, 2.0, 5.0, 5.0)), element(11, "visual", "", sources=["VISION"], box=(301.0, 301.0, 40.0, 40.0)), element(12, "visual_text", "far", sources=["OCR"], box=(900.0, 2.0, 5.0, 5.0))]
    got = {r["id"]: r["sources"] for r in spatial.fuse(dom, spark.createDataFrame(px, ELEMENT)).collect()}
    assert got == {"el_0": ["DOM", "OCR"], "el_1": ["DOM", "VISION"], "el_12": ["OCR"]}


def test_detections(spark):
    rows = [("i", "a", "FACE", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", "b", "FACE", 0.8, 1.0, 1.0, 10.0, 10.0), ("i", "c", "CARD", 0.7, 1.0, 1.0, 10.0, 10.0), ("i", "d", "FACE", 0.6, 50.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "image_id string, det_id string, type string, confidence double, x double, y double, width double, height double")
    assert sorted(r["det_id"] for r in spatial.suppress(df).collect()) == ["a", "c", "d"]
    merged = {r["det_id"]: (r["width"], r["evidence_id"]) for r in spatial.merge_detections(df, "image_id").collect()}
    assert merged["a"] == (11.0, "visual_0") and set(merged) == {"a", "c", "d"}


def test_raster_mask(spark):
    images = spark.createDataFrame([("i", 4, 4, bytearray([127] * 64))], "image_id string, width int, height int, rgba binary")
    boxes = spark.createDataFrame([("i", 1.0, 1.0, 2.0, 2.0)], "image_id string, x double, y double, width double, height double")
    r = spatial.masked(images, boxes).first()
    black = [i for i in range(16) if bytes(r["rgba"][4 * i : 4 * i + 4]) == b"\0\0\0\xff"]
    assert r["verified"] and black == [5, 6, 9, 10]


def test_text_boxes_and_ctc(spark):
    grid = [0.0] * 100
    for y in range(2, 5):
        for x in range(2, 6):
            grid[y * 10 + x] = 0.9
    maps = spark.createDataFrame([("i", 10, 10, grid)], "image_id string, width int, height int, values array<double>")
    assert [tuple(r)[1:] for r in runs.text_boxes(maps).collect()] == [(1.0, 1.0, 6.0, 5.0)]
    df = spark.createDataFrame([([1, 1, 0, 1, 2], [0.9, 0.8, 0.9, 0.5, 0.7], ["a", "b"])], "b array<int>, s array<double>, l array<string>")
    got = df.select(spatial.ctc_text(c("b"), c("s"), c("l")).alias("t")).first()["t"]
    assert got["text"] == "aab" and abs(got["confidence"] - 0.7) < 1e-9


def test_ledger(spark):
    events = spark.createDataFrame([("s", i, "RUN", f"A{i}", None, i) for i in range(5)] + [("t", 9, "RUN", "X", "com", 0)], "session string, at long, event string, action string, action_commitment string, seq int")
    blocks = ledger.append(events)
    assert all(r["valid"] and r["first_bad"] is None for r in ledger.inspect(blocks).collect())

    def first(df):
        r = ledger.inspect(df).filter("session = 's'").first()
        return r["valid"], r["first_bad"], r["check"]

    assert first(blocks.withColumn("action", F.when(c("index") == 2, "EDIT").otherwise(c("action")))) == (False, 2, "HASH")
    assert first(blocks.filter("index != 1")) == (False, 1, "INDEX")
    edited = ledger.rehash(blocks.withColumn("action", F.when(c("index") == 2, "EDIT").otherwise(c("action"))))
    assert first(edited) == (True, None, None)
    heads = lambda df: {r["session"]: r["h"] for r in df.groupBy("session").agg(F.max_by("hash", "index").alias("h")).collect()}
    assert heads(edited)["s"] != heads(blocks)["s"] and heads(edited)["t"] == heads(blocks)["t"]  # a kept head tells


STEPS = [
    ("a", 0, "STEP", "snap_0", "act_0", "ACT", None), ("a", 1, "START", "snap_1", "act_1", "ACT", None), ("a", 2, "START", "snap_1", "act_1", "ACT", None), ("a", 3, "VERIFY", None, "act_9", None, True),
    ("a", 4, "VERIFY", None, "act_1", None, True), ("a", 5, "VERIFY", None, "act_1", None, True), ("a", 6, "STEP", "snap_1", "act_2", "ACT", None), ("a", 7, "STEP", "snap_2", "act_2", "FINISH", None),
    ("b", 0, "START", "snap_1", "act_1", "BLOCKED", None), ("c", 0, "START", "snap_1", "act_1", "ACT", None), ("c", 1, "VERIFY", None, "act_1", None, False),
]
SESSION = "session_id string, seq long, kind string, snapshot_id string, action_id string, plan string, success boolean"
WANTED = {("a", i): s for i, s in enumerate([(404, "NONE"), (200, "EXECUTE"), (409, "EXECUTE"), (409, "EXECUTE"), (200, "OBSERVE"), (409, "OBSERVE"), (409, "OBSERVE"), (200, "COMPLETE")])} | {("b", 0): (200, "FAILED"), ("c", 0): (200, "EXECUTE"), ("c", 1): (200, "FAILED")}


def test_sessions(spark):
    got = {(r["session_id"], r["seq"]): (r["status"], r["state"]) for r in sessions.outcomes(spark.createDataFrame(STEPS, SESSION)).collect()}
    assert got == WANTED


def test_sessions_streamed(spark, tmp_path):
    from sluice import streaming

    for part in (STEPS[:4], STEPS[4:]):  # two triggers
        spark.createDataFrame(part, SESSION).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SESSION).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = streaming.session_outcomes(stream).writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out", format="parquet")
    assert query.awaitTermination(90)
    got = {(r["session_id"], r["seq"]): (r["status"], r["state"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert set(got) == set(WANTED)


def test_pages(spark):
    html = "<form><label for='m'>Mail</label><input id='m' type='email' value='x'><select><option>A</option><option>B</option></select><button disabled>Go <b>now</b></button></form>"
    rows = page_elements(spark.createDataFrame([(1, html, 5), (2, None, 5), (3, "", 5)], "page_id long, html string, tag int")).collect()
    by = {r["tag"]: r for r in rows}
    assert by["input"]["label"] == "Mail" and by["input"]["role"] == "textbox" and by["select"]["options"] == ["A", "B"] and by["button"]["text"] == "Go now" and not by["button"]["enabled"]
    assert bytes(one(spark, "data:image/png;base64,QUJD").select(image_bytes(c("v"))).first()[0]) == b"ABC" and one(spark, "data:text/html,x").select(image_bytes(c("v"))).first()[0] is None


def test_process_tree(spark):
    lines = spark.createDataFrame([("1 0 10 0.5 init",), ("2 1 20 1.0 run a",), ("3 2 5 0.1 run b",), ("9 1 1 0 other",), ("PID PPID",)], "value string")
    assert sorted(r["pid"] for r in process_tree(processes(lines), 2).collect()) == [2, 3]


def test_scalars(spark):
    assert one(spark, "abc").select(tx.fnv1a(c("v"))).first()[0] == "1a47e90b"
    assert one(spark, " a  b ").select(tx.normalised(c("v"), 3)).first()[0] == "a b"
    assert one(spark, "₹1,499.50 each").select(tx.price(c("v"))).first()[0] == 1499.5
    assert one(spark, "2026-02-30").select(tx.is_iso_date(c("v"))).first()[0] is not True
    p95 = evaluate.percentiles(spark.createDataFrame([(47889.5,), (52741.5,), (61141.699999999255,)], "ms double"), [], "ms", {"p95": 0.95}, 2).first()
    assert p95["p95"] == 60301.68


def test_many_spans_in_one_text(spark):
    """Time grows about with the number of spans: four times as many take far less than the sixteen times of their square."""
    import time

    took = {}
    for n in (100, 4_000, 16_000):
        text = " ".join(f"u{i}@mail{i}.example" for i in range(n))
        frame = one(spark, text)
        begin = time.time()
        found = frame.select(detect.detect(c("v"))).first()[0]
        took[n] = time.time() - begin
        assert len(found) == n and found[-1]["stop"] == len(text) and [s["start"] for s in found] == sorted(s["start"] for s in found)
    assert took[16_000] < 10 * took[4_000], took


def test_resolution_against_brute_force(spark):
    import random

    rng = random.Random(5)
    for n in (0, 1, 5, 40, 700):
        rows = [("T", "v", a := rng.randrange(900), a + rng.randrange(1, 25), 0.5, rng.randrange(6)) for _ in range(n)]
        rows = list({(r[2], r[5]): r for r in rows}.values())  # priority and start tell all apart
        accepted = []
        for r in sorted(rows, key=lambda r: (-r[5], r[2])):
            if not any(r[2] < y[3] and y[2] < r[3] for y in accepted):
                accepted.append(r)
        got = one(spark, [dict(zip(("type", "value", "start", "stop", "confidence", "priority"), r, strict=True)) for r in rows], f"array<{detect.SPAN}>").select(detect.resolve(c("v"))).first()[0]
        assert [tuple(g) for g in got] == sorted(accepted, key=lambda r: r[2])


def test_percentiles_against_numpy(spark):
    """Large and small groups, ties, null keys and values: the sketches only bracket."""
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=30_000).round(6), "b": rng.integers(0, 3, 5000).astype(float), None: rng.exponential(size=2500).round(6), "c": np.array([4.0]), "d": np.arange(7.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("e", None), ("a", None)]
    told = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in evaluate.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", told).collect()}
    assert set(got) == {*groups, "e"} and got["e"]["n"] == 0 and got["e"]["p50"] is None
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        for name, p in told.items():
            assert abs(got[k][name] - np.percentile(vs, 100 * p)) < 2e-6, (k, name)


def test_label_order_and_regions(spark):
    from sluice.sources import page_regions

    html = """<body class="weava"><label for=a>For a</label><input id=a aria-label=" Aria "><input id=a2 aria-labelledby="x y"><b id=x>One</b><i id=y>Two</i>
      <form><label>Wrap <input id=w></label></form><div><div><label>Near</label></div><section><input placeholder=Ph></section></div>
      <p><input type=radio value=r1> beside it<br><input type=checkbox value=on title=T></p><div class="web-highlighter"><button>Gone</button></div>
      <li>outer <p>deep <a href=/z>link <b>bold</b></a></p></li><div tabindex=0>tab</div><div tabindex=-1>no</div><span contenteditable=true>edit</span><a>bare</a>
      <details><summary>Sum</summary><button>in</button></details><img alt=Pic><canvas></canvas><embed type=application/pdf><div data-visual-control>v</div><button aria-disabled=true>off</button></body>"""
    pages = spark.createDataFrame([(None, html), (2, None), (3, "<p>" * 3000)], "page_id long, html string")
    rows = page_elements(pages).collect()
    by = [r for r in rows if r["page_id"] is None]
    labels = {r["label"] for r in by}
    assert {"Aria", "One Two", "Wrap", "Near Ph", "beside it"} <= labels and "Gone" not in {r["text"] for r in by}
    texts = {r["tag"]: r["text"] for r in by if r["text"]}
    assert texts["li"] == "outer deep link bold" and texts["a"] == "link bold" and texts["img"] == "Pic"
    assert {r["text"] for r in by if r["tag"] in ("div", "span")} >= {"tab", None} and not {"no", "edit"} & {r["text"] for r in by}
    assert [r["control_value"] for r in by if r["type"] in ("radio", "checkbox")] == ["r1", None] and [r["selected"] for r in by if r["type"] == "radio"] == [False]
    assert {r["text"]: (r["visible"], r["enabled"]) for r in by if r["tag"] in ("button", "summary")} == {"Sum": (True, True), "in": (False, True), "off": (True, False)}
    assert sum(r["page_id"] == 3 for r in rows) == 2000
    assert [(r["kind"], r["region_no"]) for r in page_regions(pages).orderBy("region_no").collect()] == [("IMAGE", 1), ("CANVAS", 2), ("PDF", 3), ("CONTROL", 4)]


def test_reports_round_trip(spark, tmp_path):
    from sluice import sources

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"name": "x",\n "ms": 3}')
    (tmp_path / "in" / "b.json").write_text('{"ms": 4}')
    read = sources.read_reports(spark, f"file://{tmp_path}/in", "name string, ms long")
    assert sorted((r["name"] or "", r["ms"]) for r in read.collect()) == [("", 4), ("x", 3)]
    sources.write_report(read, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    assert sources.passes(read, c("ms") > 2) and not sources.passes(read, c("name") == "x")
    deep = '{"title":"d"}'
    for _ in range(12):
        deep = '{"title":"d","suites":[' + deep + "]}"
    with pytest.raises(Exception, match="nested too deeply"):
        sources.flat_reports(one(spark, deep), c("v"), 3).collect()
    assert sources.flat_reports(one(spark, None), c("v"), 3).count() == 0
    (tmp_path / "shots").mkdir()
    (tmp_path / "shots" / "s.png").write_bytes(b"abc")
    assert [r["bytes"] for r in sources.screenshots(spark, f"file://{tmp_path}/shots").collect()] == [3]


def test_outbound_reasons(spark):
    rows = [(1, '{"a":"x"}', "x"), (2, '{"Cookie":"x"}', "x"), (3, '{"a":"mail a@b.example"}', "mail a@b.example"), (4, '{"a":"hunter2"}', "x"), (5, "y" * 200, "x"), (6, None, None)]
    df = spark.createDataFrame(rows, "n int, payload string, human string")
    got = guard.outbound(df, "payload", "human", spark.createDataFrame([("hunter2",)], "secret string"), most_bytes=100).collect()
    assert {r["n"]: (r["status"], r["reason"]) for r in got} == {1: (200, None), 2: (422, "FORBIDDEN_KEY"), 3: (422, "SECRET"), 4: (422, "KNOWN_SECRET"), 5: (413, "TOO_LARGE"), 6: (200, None)}


def test_streamed_session_limits(spark, tmp_path):
    from sluice.operators.sessions import streamed

    steps = [("a", 0, "START", "snap_0", "act_0", "ACT", None)]
    for i in range(1, 6):
        steps += [("a", 2 * i - 1, "VERIFY", None, f"act_{i - 1}", None, True), ("a", 2 * i, "STEP", f"snap_{i}", f"act_{i}", "ACT", None)]
    spark.createDataFrame(steps, SESSION).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = streamed(spark.readStream.schema(SESSION).parquet(f"file://{tmp_path}/in"), most_steps=3)
    query = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out", format="parquet")
    assert query.awaitTermination(90)
    assert [(r["status"], r["state"]) for r in spark.read.parquet(f"file://{tmp_path}/out").filter("kind = 'LIMIT'").collect()] == [(429, "FAILED")]


def test_streamed_session_timeout(spark, tmp_path):
    import time

    from sluice.operators.sessions import streamed

    spark.createDataFrame(STEPS[1:2], SESSION).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = streamed(spark.readStream.schema(SESSION).parquet(f"file://{tmp_path}/in"), most_ms=2_000)
    query = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="1 second").start(f"file://{tmp_path}/out", format="parquet")
    try:
        for _ in range(60):
            time.sleep(1)
            rows = spark.read.schema("kind string, status int").parquet(f"file://{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            if any(r["kind"] == "TIMEOUT" and r["status"] == 408 for r in rows):
                break
        else:
            raise AssertionError("no timeout")
    finally:
        query.stop()


def test_leaks_of_like_secrets(spark):
    secrets = [(f"s3cret-{i}-",) for i in range(25)] + [("",), (None,), ("s3cret-3-",), ("cret-3",)]
    payloads = [(i, f"has s3cret-{i}- and more") for i in range(30)] + [(99, None)]
    got = guard.leaks(spark.createDataFrame(payloads, "payload_id int, payload string"), spark.createDataFrame(secrets, "secret string")).collect()
    wanted = {(i, s) for i, p in payloads if p for s, in set(secrets) if s and s in p}
    import hashlib

    assert {(r["payload_id"], r["secret_sha256"]) for r in got} == {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in wanted} and len(got) == len(wanted)


def test_recorded_sessions(spark, tmp_path):
    frame = spark.createDataFrame(STEPS, SESSION)
    sessions.record(frame.filter("seq < 4"), f"file://{tmp_path}/log")
    sessions.record(frame.filter("seq >= 4"), f"file://{tmp_path}/log")
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert [(r["state"], r["pending_action_id"]) for r in sessions.lookup(log, "a").collect()] == [("COMPLETE", None)] and sessions.lookup(log, "zz").count() == 0
    stream = spark.readStream.schema(SESSION).parquet(f"file://{tmp_path}/log")
    assert sessions.recorded(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(90)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(STEPS)


def test_planner_ladder(spark):
    """One snapshot for each rule, in the ladder's order."""
    from sluice.operators import planner

    told = [
        ("finish the order", [element(0, text="Order placed")], "VISIBLY_DONE", None), ("fill", [element(1, "textbox", value_handle="LOCAL_EMAIL_1"), element(0, text="Submit")], "FILL", "el_1"),
        ("choose blue", [element(3, "combobox", options=["Select one", "Red", "Blue"], selected_option="Red")], "CHOOSE", "el_3"), ("take the cheapest", [element(3, "combobox", options=["a Rs. 90", "b Rs. 1,000", "c ₹ 20"])], "CHOOSE", "el_3"),
        ("check the second checkbox", [element(i, "checkbox", selected=False) for i in range(3)], "ORDINAL", "el_1"), ("uncheck newsletter", [element(4, "checkbox", label="Newsletter", selected=True)], "NAMED_STATE", "el_4"),
        ("please continue", [element(2, text="Continue now")], "BUTTON_INTENT", "el_2"), ("click save", [element(5, text="Save"), element(6, text="Other")], "NAMED_BUTTON", "el_5"), ("click save", [element(5, text="Save"), element(6, label="save")], "NO_RULE", None),
        ("choose blue", [element(3, "combobox", options=["Blue"], selected_option="Blue")], "SATISFIED", None), ("do not press continue", [element(2, text="Continue")], "NO_RULE", None), ("nothing", [element(9, "div")], "NO_RULE", None),
    ]
    rows, asked = [], []
    for i, (task, es, *_) in enumerate(told):
        rows += [(f"snap_{i}", *e[1:]) for e in es]
        asked.append((f"snap_{i}", task))
    asked.append(("snap_empty", "continue"))
    frame = spark.createDataFrame(rows, ELEMENT).withColumn("task", F.lit("overridden"))
    got = {r["snapshot_id"]: (r["rule"], r["element_id"], r["option"]) for r in planner.plan(frame, spark.createDataFrame(asked, "snapshot_id string, task string")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {f"snap_{i}": (rule, at) for i, (_, _, rule, at) in enumerate(told)} | {"snap_empty": ("NO_RULE", None)}
    assert got["snap_2"][2] == "Blue" and got["snap_3"][2] == "c ₹ 20"
