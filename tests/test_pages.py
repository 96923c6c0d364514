"""Page scans against known trees: implied end tags, private text, labels, options, visibility, time."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sluice.sources import in_viewport, page_elements, page_regions, private_values
from sluice.sources.pages import Page, Scan


def shape(html: str) -> str:
    """The tree as tag(kids), text left out."""
    page = Page(html, "x")

    def told(node):
        kids = "".join(told(k) for k in node.kids if not isinstance(k, str))
        return node.tag + (f"({kids})" if kids else "") + " "

    return "".join(told(k) for k in page.root.kids if not isinstance(k, str)).replace(" )", ")").strip()


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "ul(li li(ul(li)) li)"),
        ("<p>one<p>two<div>d</div>", "p p div"),
        ("<p>a<b>b<p>c", "p(b) p"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "dl(dt dd dt dd)"),
        ("<table><tr><td>1<td>2<tr><th>3</table>x", "table(tr(td td) tr(th))"),
        ("<table><thead><tr><th>h<tbody><tr><td><table><tr><td>in</table>out</table>", "table(thead(tr(th)) tbody(tr(td(table(tr(td))))))"),
        ("<select><option>A<option>B<optgroup><option>C</select><p>x", "select(option option optgroup(option)) p"),
        ("<div><p>x</div><p>y", "div(p) p"),
        ("<h1>a<h2>b</h2>", "h1 h2"),
        ("<a href=1>x<a href=2>y</a>", "a a"),
        ("<button>x<button>y", "button button"),
        ("<td>x</div>y</td>", "td"),
        ("<div><b><p>x</b>y</p></div><i>z</i>", "div(b(p)) i"),
        ("<textarea><b>x</b></textarea><br/><p>y", "textarea br p"),
        ("</p></x><img><img/>", "img img"),
    ],
)
def test_implied_end_tags(html, tree):
    assert shape(html) == tree


def scan(html):
    return [dict(zip(("tag", "role", "type", "text", "aria", "labelled", "own", "near", "beside", "title", "placeholder", "value", "enabled", "visible", "selected", "options", "chosen", "control_value"), r, strict=False)) for r in Scan(html, "data-m", "data-ignore", "data-s").rows()]


def test_texts_of_unclosed_elements():
    assert [r["text"] for r in scan("<ul><li>one<li>two<li>three</ul><p>a<br>b<p>c")] == ["one", "two", "three", "a b", "c"]
    assert [r["text"] for r in scan("<li><div>x</div><div>y</div>z<b>w</b><script>no</script><style>no</style>")] == ["x y zw"]


SECRET = "4111 1111 1111 1111"
FORM = f"""<p>Notes <textarea id=t name=n>
my card {SECRET}</textarea></p><li>Pick <select id=s><option value=v1>One<option selected value="{SECRET}">Two</select></li>
<td>Edit <div contenteditable=true role=textbox aria-label=Body>secret <p>{SECRET}</p></div></td><label>Field <textarea>{SECRET}</textarea></label><input value="{SECRET}"><input type=checkbox value=x checked>"""


def test_private_text_stays_private(spark):
    pages = spark.createDataFrame([(1, FORM, "x")], "page_id long, html string, id string")
    public = page_elements(pages).collect()
    assert SECRET not in str(public) and "secret" not in str(public)
    by = {r["tag"]: r for r in public}
    assert by["select"]["options"] == ["One", "Two"] and by["select"]["selected_option"] == "Two" and by["select"]["text"] is None
    assert [r["text"] for r in public if r["tag"] == "p"] == ["Notes", None] and by["li"]["text"] == "Pick" and by["td"]["text"] == "Edit" and by["label"]["text"] == "Field"
    assert {(r["tag"], r["label"], r["value_present"]) for r in public if r["tag"] in ("textarea", "div")} == {("textarea", None, True), ("textarea", "Field", True), ("div", "Body", True)}
    private = [(r["input_type"], r["value"]) for r in private_values(pages).orderBy("element_id").collect()]
    assert sorted(private) == sorted([("text", f"my card {SECRET}"), ("select", SECRET), ("text", f"secret \n{SECRET}"), ("text", SECRET), ("text", SECRET), ("text", SECRET)])


def test_options_and_choices():
    rows = scan("<select><option disabled>A<option>B</select><select multiple><option>A</select><select><option selected>A<option selected>B</select><select size=3><option>A</select><input type=checkbox value=on><input type=radio value=r checked><input type=odd>")
    assert [(r["options"], r["chosen"]) for r in rows[:4]] == [(["A", "B"], "B"), (["A"], None), (["A", "B"], "B"), (["A"], None)]
    assert [(r["type"], r["control_value"], r["selected"]) for r in rows[4:]] == [("checkbox", None, False), ("radio", "r", True), ("text", None, None)]


def test_labels():
    rows = scan("<label for=a>For</label><input id=a><label>First <input id=b><input id=c></label><label for=d></label><input id=d title=T><input id=a>")
    fields = [r for r in rows if r["tag"] == "input"]
    assert [r["own"] for r in fields] == ["For", "First", None, "", None]
    near = scan("<div><label>L1</label><div><input></div></div><div><label>A</label><label>B</label><input></div>")
    assert [r["near"] for r in near if r["tag"] == "input"] == ["L1", None]


def test_visibility():
    html = """<div hidden><button>1</button></div><div style="display: none"><button>2</button></div><div style="visibility:hidden"><button>3</button><button style="visibility: visible">4</button></div>
      <button style="color:red; opacity: 0">5</button><div style="opacity:0"><button>6</button></div><details><summary>7</summary><button>8</button><summary>9</summary></details><details open><button>10</button></details>
      <input type=checkbox id=k style="opacity:0"><label for=k>11</label><input type=hidden><div disabled role=x>12</div><button style="display:none !important">13</button>"""
    seen = {r["text"] or r["own"]: r["visible"] for r in scan(html)}
    assert seen == {"1": False, "2": False, "3": False, "4": True, "5": False, "6": True, "7": True, "8": False, "9": False, "10": True, "11": True, None: False, "12": True, "13": False}
    assert all(r["enabled"] for r in scan(html))


def test_injected_interfaces_and_hints(spark):
    assert [r["text"] for r in scan("<body class=weava><p>a<div class='x web-highlighter'><button>b</button></div><div data-ignore><p>c</div>")] == ["a"]
    deep = "<div id=weava>" + "<div>" * 14 + "<button>in</button>" + "<div>" * 2 + "<button>out</button>"
    assert [r["text"] for r in scan(deep)] == ["out"]
    rows = page_regions(spark.createDataFrame([(1, "<img data-sensitive=face><img><canvas hidden></canvas>")], "page_id long, html string")).orderBy("region_no").collect()
    assert [(r["hint"], r["region_no"]) for r in rows] == [("FACE", 1), (None, 2)]


def test_viewport(spark):
    boxes = [(0.0, 0.0, 10.0, 10.0), (-10.0, 0.0, 10.0, 10.0), (-9.0, -9.0, 10.0, 10.0), (100.0, 0.0, 5.0, 5.0), (99.0, 49.0, 5.0, 5.0), (0.0, 50.0, 5.0, 5.0), (5.0, 5.0, 0.0, 5.0)]
    df = spark.createDataFrame([((*b,),) for b in boxes] + [(None,)], "b struct<x:double,y:double,width:double,height:double>")
    assert [r[0] for r in df.select(in_viewport(F.col("b"), F.lit(100), F.lit(50))).collect()] == [True, False, True, False, True, False, False, False]


@pytest.mark.parametrize(
    "piece",
    ["<li>x", "<p>x", "<b>", "<div>", "<td>x", "<label>x", "<input type=checkbox> x ", "<option>x", "<b><li>", "</i>", "<label><input>", "<div><label for=q>x</label>", "<span contenteditable=true>t", "\n <i></i>"],
)
def test_time_grows_with_the_page(piece):
    took = []
    for n in (2_000, 16_000):
        begin = time.process_time()
        list(Scan(piece * n, "m", "i", "s").rows())
        took.append(time.process_time() - begin)
    assert took[1] < 24 * max(took[0], 0.02), took


def test_many_unclosed_items():
    begin = time.process_time()
    assert len(list(Scan("<li>x" * 50_000, "m", "i", "s").rows())) == 2000
    assert time.process_time() - begin < 5
