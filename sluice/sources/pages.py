"""Elements, regions and private values of HTML pages.

A page is read once into a list of elements in document order, each with its parent, the end of its subtree and its interval of two
text buffers: what may be shown, and all that was typed. Texts, labels and options are slices of a buffer, so a page takes time in proportion to
its size, however deeply its elements nest. End tags that HTML lets authors leave out are implied; elements that cut such a search off are scopes. An end tag
of inline formatting that would cross a block is left out, and blocks are never moved.

What a visitor may have typed (text areas, editable content, options chosen) is in the second buffer alone: it reaches `private_values`, no public column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = (
    "page_id long, id string, tag string, role string, type string, text string, aria string, labelled string, own_label string, near_label string, beside string, title string, placeholder string, value string, "
    "enabled boolean, visible boolean, selected boolean, options array<string>, selected_option string, control_value string, editable boolean, visual boolean, hint string, dom_index int, nth int, region_no int"
)
# The elements of a scan, those that hold a value, those that labels name, elements without an end tag, types of inputs, marks of
# injected interfaces.
_KEPT = frozenset("button input select textarea summary h1 h2 h3 p li td th label img".split())
_FIELDS = frozenset("input select textarea".split())
_LABELABLE = frozenset("button input meter output progress select textarea".split())
_DISABLED = frozenset("button input select textarea option optgroup fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TYPES = frozenset("hidden text search tel url email password date month week time datetime-local number range color checkbox radio file submit image reset button".split())
INJECTED = r"(?i)(?:^|[-_\s])(?:weava|web[-_]?highlighter|chrome[-_]?extension|browser[-_]?extension|third[-_]?party[-_]?extension|extension[-_]?root|extension[-_]?toolbar)(?:$|[-_\s])"
MOST_ELEMENTS, MOST_REGIONS, MOST_OPTIONS = 2000, 200, 500

# HTML's optional tags: what each start tag closes, unless one of the scopes is open further in.
_P_ENDS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt"
_SCOPE = ("applet", "caption", "html", "table", "td", "th", "marquee", "object", "template")
_ENDS: dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]] = {
    "li": [(("li",), (*_SCOPE, "ol", "ul", "menu"))], "dd": [(("dd", "dt"), (*_SCOPE, "dl"))], "option": [(("option",), ("select", "datalist"))], "optgroup": [(("option", "optgroup"), ("select",))],
    "tr": [(("td", "th", "tr", "caption"), ("table", "template"))], "td": [(("td", "th"), ("tr", "table", "template"))], "tbody": [(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table", "template"))],
    "button": [(("button",), _SCOPE)], "a": [(("a",), _SCOPE)],
}
_ENDS |= {"dt": _ENDS["dd"], "th": _ENDS["td"], "thead": _ENDS["tbody"], "tfoot": _ENDS["tbody"], "select": [(("select",), _SCOPE)]}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
for _tag in _P_ENDS.split():
    _ENDS[_tag] = [*_ENDS.get(_tag, []), (("p",), (*_SCOPE, "button"))]
_BLOCK = frozenset(_P_ENDS.split()) | frozenset("td th tr tbody thead tfoot caption option optgroup body html select textarea".split())
_SPECIAL = _BLOCK | frozenset(_SCOPE) | {"button"}
_BREAK = "\x00"  # where a block begins or ends: a space in what is shown, nothing in what is written
_HIDES = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?=;|$)")
_CLEAR = re.compile(r"(?i)(?:^|;)\s*opacity\s*:\s*0*\.?0+%?\s*(?:!important\s*)?(?=;|$)")
_VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*(\w+)")


class Node:
    """One element: its place in the document, and what its ancestors say about it."""

    __slots__ = ("tag", "a", "up", "kids", "at", "place", "end", "shown", "typed", "closed", "gone", "unseen", "clear", "editable", "injected", "control", "labels", "summary")

    def __init__(self, tag: str, attrs: dict, up: Node | None, at: int, place: int) -> None:
        self.tag, self.a, self.up, self.at, self.place = tag, attrs, up, at, place
        self.kids: list = []
        self.end = at + 1
        self.shown = self.typed = (0, 0)
        self.control: Node | None = None  # of a label
        self.labels: list[Node] = []
        self.summary: Node | None = None  # of details


class Page(HTMLParser):
    """The elements of a page (`nodes`) and its two text buffers (`shown`, `typed`)."""

    def __init__(self, html: str, ignore: str) -> None:
        super().__init__(convert_charrefs=True)
        self.ignore, self.injected = ignore, re.compile(INJECTED)
        self.root = Node("", {}, None, -1, 0)
        for k in ("closed", "gone", "unseen", "editable"):
            setattr(self.root, k, False)
        self.root.injected = 1 << 30
        self.nodes: list[Node] = []
        self.stack: list[Node] = [self.root]
        self.open: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
        self.special: list[int] = []
        self.free_labels: list[Node] = []  # open labels without `for` that have no control yet
        self.shown: list[str] = []
        self.typed: list[str] = []
        self.by_id: dict[str, Node] = {}
        self.label_at: list[int] = []
        self.private = 0  # open elements whose text is the visitor's
        self.raw: str | None = None  # the open element that holds text alone
        self.feed(html)
        self.close()
        self._pop(1)
        for at in self.label_at:
            node = self.nodes[at]
            target = self.by_id.get(node.a["for"]) if "for" in node.a else node.control
            if target is not None and target.tag in _LABELABLE and target.a.get("type", "").lower() != "hidden":
                target.labels.append(node)

    def _say(self, text: str) -> None:
        if self.stack[-1].tag in ("script", "style"):
            return
        if not self.private:
            blank = not text.strip(" \t\n\r\f\x00")
            if not (blank and self.shown and (self.shown[-1] == " " or self.shown[-1] == text == _BREAK)):  # no runs of blanks
                self.shown.append(" " if blank and text != _BREAK else text)
        if not (text == _BREAK and self.typed and self.typed[-1] == _BREAK):
            self.typed.append(text)

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _pop(self, to: int) -> None:
        """Close the elements of the stack from a place on."""
        while len(self.stack) > to:
            node = self.stack.pop()
            self.open[node.tag].pop()
            if node.tag in _SPECIAL:
                self.special.pop()
            if node.tag in _BLOCK:
                self._say(_BREAK)
            self.private -= self._private(node)
            node.end, node.shown, node.typed = len(self.nodes), (node.shown[0], len(self.shown)), (node.typed[0], len(self.typed))
            if self.free_labels and self.free_labels[-1] is node:
                self.free_labels.pop()

    @staticmethod
    def _private(node: Node) -> bool:
        return node.tag in ("textarea", "select", "datalist") or (node.editable and not node.up.editable)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.raw:
            return self._say(self.get_starttag_text() or "")
        for closes, scopes in _ENDS.get(tag, ()):
            inner = self._last(scopes)
            if self._last(closes) > inner:
                self._pop(self._outermost(closes, inner))
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self._pop(len(self.stack) - 1)
        if tag in _BLOCK or tag == "br":
            self._say(_BREAK)
        up = self.stack[-1]
        node = Node(tag, {}, up, len(self.nodes), len(up.kids))
        for k, v in attrs:
            node.a.setdefault(k, v or "")  # the first of an attribute counts
        a = node.a
        up.kids.append(node)
        self.nodes.append(node)
        if up.tag == "details" and tag == "summary" and up.summary is None:
            up.summary = node
        style = a.get("style", "")
        node.closed = up.closed or (up.tag == "details" and "open" not in up.a and up.summary is not node)
        node.gone = up.gone or "hidden" in a or bool(style and _HIDES.search(style)) or tag in ("template", "noscript", "head")
        seen = _VISIBILITY.search(style) if style else None
        node.unseen = seen[1].lower() in ("hidden", "collapse") if seen else up.unseen
        node.clear = bool(style and _CLEAR.search(style))  # its own only
        edit = a.get("contenteditable")
        node.editable = up.editable if edit is None else edit.lower() in ("", "true", "plaintext-only")
        if tag in ("html", "body"):
            node.injected = 1 << 30
        else:
            marked = self.ignore in a or self.injected.search(" ".join(a.get(k, "") for k in ("id", "class", "data-extension-id", "data-weava-id")) + " " + tag)
            node.injected = 0 if marked else up.injected + 1
        if a.get("id"):
            self.by_id.setdefault(a["id"], node)
        if tag == "label":
            self.label_at.append(node.at)
            if "for" not in a and tag not in _VOID:
                self.free_labels.append(node)
        elif tag in _LABELABLE and a.get("type", "").lower() != "hidden":
            for label in self.free_labels:
                label.control = label.control or node
            self.free_labels = [x for x in self.free_labels if x.control is None]
        node.shown = (len(self.shown), len(self.shown))
        node.typed = (len(self.typed), len(self.typed))
        if tag not in _VOID:
            self.private += self._private(node)
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag in _SPECIAL:
                self.special.append(len(self.stack))
            self.stack.append(node)
            if tag in ("textarea", "title"):
                self.raw = tag

    def _outermost(self, tags: tuple[str, ...], inner: int) -> int:
        found = len(self.stack)
        for t in tags:
            places = self.open.get(t, [])
            at = bisect_left(places, inner + 1)
            if at < len(places):
                found = min(found, places[at])
        return found

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash says nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.raw and tag != self.raw:
            return self._say(f"</{tag}>")
        self.raw = None
        places = self.open.get(tag)
        if not places:
            return None
        if tag in _SPECIAL or tag in ("script", "style", "title"):
            scope = _SCOPE if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("table", "template")
            if places[-1] < self._last(tuple(t for t in scope if t != tag)):
                return None
        elif self.special and places[-1] < self.special[-1]:
            return None  # formatting across a block
        self._pop(places[-1])
        return None

    def handle_data(self, data: str) -> None:
        up = self.stack[-1]
        up.kids.append(data)
        self._say(data.replace(_BREAK, " "))

    def handle_comment(self, data: str) -> None:
        if self.raw:
            self._say(f"<!--{data}-->")


def short(chunks: list[str], begin: int, end: int, most: int = 500, gap: str = " ") -> str | None:
    """The first `most` characters of a slice of a buffer, spaces normalised. Reads no more chunks than it needs."""
    parts, n = [], 0
    for i in range(begin, end):
        chunk = chunks[i]
        for at in range(0, len(chunk), 4096):
            piece = chunk[at : at + 4096].replace(_BREAK, gap)
            parts.append(piece)
            n += len(piece) - sum(map(piece.count, " \n\t\r\f"))
            if n > most + 1:
                break
        if n > most + 1:
            break
    return " ".join("".join(parts).split())[:most].rstrip() or None


def brief(text: str | None, most: int = 500) -> str | None:
    return short([text], 0, 1, most) if text else None


class Scan:
    """What a scan tells of a page's elements."""

    def __init__(self, html: str, marker: str, ignore: str, sensitive: str) -> None:
        self.page, self.marker, self.sensitive = Page(html, ignore), marker, sensitive

    def shown(self, node: Node, most: int = 500, gap: str = " ") -> str | None:
        return short(self.page.shown, *node.shown, most, gap)

    def written(self, node: Node, most: int = 500) -> str | None:
        """Text as written in the source (blocks do not part words), all of it public."""
        return self.shown(node, most, "")

    def beside(self, node: Node) -> str | None:
        """Text next to a control up to a line break or another control: after it, else before it."""
        around = node.up.kids
        for side, step in ((around[node.place + 1 : node.place + 9], 1), (around[max(0, node.place - 8) : node.place][::-1], -1)):
            parts = []
            for x in side:
                if not isinstance(x, str) and x.tag in ("br", "button", *_FIELDS):
                    break
                if found := brief(x) if isinstance(x, str) else self.shown(x):
                    parts.append(found)
            if parts:
                return brief(" ".join(parts[::step]))
        return None

    def near(self, node: Node) -> str | None:
        """The only label within the nearest of four ancestors that has one, with the placeholder unless that says the same."""
        above, labels = node.up, self.page.label_at
        for _ in range(4):
            if above is None or above.up is None:
                return None
            at = bisect_left(labels, above.at + 1)
            if at + 1 < len(labels) and labels[at + 1] < above.end:
                return None
            if at < len(labels) and labels[at] < above.end and (found := self.written(self.page.nodes[labels[at]])):
                more = brief(node.a.get("placeholder"))
                return brief(f"{found} {more}") if more and more.lower() != found.lower() else found
            above = above.up
        return None

    def visible(self, node: Node) -> bool:
        if node.tag == "input" and node.a.get("type", "").lower() == "hidden":
            return False
        return not (node.closed or node.gone or node.unseen or node.clear)

    def options(self, node: Node) -> tuple[list[Node], Node | None]:
        """The options of a select and the chosen one: of one choice the last marked, else the first enabled; of many the first marked."""
        found = [x for x in self.page.nodes[node.at + 1 : node.end] if x.tag == "option"]
        marked = [x for x in found if "selected" in x.a]
        if "multiple" in node.a:
            return found, marked[0] if marked else None
        size = node.a.get("size", "")
        free = next((x for x in found if "disabled" not in x.a and not (x.up.tag == "optgroup" and "disabled" in x.up.a)), None)
        return found, marked[-1] if marked else None if size.isdigit() and int(size) > 1 else free

    def rows(self) -> Iterator[tuple]:
        """The values of ELEMENT after page_id and id, without those of injected interfaces, up to MOST_ELEMENTS visible elements."""
        nth = region = 0
        for index, node in enumerate(self.page.nodes):
            a, tag = node.a, node.tag
            visual = tag in ("canvas", "img") or (tag == "embed" and a.get("type") == "application/pdf") or self.marker in a
            listed = tag in _KEPT or (tag == "a" and "href" in a) or a.get("contenteditable") == "true" or "role" in a or a.get("tabindex", "-1") != "-1"
            if not (listed or visual) or node.injected < 16:
                continue
            listed = listed and nth < MOST_ELEMENTS
            if not (listed or (visual and region < MOST_REGIONS)):
                if nth >= MOST_ELEMENTS and region >= MOST_REGIONS:
                    return
                continue
            kind = a.get("type", "").lower() if tag == "input" else None
            kind = (kind if kind in _TYPES else "text") if tag == "input" else "text" if tag == "textarea" else "select" if tag == "select" else "text" if node.editable else None
            choice, field = tag == "input" and kind in ("checkbox", "radio"), tag in _FIELDS
            own = node.labels[0] if field and node.labels else None
            options, chosen = self.options(node) if tag == "select" else ([], None)
            private = field or node.editable
            # Options are a page's own words, but they stand in the buffer of what was typed, as all of a select does.
            said = lambda x, most=500: short(self.page.typed, *x.typed, most, "")
            value = None
            if tag == "input" and not choice:
                value = a.get("value")
            elif tag == "textarea":
                value = "".join(self.page.typed[slice(*node.typed)]).replace(_BREAK, "")
                value = value.removeprefix("\n")
            elif tag == "select" and chosen is not None:
                value = chosen.a["value"] if "value" in chosen.a else said(chosen)
            elif node.editable and not choice:
                value = "".join(self.page.typed[slice(*node.typed)]).replace(_BREAK, "\n").strip("\n")
            ticked = a.get("value", "on") if choice else None
            seen = self.visible(node) or (choice and own is not None and self.visible(own))
            hint = {"face": "FACE", "private-document": "PRIVATE_DOCUMENT"}.get(a.get(self.sensitive, "")) if visual else None
            labelled = " ".join(self.written(self.page.by_id[i], 2000) or "" for i in a.get("aria-labelledby", "").split() if i in self.page.by_id)
            yield (
                tag, brief(a.get("role"), 64), kind, None if private else brief(a.get("alt"), 2000) if tag == "img" else self.shown(node, 2000), brief(a.get("aria-label")), brief(labelled),
                (self.written(own) or "") if own else None, self.near(node) if field and own is None else None, self.beside(node) if choice else None, brief(a.get("title")), brief(a.get("placeholder")), value,
                not ("disabled" in a and tag in _DISABLED) and a.get("aria-disabled") != "true", seen, ("checked" in a) if choice else (a["aria-selected"] == "true" if "aria-selected" in a else None),
                [o for o in map(said, options) if o][:MOST_OPTIONS], said(chosen) if chosen is not None else None, brief(ticked) if ticked and ticked.strip().lower() != "on" else None, node.editable, visual, hint, index, nth if listed else -1, region,
            )
            nth += listed and seen
            region += visual and seen


def _page_rows(pages: DataFrame, marker: str, ignore: str, sensitive: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ELEMENT.split(", ")]
        for part in parts:
            for page, html in zip(part["page_id"], part["html"], strict=True):
                rows = [(page, f"el_{row[-3]}", *row) for row in Scan(html or "", marker, ignore, sensitive).rows()]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "selected": "boolean"})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInPandas(run, ELEMENT)


def _listed(pages: DataFrame, marker: str, ignore: str) -> DataFrame:
    from sluice.operators.elements import inferred_role

    rows = _page_rows(pages, marker, ignore, "data-sensitive").filter("nth >= 0")
    label = F.nullif(F.coalesce("aria", "labelled", "own_label", "near_label", "beside", "control_value", "title", "placeholder"), F.lit(""))
    role = F.when(F.col("editable") & F.col("role").isNull() & ~F.col("tag").isin("a", "button", "summary", "select"), "textbox").otherwise(F.col("role"))
    return rows.withColumn("label", label).withColumn("role", inferred_role(role, F.col("tag"), F.col("type")))


def page_elements(pages: DataFrame, marker: str = "data-visual-control", ignore: str = "data-scan-ignore") -> DataFrame:
    """The elements of each page in document order, those up to the MOST_ELEMENTS-th visible one, with the role that tag and type imply, without those of
    injected interfaces (or marked `ignore`). The label is the first of: aria-label, aria-labelledby, own label (also if empty: then there is none), near
    label, text beside a choice and its value, title, placeholder. Fields and editable elements have no text; their values are not here but in
    `private_values`, only whether there is one. visible: by attributes and inline styles, as layout, style sheets and shadow trees are not in
    static HTML. Null html has no elements; null page ids stay; other columns are ignored."""
    rows = _listed(pages, marker, ignore).withColumn("value_present", F.coalesce(F.length(F.trim("value")) > 0, F.lit(False)))
    return rows.select("page_id", "id", "tag", "role", "type", "text", "label", "enabled", "visible", "selected", "value_present", "options", "selected_option", "control_value", "dom_index")


def private_values(pages: DataFrame, marker: str = "data-visual-control", ignore: str = "data-scan-ignore") -> DataFrame:
    """page_id, element_id, input_type and value of the visible elements of `page_elements` that hold one: what fields and editable elements contain."""
    rows = _listed(pages, marker, ignore).filter("visible and length(trim(value)) > 0")
    return rows.select("page_id", F.col("id").alias("element_id"), F.coalesce("type", F.lit("text")).alias("input_type"), "value")


def page_regions(pages: DataFrame, marker: str = "data-visual-control", ignore: str = "data-scan-ignore", sensitive: str = "data-sensitive") -> DataFrame:
    """page_id, region_id, kind (CANVAS, IMAGE, PDF or CONTROL), requires_analysis, hint (FACE or PRIVATE_DOCUMENT, as the attribute `sensitive` says) and
    region_no of the visible images, canvases, PDFs and marked controls of each page, MOST_REGIONS at most. Static HTML has no viewport: see `in_viewport`."""
    rows = _page_rows(pages, marker, ignore, sensitive).filter("visual and visible")
    kind = F.when(F.col("tag") == "canvas", "CANVAS").when(F.col("tag") == "img", "IMAGE").when(F.col("tag") == "embed", "PDF").otherwise("CONTROL")
    return rows.filter(F.col("region_no") < MOST_REGIONS).select("page_id", F.col("id").alias("region_id"), kind.alias("kind"), F.lit(True).alias("requires_analysis"), "hint", (F.col("region_no") + 1).alias("region_no"))


def in_viewport(bbox: Column, width: Column, height: Column) -> Column:
    """Whether a box {x, y, width, height} has a part within a viewport; boxes that only touch its edge, and null ones, have none."""
    inside = (bbox["x"] + bbox["width"] > 0) & (bbox["y"] + bbox["height"] > 0) & (bbox["x"] < width) & (bbox["y"] < height) & (bbox["width"] > 0) & (bbox["height"] > 0)
    return F.coalesce(inside, F.lit(False))
