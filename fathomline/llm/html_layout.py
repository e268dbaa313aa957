"""Layout-aware HTML rendering: a tree builder with implied tags, then a renderer of visible text.

The tokenizer follows the states of the HTML syntax: an unquoted value ends at white space or ``>`` and may hold
quotes, a quoted one may hold ``>``. A quote that is never closed ends with its tag, so no text is lost to it. The
builder closes elements that others imply the end of (paragraphs, list items, cells, rows, options, headings), opens
table rows that are left out, ends a head at the first thing that cannot stand in it, ignores stray end tags, and
closes what is open at the end. Open elements are counted by scope, so a tag costs the same however deep it stands.

Visibility. Not shown are scripts, styles, templates, head data other than the title, form data lists, fallback
content of embedded media, unshown parts of drawings and formulas, elements with the ``hidden`` attribute or
``display:none``, and dialogs that are not open. ``visibility:hidden`` hides text until an inner element turns
``visible`` again. Everything else is shown: text for no screen reader, closed details, drawings, formulas.

Layout. Blocks (by tag, or by ``display`` in an inline style) are set apart by line breaks and paragraphs by blank
lines; white space runs become one space except in ``pre``; list items get their mark or number and the indent of
their depth, 40 columns at most; ``br`` and ``hr`` break lines; images give their ``alt``. A table is a grid: cells
may have several lines and span rows and columns, and every column begins where its widest line of at most 60
characters allows, up to column 240; what is wider pushes its neighbours on. A table that holds a table is laid out
as blocks, cell by cell.

Edge cases. Null, empty and blank pages give an empty text. Markup that is cut off is kept as far as it goes; a tag
cut off is none. Neither depth nor length is bounded; time follows the page's length. Rows are kept as they come,
repeated ones too; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.runtime import ship

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
HIDDEN = frozenset(
    "script style template noscript iframe noembed noframes head meta link datalist object canvas audio video rp col colgroup area param".split()
)
#: What may stand in a head; anything else ends it.
HEADS = frozenset("head title meta link base basefont bgsound script style template noscript noframes".split())
#: Parts of drawings and formulas that are not shown.
UNSEEN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div section article aside header footer nav main address form fieldset li dt dd tr td th caption thead tbody tfoot "
    "figcaption details summary dialog hr title center dir menu legend optgroup option text".split()
)
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
GRID = SECTIONS | frozenset("table tr td th caption".split())
#: Elements that what stands inside does not end.
SCOPES = frozenset("table td th caption template object svg math button".split())
ITEMS = {"li": "li", "dt": "dt", "dd": "dt", "option": "option", "optgroup": "option"}
#: What an item's end does not reach beyond.
OWNERS = {**dict.fromkeys(LISTS, "li"), "dl": "dt", "select": "option", "datalist": "option"}
_ENDS_P = PARAGRAPHS | frozenset("div section article aside header footer nav main address form fieldset hr li dt dd center details summary menu dir".split())
INDENT, WIDE, FAR = 40, 60, 240

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^ \t\n\r\f/>]*)|[!?/])")
_ATTR = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f>"'][^ \t\n\r\f>]*))?)?""")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_END_OF_COMMENT = re.compile(r"--!?>")


class Node:
    __slots__ = ("attrs", "children", "holds", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.holds = tag, attrs, [], False


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes from ``at`` on, whether the tag closes itself, and where it ends; None where it never does."""
    attrs: dict[str, str] = {}
    n = len(page)
    while True:
        while at < n and page[at] in " \t\n\r\f/":
            at += 1
        if at >= n:
            return None
        if page[at] == ">":
            return attrs, page[at - 1] == "/", at + 1
        m = _ATTR.match(page, at)
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        at = m.end()
        if at < n and page[at] in "\"'" and m[2] is None and m[3] is None and m[4] is None and "=" in m[0]:
            # a quote without its end: the value goes to the end of the tag
            stop = page.find(">", at)
            if stop < 0:
                return None
            value, at = page[at + 1 : stop], stop
        attrs.setdefault(name, html.unescape(value) if "&" in value else value)


class Builder:
    """Open elements, counted by scope."""

    def __init__(self):
        self.root = Node("", {})
        self.stack = [self.root]
        #: Open elements by tag inside each scope, and what each scope is; the same for parts of tables.
        self.scopes: list[dict[str, int]] = [defaultdict(int)]
        self.inner = [""]
        self.grids: list[dict[str, int]] = [defaultdict(int)]
        self.holder = [""]
        self.tables: list[Node] = []
        self.items = {"li": [0], "dt": [0], "option": [0]}
        self.drawn = dict.fromkeys(UNSEEN, 0)

    def push(self, node: Node) -> None:
        tag = node.tag
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.scopes[-1][tag] += 1
        if tag in ITEMS:
            self.items[ITEMS[tag]][-1] += 1
        if tag in GRID:
            self.grids[-1][tag] += 1
        if tag in OWNERS:
            self.items[OWNERS[tag]].append(0)
        if tag in SCOPES:
            self.scopes.append(defaultdict(int))
            self.inner.append(tag)
            for counts in self.items.values():
                counts.append(0)
        if tag in ("table", "template"):
            self.grids.append(defaultdict(int))
            self.holder.append(tag)
        if tag == "table":
            if self.tables:
                self.tables[-1].holds = True
            self.tables.append(node)
        if tag in self.drawn:
            self.drawn[tag] += 1

    def pop(self) -> None:
        tag = self.stack.pop().tag
        if tag in self.drawn:
            self.drawn[tag] -= 1
        if tag == "table":
            self.tables.pop()
        if tag in ("table", "template"):
            self.grids.pop()
            self.holder.pop()
        if tag in SCOPES:
            self.scopes.pop()
            self.inner.pop()
            for counts in self.items.values():
                counts.pop()
        if tag in OWNERS:
            self.items[OWNERS[tag]].pop()
        if tag in GRID:
            self.grids[-1][tag] -= 1
        if tag in ITEMS:
            self.items[ITEMS[tag]][-1] -= 1
        self.scopes[-1][tag] -= 1

    def pop_to(self, *tags: str) -> None:
        while self.stack[-1].tag not in tags:
            self.pop()
        self.pop()

    def text(self, raw: str) -> None:
        if raw:
            if self.stack[-1].tag == "head" and not raw.isspace():
                self.pop()
            self.stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def close(self, name: str) -> None:
        if name == "table" or name in GRID:
            if self.holder[-1] == "table" and (name == "table" or self.grids[-1][name]):
                self.pop_to(name)
        elif name in SCOPES:
            if self.inner[-1] == name:
                self.pop_to(name)
        elif name in ITEMS and not self.items[ITEMS[name]][-1]:
            pass  # an item ends inside its own list only
        elif name not in ("body", "html") and self.scopes[-1][name] > 0:
            self.pop_to(name)

    @property
    def drawing(self) -> bool:
        return any(self.drawn.values())

    def open(self, name: str, attrs: dict[str, str], alone: bool) -> Node | None:
        grid = self.grids[-1]
        if self.stack[-1].tag == "head" and name not in HEADS:
            self.pop()
        if name in GRID and name != "table":
            if self.holder[-1] != "table":
                return None  # no table is open: the tag says nothing
            inner = [t for t in ("caption", "td", "th") if grid[t]]
            if inner:
                self.pop_to(*inner)
                while any(grid[t] for t in inner):
                    self.pop_to(*inner)
            if name not in ("td", "th") and grid["tr"]:
                self.pop_to("tr")
            if name in SECTIONS or name == "caption":
                while any(grid[t] for t in SECTIONS):
                    self.pop_to(*SECTIONS)
            # what was left open between the table's parts ends with them
            while self.stack[-1].tag not in GRID:
                self.pop()
            if name in ("td", "th") and self.stack[-1].tag != "tr":
                self.push(Node("tr", {}))
        if name == "table" and self.stack[-1].tag in GRID and self.stack[-1].tag not in ("td", "th", "caption"):
            self.pop_to("table")
        if name in ITEMS:
            kind = ITEMS[name]
            ended = ("option",) if name == "option" else ("option", "optgroup") if name == "optgroup" else ("dt", "dd") if kind == "dt" else ("li",)
            while self.items[kind][-1] and any(self.scopes[-1][t] > 0 for t in ended):
                self.pop_to(*ended)
        if name in _ENDS_P and self.scopes[-1]["p"] > 0:
            self.pop_to("p")
        if name in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        for outer, parts in UNSEEN.items():
            if name in parts and self.drawn[outer]:
                attrs["hidden"] = ""
        node = Node(name, attrs)
        if alone or name in VOID or (name in RAW and not (name == "title" and self.drawing)):
            self.stack[-1].children.append(node)
        else:
            self.push(node)
        return node


def parse(page: str) -> Node:
    """The tree of a page under one nameless root; text is str, elements are nodes."""
    b = Builder()
    at, end = 0, len(page)
    while at < end:
        m = _OPEN.search(page, at)
        if m is None:
            b.text(page[at:])
            break
        b.text(page[at : m.start()])
        name = m[2]
        if name is None:
            if m[0] == "<!--":
                stop = m.end() if page.startswith(">", m.end()) else m.end() + 1 if page.startswith("->", m.end()) else None
                stop = stop + (page[stop] == ">" if stop < end else 0) if stop is not None else None
                if stop is None:
                    found = _END_OF_COMMENT.search(page, m.end())
                    stop = found.end() if found else end
            else:
                stop = page.find(">", m.end()) + 1
                if not stop:
                    stop = end
            at = stop
            continue
        name = name.lower()
        got = _attributes(page, m.end())
        if got is None:
            break  # a tag that is cut off
        attrs, alone, at = got
        if m[1]:
            if name == "br":
                b.open("br", {}, True)
            else:
                b.close(name)
            continue
        if name == "plaintext":
            b.text(page[at:].replace("&", "&amp;"))
            break
        node = b.open(name, attrs, alone and (b.drawing or name in UNSEEN))
        if node is not None and name in RAW and not (name == "title" and b.drawing):
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw = page[at : stop.start() if stop else end]
            node.children.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            at = stop.end() if stop else end
    return b.root


def _style(node: Node) -> dict[str, str]:
    raw = node.attrs.get("style")
    if not raw:
        return {}
    pairs = (d.partition(":") for d in re.sub(r"/\*.*?\*/", "", raw, flags=re.S).split(";"))
    return {k.strip().lower(): re.sub(r"\s*!\s*important\s*$", "", v.strip().lower()) for k, c, v in pairs if c}


def concealed(node: Node, style: dict[str, str]) -> bool:
    """Whether nothing of an element is shown."""
    a = node.attrs
    return (
        node.tag in HIDDEN or "hidden" in a or style.get("display") == "none" or (node.tag == "dialog" and "open" not in a)
        or (node.tag == "input" and a.get("type", "").lower() == "hidden")
    )


class _Page:
    """Lines under construction: pending gaps, the current line, and the prefix of a list item."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.prefix = ""
        self.indent = 0
        self.lists: list[list] = []
        self.pre = 0

    def word(self, text: str) -> None:
        if self.pre:
            first, *rest = text.split("\n")
            self.put(first)
            for line in rest:
                self.flush(True)
                self.put(line)
            return
        body = _SPACE.sub(" ", text)
        if body[:1] == " " and self.now:
            self.space = True
        if core := body.strip(" "):
            self.put((" " if self.space and self.now else "") + core)
            self.space = body[-1] == " "

    def put(self, text: str) -> None:
        if text:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.now.append(text)

    def flush(self, empty: bool = False) -> None:
        if self.now or empty:
            margin = " " * min(self.indent, INDENT)
            self.lines.append((margin + self.prefix[-INDENT:] + "".join(self.now)).rstrip())
            if self.prefix:
                self.indent += len(self.prefix)
                self.prefix = ""
        self.now, self.space = [], False

    def apart(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def margin(self) -> tuple[int, str, int]:
        return self.indent, self.prefix, len(self.lines)

    def back_to(self, margin: tuple[int, str, int]) -> None:
        """The margin as it was; a prefix that has been printed since leaves its room."""
        self.indent, self.prefix, lines = margin
        if len(self.lines) > lines:
            self.indent, self.prefix = self.indent + len(self.prefix), ""

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        first = next((k for k, x in enumerate(lines) if x), 0)
        return lines[first:]


def _number(raw: str | None, low: int, high: int, other: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", raw or "")
    return min(max(int(m[1]), low), high) if m else other


class _Covered:
    """Columns that cells of earlier rows still cover: disjoint spans, each up to a row, and the runs they form.

    Every span is entered once and ends once, so time follows the number of cells, not rows times columns.
    """

    def __init__(self):
        self.starts: list[int] = []
        self.spans: dict[int, tuple[int, int]] = {}  # start: end, first row that is free again
        self.runs: list[int] = []
        self.ends: dict[int, int] = {}
        self.due: list[tuple[int, int, int]] = []

    def _enter(self, start: int, end: int, until: int) -> None:
        insort(self.starts, start)
        self.spans[start] = (end, until)
        heappush(self.due, (until, start, end))

    def _leave(self, start: int) -> tuple[int, int]:
        del self.starts[bisect_left(self.starts, start)]
        return self.spans.pop(start)

    def cover(self, start: int, end: int, until: int) -> None:
        """What a new cell covers is its own, whoever covered it before."""
        k = max(0, bisect_left(self.starts, start) - 1)
        for at in [x for x in self._from(k, end) if self.spans[x][0] > start]:
            stop, row = self._leave(at)
            if at < start:
                self._enter(at, start, row)
            if stop > end:
                self._enter(end, stop, row)
        self._enter(start, end, until)
        k = bisect_left(self.runs, start)
        if k and self.ends[self.runs[k - 1]] >= start:
            k -= 1
            start = self.runs[k]
        while k < len(self.runs) and self.runs[k] <= end:
            end = max(end, self.ends.pop(self.runs.pop(k)))
        self.runs.insert(k, start)
        self.ends[start] = end

    def _from(self, k: int, end: int) -> Iterator[int]:
        while k < len(self.starts) and self.starts[k] < end:
            yield self.starts[k]
            k += 1

    def row(self, now: int) -> None:
        """Spans that end before row ``now`` are free again."""
        while self.due and self.due[0][0] <= now:
            until, start, end = heappop(self.due)
            if self.spans.get(start) != (end, until):
                continue  # another cell took of it since
            self._leave(start)
            k = bisect_right(self.runs, start) - 1
            first = self.runs.pop(k)
            last = self.ends.pop(first)
            for a, b in ((end, last), (first, start)):
                if a < b:
                    self.runs.insert(k, a)
                    self.ends[a] = b

    def free(self, at: int) -> int:
        """The first free column from ``at`` on."""
        k = bisect_right(self.runs, at) - 1
        return max(at, self.ends[self.runs[k]]) if k >= 0 else at


class _Grid:
    """Cells of a table by row and column."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken = _Covered()
        self.at = 0

    def row(self) -> None:
        self.rows.append([])
        self.at = 0
        self.taken.row(len(self.rows) - 1)

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        self.at = self.taken.free(self.at)
        if rows > 1:
            self.taken.cover(self.at, self.at + columns, len(self.rows) - 1 + rows)
        self.rows[-1].append((self.at, columns, lines))
        self.at += columns

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for cells in self.rows:
            for at, columns, lines in cells:
                if columns == 1 and lines:
                    width[at] = max(width.get(at, 0), max((len(x) for x in lines if len(x) <= WIDE), default=0))
        begin, x = {}, 0
        for c in sorted(width):
            begin[c] = x
            x += width[c] + 2
        order, out = list(begin), []
        for cells in self.rows:
            for k in range(max((len(lines) for _, _, lines in cells), default=0)):
                now = ""
                for at, _, lines in cells:
                    if k < len(lines) and lines[k]:
                        # a column of spanning cells only begins where the next one does
                        near = bisect_left(order, at)
                        to = begin[order[near]] if near < len(order) else x
                        now = now.ljust(to) if len(now) + (2 if now else 0) <= to <= FAR else now + "  " if now else now
                        now += lines[k]
                if now:
                    out.append(now)
        return out


def render(root: Node) -> str:
    page = whole = _Page()
    grid: _Grid | None = None
    # (element, its children, whether text shows, its gap, the page's margin before it, the page that a cell goes back to)
    walk: list[tuple] = [(root, iter(root.children), True, 0, None, None)]
    while walk:
        node, rest, shown, gap, margin, back = walk[-1]
        child = next(rest, None)
        if child is None:
            walk.pop()
            tag = node.tag
            if back is not None:
                made, page = page.done(), back
                grid.cell(made, _number(node.attrs.get("colspan"), 1, 1000, 1), _number(node.attrs.get("rowspan"), 0, 65534, 1) or 65534)
                continue
            if tag == "table" and not node.holds:
                made, grid = grid.lines(), None
                for line in made:
                    page.put(line)
                    page.flush()
            elif tag in LISTS or tag in ("li", "dd", "blockquote"):
                page.flush()
                page.back_to(margin)
                if tag in LISTS:
                    page.lists.pop()
            elif tag in ("pre", "textarea", "xmp"):
                page.pre -= 1
            if gap:
                page.apart(gap)
            continue
        if isinstance(child, str):
            if shown:
                page.word(child)
            continue
        tag = child.tag
        if tag == "head":
            for x in child.children:
                if isinstance(x, Node) and x.tag == "title":
                    page.word("".join(c for c in x.children if isinstance(c, str)))
                    page.apart(2)
            continue
        style = _style(child)
        if concealed(child, style):
            continue
        seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), shown)
        if tag in ("br", "hr"):
            page.flush(tag == "br")
            continue
        if tag in ("img", "input"):
            if seen and (tag == "img" or child.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text")):
                page.word(child.attrs.get("alt" if tag == "img" else "value", ""))
            continue
        if grid is not None and tag in GRID and tag != "caption":
            if tag == "tr":
                grid.row()
            walk.append((child, iter(child.children), seen, 0, None, page if tag in ("td", "th") else None))
            if tag in ("td", "th"):
                page = _Page()
            continue
        gap = 0
        if tag in BLOCKS and style.get("display") != "inline":
            gap = 2 if tag in PARAGRAPHS and not (tag in LISTS and page.lists) else 1
        elif style.get("display") in ("block", "flex", "grid", "table", "list-item"):
            gap = 1
        if gap:
            page.apart(gap)
        margin = page.margin()
        if tag == "table" and not child.holds:
            grid = _Grid()
        if tag in LISTS:
            page.lists.append([tag == "ol", _number(child.attrs.get("start"), -(10**9), 10**9, 1) - 1, page.indent + len(page.prefix)])
        elif tag == "li":
            mark = "- "
            if page.lists:
                now = page.lists[-1]
                if now[0]:
                    now[1] = _number(child.attrs.get("value"), -(10**9), 10**9, now[1] + 1)
                    mark = f"{now[1]}. "
                if not page.prefix:
                    page.indent = now[2]
            page.prefix += mark
        elif tag in ("pre", "textarea", "xmp"):
            page.pre += 1
            first = child.children[0] if child.children else None
            if isinstance(first, str) and first.startswith("\n"):
                child.children[0] = first[1:]  # a line break right after the tag does not count
        elif tag in ("dd", "blockquote"):
            if page.prefix:
                page.prefix += " " * 4
            else:
                page.indent += 4
        walk.append((child, iter(child.children), seen, gap, margin, None))
    return "\n".join(whole.done())


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


_TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("text", T.StringType())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [page_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], names=_TEXTS.names)


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, _TEXTS)
