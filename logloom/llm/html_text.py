"""HTML extraction: a layout-aware rendering of all visible text.

A tree builder reads the tags, supplies those that HTML implies (ends of paragraphs, list items, rows and cells, missing table bodies
and rows, the end of the head) and moves text that stands loose in a table before it. Visibility rules then drop what a
browser does not show; of SVG it shows the text elements, each on lines of its own, and of MathML all but annotations. The renderer keeps block spacing, list markers with their indent, preformatted text, and tables with
aligned cells. Both walk the tree without recursion, so depth is not limited.

The work is local to a row: no shuffle. A table whose aligned rows would be mostly blanks (``MOST_PADDING``), as one with a single very wide cell, is written
without padding, so a page's tables render to at most that many times its characters, and a line is indented by ``MOST_INDENT`` at most: memory is bounded by a page.

Defined results: null html gives null, empty html and pages without visible text an empty text. Broken markup never fails: an end tag
without start is passed over, open elements end with the page, an unfinished tag at the end is dropped. Repeated rows are rendered alike;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .registry import query, table

# Element classes of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes"}
ESCAPABLE = {"textarea", "title"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
NEVER_SHOWN = {"head", "script", "style", "template", "noscript", "noembed", "noframes", "iframe", "object", "audio", "video", "canvas", "datalist", "rp", "title"}
# Elements of SVG and MathML: what is not drawn, and what holds HTML.
FOREIGN = {"svg", "math"}
NOT_DRAWN = {
    "svg": {"defs", "symbol", "metadata", "desc", "title", "clippath", "mask", "marker", "pattern", "lineargradient", "radialgradient"},
    "math": {"annotation", "annotation-xml", "mphantom"},
}
HOLDS_HTML = {"foreignobject", "desc", "title", "annotation-xml"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "menu", "dir", "table", "blockquote", "pre", "figure", "fieldset", "hr", "listing", "xmp"}
BLOCKS = SPACED | {"address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "div", "dt", "figcaption", "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "nav", "option", "search", "section", "summary", "tr"}
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "caption", "tr", "legend", "option", "table"} | {"table"}
LISTS = {"ul", "ol", "menu", "dir"}
SCOPE = {"table", "td", "th", "caption", "template", "html", "button", "object", "marquee"}
TABLE_PARTS = {"thead", "tbody", "tfoot"}
# Start tag: (open elements that it ends, elements beyond which it does not look).
IMPLIED_ENDS: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, LISTS | SCOPE), "dt": ({"dt", "dd"}, {"dl"} | SCOPE), "dd": ({"dt", "dd"}, {"dl"} | SCOPE),
    "option": ({"option"}, {"select", "optgroup"} | SCOPE), "optgroup": ({"option", "optgroup"}, {"select"} | SCOPE),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    **{k: (TABLE_PARTS | {"caption", "colgroup"}, {"table"}) for k in (*sorted(TABLE_PARTS), "caption", "colgroup")},
}
MOST_COLUMNS, MOST_ROWS = 1000, 65534
# A table is aligned while it takes at most this many times the signs of its cells, the characters of a cell's shortest tag added to each.
MOST_PADDING, LEAST_CELL = 16, 4
# Blanks before a line; lists nested deeper stay there.
MOST_INDENT = 64

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"[\x20\t\n\f\r]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("name", "attributes", "children", "parent", "space")

    def __init__(self, name: str, attributes: str = "", parent: Node | None = None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []
        # "math", "svg", "svg text" (inside a text element) or "" for HTML
        above = "" if parent is None or parent.name in HOLDS_HTML else parent.space
        self.space = name if name in FOREIGN else "svg text" if above == "svg" and name == "text" else above

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        return None

    def number(self, name: str, default: int, most: int = 1 << 30) -> int:
        found = re.match(r"\s*([+-]?\d{1,9})", self.attribute(name) or "")
        return min(most, int(found[1])) if found else default


class Builder:
    """Builds the tree from tags and texts in their order."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.count: dict[str, int] = {}  # open elements by name

    def nearest(self, names: set[str], barrier: set[str]) -> int | None:
        if not any(self.count.get(n) for n in names):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                return i
            if self.open[i].name in barrier:
                return None
        return None

    def end_to(self, at: int | None) -> None:
        while at is not None and len(self.open) > at:
            self.count[self.open.pop().name] -= 1

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.name] = self.count.get(node.name, 0) + 1

    def add(self, name: str, attributes: str = "") -> None:
        node = Node(name, attributes, self.open[-1])
        self.open[-1].children.append(node)
        if name not in VOID:
            self.push(node)

    def empty(self, name: str, attributes: str) -> bool:
        """Add an element of SVG or MathML that ends itself."""
        at = self.open[-1]
        if not attributes.endswith("/") or Node(name, "", at).space == "":
            return False
        if name in FOREIGN:
            self.leave_head()
        self.open[-1].children.append(Node(name, attributes, self.open[-1]))
        return True

    def leave_head(self) -> None:
        if len(self.open) > 1 and self.open[1].name == "head":
            self.end_to(1)

    def start(self, name: str, attributes: str) -> None:
        if name == "html" or name == "body":
            self.leave_head()
            if name == "body" and len(self.open) == 1 and not any(isinstance(c, Node) and c.name == "body" for c in self.root.children):
                self.add(name, attributes)
            return
        if name not in IN_HEAD and name != "head":
            self.leave_head()
        if name in ENDS_PARAGRAPH:
            self.end_to(self.nearest({"p"}, SCOPE))
        if name in IMPLIED_ENDS:
            self.end_to(self.nearest(*IMPLIED_ENDS[name]))
        if name in TABLE_PARTS or name in ("tr", "td", "th", "caption", "col", "colgroup"):
            at = self.nearest({"table"}, {"td", "th", "caption"} if self.nearest({"table"}, set()) is None else {"caption"})
            if at is None:
                return  # table parts outside a table are passed over
            if name == "tr" and self.nearest(TABLE_PARTS, {"table"}) is None:
                self.add("tbody")
            if name in ("td", "th") and self.nearest({"tr"}, {"table"}) is None:
                if self.nearest(TABLE_PARTS, {"table"}) is None:
                    self.add("tbody")
                self.add("tr")
        elif self.open[-1].name in TABLE_PARTS | {"table", "tr"} and name not in ("script", "style", "template", "form", "input"):
            self.foster(Node(name, attributes))
            return
        self.add(name, attributes)

    def foster(self, child: Node | str) -> None:
        """Put what stands loose in a table before it."""
        at = max(i for i, n in enumerate(self.open) if n.name == "table")
        inner = self.open[at]
        parent = inner.parent
        place = next(i for i in range(len(parent.children) - 1, -1, -1) if parent.children[i] is inner)
        parent.children.insert(place, child)
        if isinstance(child, Node):
            child.parent = parent
            if child.name not in VOID:
                self.push(child)

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", "")
        if name in ("html", "body"):
            return None
        if name == "head":
            return self.leave_head()
        if name == "p" and self.nearest({"p"}, SCOPE) is None:
            return None
        barrier = {"table"} if name in TABLE_PARTS | {"tr", "td", "th", "caption"} else (set() if name == "table" else {"td", "th", "caption", "table"} if name not in BLOCKS else SCOPE)
        same = {"h1", "h2", "h3", "h4", "h5", "h6"} if re.fullmatch("h[1-6]", name) else {name}
        return self.end_to(self.nearest(same, barrier - same))

    def text(self, text: str) -> None:
        if not text:
            return
        blank = not text.strip("\x20\t\n\f\r")
        if not blank:
            self.leave_head()
        at = self.open[-1]
        if at.name in TABLE_PARTS | {"table", "tr"}:
            if not blank:
                self.foster(text)
        else:
            at.children.append(text)


def parse(html: str) -> Node:
    b, at, n = Builder(), 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            b.text(unescape(html[at:]))
            break
        if lt > at:
            b.text(unescape(html[at:lt]))
        head = html[lt + 1: lt + 2]
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
        elif head in ("!", "?") or html.startswith("</", lt) and not html[lt + 2: lt + 3].isalpha():
            stop = html.find(">", lt)
            at = n if stop < 0 else stop + 1
        elif head.isascii() and head.isalpha() or head == "/":
            m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
            if m is None:
                break
            name, at = m[2].lower(), m.end()
            if m[1]:
                b.end(name)
                continue
            if b.empty(name, m[3]):
                continue
            b.start(name, m[3])
            if name in RAW or name in ESCAPABLE:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                inside = html[at: stop.start() if stop else n]
                if b.open[-1].name == name:
                    b.open[-1].children.append(unescape(inside) if name in ESCAPABLE else inside)
                at = stop.start() if stop else n
        else:
            b.text("<")
            at = lt + 1
    return b.root


class Lines:
    """Text laid out in lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.blank, self.indent = False, False, 0
        self.marker: str | None = None

    def words(self, text: str) -> None:
        for i, part in enumerate(_SPACE.split(text)):
            self.space |= i > 0
            if part:
                if self.space and self.now:
                    self.now.append(" ")
                self.now.append(part)
                self.space = False

    def preformatted(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.line(keep=True)
            if line:
                self.now.append(line)

    def line(self, keep: bool = False) -> None:
        """End the line; an empty one counts only with ``keep``."""
        text, self.now, self.space = "".join(self.now).rstrip(), [], False
        if not text and not (keep and self.lines):
            return
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        if not text:
            self.lines.append("")
            return
        mark, self.marker = self.marker or "", None
        self.lines.append(" " * min(MOST_INDENT, max(0, self.indent - len(mark))) + mark + text)

    def gap(self) -> None:
        self.line()
        self.blank = True

    def done(self) -> list[str]:
        self.line()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a].strip():
            a += 1
        while b > a and not self.lines[b - 1].strip():
            b -= 1
        return self.lines[a:b]


class Grid:
    """Cells of a table."""

    def __init__(self) -> None:
        self.cells: list[tuple[int, int, int, str, list[str]]] = []
        self.taken: dict[int, int] = {}  # column: first row that is free below a cell of several rows
        self.row, self.column, self.rows = -1, 0, 0

    def next_row(self) -> None:
        self.row, self.column = self.row + 1, 0

    def cell(self, node: Node, lines: list[str]) -> None:
        self.row = max(self.row, 0)
        while self.taken.get(self.column, 0) > self.row:
            self.column += 1
        across = max(1, node.number("colspan", 1, MOST_COLUMNS))
        down = max(1, node.number("rowspan", 1, MOST_ROWS))
        side = (node.attribute("align") or "").lower()
        found = re.search(r"text-align\s*:\s*(\w+)", node.attribute("style") or "", re.I)
        self.cells.append((self.row, self.column, across, found[1].lower() if found else side, lines))
        if down > 1:
            for c in range(self.column, self.column + across):
                self.taken[c] = self.row + down
        self.column += across

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for _, c, across, _, lines in sorted(self.cells, key=lambda x: x[2]):
            need = max((len(x) for x in lines), default=0)
            if across == 1:
                width[c] = max(width.get(c, 0), need)
            else:
                has = sum(width.get(i, 0) for i in range(c, c + across)) + 2 * (across - 1)
                if need > has:
                    width[c] = width.get(c, 0) + need - has
        columns = sorted({c for _, c, *_ in self.cells} | set(width))
        start, at = {}, 0
        for c in columns:
            start[c] = at
            at += width.get(c, 0) + (2 if width.get(c, 0) else 0)
        rows: dict[int, list[tuple[int, int, int, str, list[str]]]] = {}
        for cell in self.cells:
            rows.setdefault(cell[0], []).append(cell)
        size = 0
        for cells in rows.values():
            ends: dict[int, int] = {}
            for _, c, across, side, lines in cells:
                room = width.get(c, 0) if across == 1 and side in ("right", "end", "center") else 0
                for k, x in enumerate(lines):
                    ends[k] = max(ends.get(k, 0), start[c] + max(len(x), room))
            size += sum(ends.values())
        signs = sum(len(x) - x.count(" ") for *_, lines in self.cells for x in lines)
        if size > MOST_PADDING * (signs + LEAST_CELL * len(self.cells)):
            return self.unaligned(rows)
        out: list[str] = []
        for _, cells in sorted(rows.items()):
            for k in range(max(len(c[4]) for c in cells)):
                line = ""
                for _, c, across, side, lines in sorted(cells, key=lambda x: x[1]):
                    if k < len(lines):
                        room = sum(width.get(i, 0) for i in range(c, c + across)) if across == 1 else 0
                        text = lines[k]
                        if side in ("right", "end"):
                            text = text.rjust(room)
                        elif side == "center":
                            text = text.center(room).rstrip()
                        line = line.ljust(start[c]) + text
                out.append(line.rstrip())
        return [x for x in out if x]

    @staticmethod
    def unaligned(rows: dict[int, list[tuple[int, int, int, str, list[str]]]]) -> list[str]:
        """Rows of cells two blanks apart; a cell of several lines stands on lines of its own. Nothing is padded and all text is kept."""
        out: list[str] = []
        for _, cells in sorted(rows.items()):
            line = ""
            for *_, lines in sorted(cells, key=lambda x: x[1]):
                if len(lines) > 1:
                    out += [line, *lines]
                    line = ""
                elif lines:
                    line = f"{line}  {lines[0]}" if line else lines[0]
            out.append(line)
        return [x for x in out if x.strip()]


def shown(node: Node) -> bool:
    name = node.name
    if name in NEVER_SHOWN or node.space and name in NOT_DRAWN[node.space.split()[0]]:
        return False
    if not node.attributes:
        return name != "dialog"
    if node.attribute("hidden") is not None:
        return False
    if name == "dialog" and node.attribute("open") is None:
        return False
    if node.space and (node.attribute("display") or "").strip().lower() == "none":
        return False
    return not _HIDDEN_STYLE.search(node.attribute("style") or "")


def render(root: Node) -> str:
    """The visible text of a tree."""
    writers, grids = [Lines()], []
    lists: list[list] = []  # [name, next number, step] of the open lists
    pre = 0
    # (node or text, entering, visible)
    stack: list[tuple[Node | str, bool, bool]] = [(root, True, True)]
    while stack:
        item, entering, visible = stack.pop()
        out = writers[-1]
        if isinstance(item, str):
            if visible:
                (out.preformatted if pre else out.words)(item)
            continue
        name = item.name
        if entering:
            if not shown(item):
                continue
            found = _VISIBILITY.search((item.attribute("style") or "") + (f";visibility:{item.attribute('visibility')}" if item.space else "")) if item.attributes else None
            visible = found[1].lower() == "visible" if found else visible
            if name == "br":
                out.line(keep=True)
                continue
            if name == "hr":
                out.gap()
                continue
            if name == "input":
                if visible and (item.attribute("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    out.words(" " + (item.attribute("value") or "") + " ")
                continue
            apart = name == "text" and item.space == "svg text" or name == "mtr" and item.space == "math"
            if apart or name in BLOCKS and name not in ("tr", "option"):
                (out.gap if name in SPACED and not (name in LISTS and lists) else out.line)()
            if name in LISTS:
                step = -1 if item.attribute("reversed") is not None else 1
                count = sum(isinstance(c, Node) and c.name == "li" for c in item.children) if step < 0 else 1
                lists.append([name, item.number("start", count), step])
            elif name == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                if kind[0] == "ol":
                    number = item.number("value", kind[1])
                    kind[1] = number + kind[2]
                    mark = f"{number}. "
                else:
                    mark = "- "
                out.indent += len(mark)
                out.marker = mark
            elif name in ("dd", "blockquote"):
                out.indent += 4
            elif name in ("pre", "listing", "xmp", "textarea"):
                pre += 1
            elif name == "table":
                grids.append(Grid())
            elif name == "tr" and grids:
                grids[-1].next_row()
            elif name in ("td", "th") and grids:
                writers.append(Lines())
                lists.append(["ul", 1, 1])
            elif name == "q":
                out.words('"')
            elif name == "mtd" and item.space:
                out.words(" ")
            stack.append((item, False, visible))
            children: list[Node | str] = item.children
            if name == "details" and item.attribute("open") is None:
                children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
            if item.space == "svg" and name not in HOLDS_HTML:
                children = [c for c in children if isinstance(c, Node)]
            stack += [(c, True, visible) for c in reversed(children)]
            continue
        if name in ("td", "th") and grids:
            lists.pop()
            grids[-1].cell(item, writers.pop().done())
            continue
        if name == "table":
            for line in grids.pop().lines():
                out.now = [line]
                out.line()
            out.gap()
            continue
        if name in ("pre", "listing", "xmp", "textarea"):
            pre -= 1
        if name == "q":
            out.now.append('"')
        if name in BLOCKS and name != "tr" or name == "text" and item.space == "svg text" or name == "mtr" and item.space == "math":
            (out.gap if name in SPACED and not (name in LISTS and len(lists) > 1) else out.line)()
        if name in LISTS:
            lists.pop()
        elif name == "li":
            kind = lists[-1] if lists else ["ul", 1, 1]
            number = item.number("value", kind[1] - kind[2]) if kind[0] == "ol" else 0
            out.indent -= len(f"{number}. ") if kind[0] == "ol" else 2
            out.marker = None
        elif name in ("dd", "blockquote"):
            out.indent -= 4
    return "\n".join(writers[0].done())


def visible_text(html: str | Column) -> Column:
    """The visible text of a page, laid out."""

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else render(parse(x)) for x in batch.to_pylist()], pa.string())

    extract.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(extract, "string")(html)


def extract_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per page: key, ``text``, ``n_chars`` and ``n_lines``."""
    rows = pages.select(F.col(id_column), visible_text(F.col(html_column)).alias("text"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return rows.select(id_column, "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    """The visible text of every page."""
    return extract_pages(table(spark, directory, "pages"))


ship_by_value(__name__)
