"""HTML extraction by layout-aware rendering.

A tree builder closes implied tags; a walk over the tree skips what a reader
would not see and writes all visible text: blocks on lines of their own,
paragraphs set apart by an empty line, list items with bullets or numbers and
indentation, preformatted text as it is, tables with aligned cells.

Visibility follows the attributes and inline styles of the page (style sheets are
not read): ``hidden`` and ``display: none`` remove an element with all it holds;
``visibility`` is inherited, so that a visible element inside a hidden one shows.
A cell that spans rows or columns keeps its place free in all of them; East Asian
wide characters count two columns.

Defined cases: a null page counts as empty (empty text); markup errors never
raise (unknown end tags are ignored, open elements end with their parent, an
unclosed comment or tag reaches to the end of the page);
nesting of any depth is walked without recursion; repeated rows give equal
results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import as_strings, text_rows

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas svg math datalist noframes".split())
LINES = frozenset("address article aside body center dd details dialog div dt fieldset figcaption figure footer form header hgroup html legend li main nav option optgroup search section summary tr caption select".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table hr menu dir listing".split())
CLOSES_P = (LINES | APART) - {"body", "html", "li", "dd", "dt", "option", "optgroup", "tr", "caption", "legend", "select"}
#: Start tag -> (elements that it ends, elements beyond which it does not look).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption html button object li div blockquote section article".split())
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
_OPEN_COMMENT = re.compile(r"<!--(?!>|->)")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds a tree of Nodes and strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _end(self, ends: set[str] | frozenset[str], beyond: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element among ``ends`` that lies within the nearest of ``beyond``."""
        cut = 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in ends:
                cut = i
            elif tag in beyond:
                break
        if cut:
            del self.open[cut:]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end({"p"}, SCOPE)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        elif self.open[-1].tag == "head" and tag not in UNSEEN:
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in LINES and tag not in APART:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag("br", [])
        beyond = {"table"} if tag not in ("table", "html", "body") else ()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return None
            if self.open[i].tag in beyond:
                break
        if tag == "p":
            self.open[-1].children.append(Node("p", {}))
        return None

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)


def displayed(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False
    if node.tag == "input":
        return (node.attrs.get("type") or "text").lower() in ("submit", "button", "reset")
    style = node.attrs.get("style")
    return not (style and _NONE.search(style))


def visibility(node: Node, inherited: bool) -> bool:
    """Whether the text of an element shows, if not its own descendants say otherwise; the last declaration counts."""
    style = node.attrs.get("style")
    said = _VISIBILITY.findall(style) if style else None
    return said[-1].lower() == "visible" if said else inherited


class Writer:
    """Collects text with pending breaks, which collapse as margins do."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.indent: list[str] = []
        self.bullet = ""

    def block(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def brk(self) -> None:
        self.gap = min(self.gap + 1, 2)
        self.space = False

    def _start(self) -> None:
        """What stands before the next visible character."""
        if self.gap or not self.parts or self.bullet:
            if self.parts:
                self.parts.append("\n" * max(self.gap, 1))
            if self.bullet:
                self.parts.append("".join(self.indent[:-1]) + self.bullet)
                self.bullet = ""
            else:
                self.parts.append("".join(self.indent))
        elif self.space:
            self.parts.append(" ")
        self.gap, self.space = 0, False

    def text(self, data: str) -> None:
        words = _BLANKS.sub(" ", data)
        core = words.strip(" ")
        if not core:
            self.space = self.space or bool(words)
            return
        if words[0] == " ":
            self.space = True
        self._start()
        self.parts.append(core)
        self.space = words[-1] == " "

    def verbatim(self, data: str) -> None:
        for i, line in enumerate(data.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.gap += 1
            if line:
                self._start()
                self.parts.append(line)

    def value(self) -> str:
        return "".join(self.parts)


def _number(value: str | None, default: int) -> int:
    try:
        return int(value or "")
    except ValueError:
        return default


def _columns(line: str) -> int:
    """Columns that a line takes on a fixed-width display."""
    return len(line) if line.isascii() else sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in line)


class _Table:
    """Cells by row and column; places that a spanning cell covers stay free."""

    def __init__(self):
        self.rows: list[dict[int, str]] = []
        self.covered: dict[int, int] = {}  # rows after this one that a column is still covered in
        self.span = (1, 1)

    def row(self) -> None:
        self.covered = {c: n - 1 for c, n in self.covered.items() if n > 1} if self.rows else {}
        self.rows.append({})
        self.column = 0

    def cell(self, text: str) -> None:
        if not self.rows:
            self.row()
        while self.covered.get(self.column, 0) > 0:
            self.column += 1
        self.rows[-1][self.column] = text
        wide, deep = self.span
        for c in range(self.column, self.column + wide):
            if deep > 1:
                self.covered[c] = deep
        self.column += wide

    def lines(self) -> list[str]:
        """Rows with cells padded to their columns' widths; lines of one cell stay in its column."""
        rows = [{c: t.split("\n") for c, t in r.items()} for r in self.rows if any(r.values())]
        used = sorted({c for r in rows for c in r})
        width = {c: max((_columns(line) for r in rows for line in r.get(c, ())), default=0) for c in used}
        out = []
        for r in rows:
            for k in range(max(map(len, r.values()))):
                parts = [(r[c][k] if c in r and k < len(r[c]) else "") for c in used]
                out.append("  ".join(p + " " * (width[c] - _columns(p)) for p, c in zip(parts, used)).rstrip(" "))
        return out


def _closed(html: str) -> str:
    """The page without a comment or tag that never ends."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at + 2) < 0 and html.find("--!>", at + 2) < 0 and _OPEN_COMMENT.match(html, at):
        html = html[:at]
    at = html.rfind("<")
    return html[:at] if at >= 0 and html.find(">", at) < 0 and html[at + 1 : at + 2].isalpha() else html


def render(html: str) -> str:
    """All visible text of a page."""
    builder = TreeBuilder()
    builder.feed(_closed(html))
    builder.close()
    writers, tables, lists = [Writer()], [], []
    pre = 0
    stack: list[tuple[Node | str, bool, bool]] = [(builder.root, False, True)]
    while stack:
        node, leaving, shown = stack.pop()
        w = writers[-1]
        if isinstance(node, str):
            if shown:
                w.verbatim(node) if pre else w.text(node)
            continue
        tag = node.tag
        if not leaving:
            if not displayed(node):
                continue
            shown = visibility(node, shown)
            if tag == "br":
                w.brk()
                continue
            if tag == "input":
                if shown:
                    w.text(node.attrs.get("value") or "")
                continue
            if tag == "wbr":
                continue
            if tag in ("td", "th") and tables:
                writers.append(Writer())
                lists.append(None)
            elif tag == "table":
                w.block(1 if lists and lists[-1] is not None else 2)
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("ul", "ol", "menu", "dir"):
                w.block(1 if any(x is not None for x in lists) else 2)
                lists.append([tag == "ol", _number(node.attrs.get("start"), 1)])
            elif tag == "li":
                w.block(1)
                own = lists[-1] if lists and lists[-1] is not None else [False, 1]
                own[1] = _number(node.attrs.get("value"), own[1])
                bullet = f"{own[1]}. " if own[0] else "- "
                own[1] += 1
                w.bullet = bullet if shown else ""
                w.indent.append(" " * len(bullet))
            elif tag == "blockquote":
                w.block(2)
                w.indent.append("  ")
            elif tag == "dd":
                w.block(1)
                w.indent.append("  ")
            elif tag in ("pre", "textarea", "listing"):
                w.block(2 if tag != "textarea" else 1)
                pre += 1
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
            elif tag in APART:
                w.block(2)
            elif tag in LINES:
                w.block(1)
            stack.append((node, True, shown))
            stack += [(c, False, shown) for c in reversed(node.children)]
            continue
        if tag in ("td", "th") and tables and len(writers) > 1:
            cell = writers.pop().value()
            lists.pop()
            # limits of the HTML standard; a row span of 0 reaches to the end of the table
            wide = min(max(_number(node.attrs.get("colspan"), 1), 1), 1000)
            deep = min(max(_number(node.attrs.get("rowspan"), 1), 0), 65534)
            tables[-1].span = (wide, deep or 65534)
            tables[-1].cell(cell)
        elif tag == "table":
            lines = tables.pop().lines()
            for line in lines:
                w.block(1)
                w.verbatim(line)
            w.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            w.block(1 if any(x is not None for x in lists) else 2)
        elif tag == "li":
            w.indent.pop()
            w.bullet = ""
            w.block(1)
        elif tag == "blockquote":
            w.indent.pop()
            w.block(2)
        elif tag == "dd":
            w.indent.pop()
            w.block(1)
        elif tag in ("pre", "textarea", "listing"):
            pre -= 1
            w.block(2 if tag != "textarea" else 1)
        elif tag in APART:
            w.block(2)
        elif tag in LINES:
            w.block(1)
    return writers[0].value()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id and ``text``, its visible text."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x.as_py()) for x in as_strings(batch.column(1))], pa.string())], names=["id", "text"])

    return text_rows(pages, pages[id_col].alias("id"), pages[html_col].alias("html")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
