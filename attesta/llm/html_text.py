"""HTML extraction: a tree with implied tags, laid out as text.

The builder opens and closes tags that HTML leaves out (paragraphs, list items, table rows and cells); the renderer walks
the tree without recursion and writes what a reader would see: blocks on lines of their own, blank lines around
paragraphs, headings, lists and tables, list marks, preformatted text as it stands, and table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
UNSEEN = frozenset("head title script style template noscript datalist iframe noframes object audio video canvas svg math".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary ul table caption""".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
#: What an opening tag closes if open, and the tags beyond which it does not look.
_CELLS, _ROWS, _PARTS = {"td", "th"}, {"tr"}, {"thead", "tbody", "tfoot"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
          **{t: (_CELLS, {"table"}) for t in _CELLS}, "tr": (_CELLS | _ROWS, {"table"}),
          **{t: (_CELLS | _ROWS | _PARTS | {"caption", "colgroup"}, {"table"}) for t in _PARTS},
          **{t: ({"p"}, {"table", "td", "th", "button", "caption"}) for t in BLOCK - {"li", "dt", "dd", "html", "body", "caption", "legend", "summary"}}}
FENCE = frozenset({"table", "td", "th", "caption", "button", "object", "template"})


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def build_tree(source: str) -> Node:
    """The tree of a page: elements with their children, texts as strings."""
    root = Node("html")
    open_ = Open(root)
    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.match(source, at)
        token, at = found.group(), found.end()
        if token[0] != "<" or token == "<":
            open_.nodes[-1].children.append(html.unescape(token))
        elif token[1] in "!?":
            continue
        elif token[1] == "/":
            _close(open_, _NAME.match(token)[1].lower())
        else:
            tag = _NAME.match(token)[1].lower()
            if tag in ("html", "body"):
                _close(open_, "head")
                continue
            _imply(open_, tag)
            rest = token[len(tag) + 1:].rstrip(">").rstrip("/")
            node = Node(tag, {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip() else None)
            open_.nodes[-1].children.append(node)
            if tag in VOID:
                continue
            if tag in RAW:
                past = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                body = source[at:past.start()]
                node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
                at = past.end()
            else:
                open_.push(node)
    return root


class Open:
    """The open elements, and where those of each name stand among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost of these, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def _close(open_: Open, tag: str) -> None:
    place = open_.last((tag,))
    fenced = tag not in ("table", "tr", "thead", "tbody", "tfoot", "template", "object")
    if place and (not fenced or place >= open_.last(FENCE)):
        open_.cut(place)


def _imply(open_: Open, tag: str) -> None:
    """Close what ``tag`` ends, and open the rows that cells need."""
    if open_.nodes[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
        open_.cut(len(open_.nodes) - 1)
    ends, fence = CLOSES.get(tag, ((), ()))
    while (place := open_.last(ends)) and place > open_.last(t for t in fence if t not in ends):
        open_.cut(place)
        if tag not in ("tr", "tbody", "thead", "tfoot", "optgroup"):
            break
    if tag in _CELLS and open_.nodes[-1].tag in ("table", *_PARTS):
        row = Node("tr")
        open_.nodes[-1].children.append(row)
        open_.push(row)


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden")
                or ("style" in a and _NO_DISPLAY.search(a["style"])))


class Page:
    """Lines being written. ``gap`` line ends are owed before the next text; ``indent`` stands before each line."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space, self.indent, self.mark = [], [], 0, False, "", ""

    def text(self, value: str, keep: bool) -> None:
        if keep:
            for i, part in enumerate(value.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end_line()
                if part:
                    self.put(part)
            return
        words = _SPACE.sub(" ", value)
        if words == " ":
            self.space = self.space or bool(self.line)
        elif words:
            lead = words[0] == " "
            if self.line and (self.space or lead):
                self.line.append(" ")
            self.space = words[-1] == " "
            self.put(words.strip(" "))

    def put(self, value: str) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.line.append(self.indent + self.mark)
            self.mark = " " * len(self.mark) if self.mark else ""
        self.gap = 0
        self.line.append(value)

    def end_line(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        if self.line:
            self.end_line()
        self.space = False
        self.gap = max(self.gap, 2 if spaced else 1)

    def done(self) -> list[str]:
        if self.line:
            self.end_line()
        return self.lines


def aligned(rows: list[list[list[str]]]) -> list[str]:
    """Cells (lists of lines) in columns: each as wide as its widest line, two spaces apart."""
    widths = [max((len(line) for row in rows if i < len(row) for line in row[i]), default=0) for i in range(max(map(len, rows), default=0))]
    out = []
    for row in rows:
        for k in range(max((len(cell) for cell in row), default=0)):
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(row)).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    pages, tables, lists, pre = [Page()], [], [], 0
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if not (tables and tables[-1]["page"] == len(pages)):  # text between cells stands in none
                page.text(node, pre > 0)
            elif node.strip():
                tables[-1]["loose"].append(node)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            if tag == "br":
                page.end_line() if page.line else page.lines.append("") if page.lines and not page.gap else None
                page.space = False
                continue
            if tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag == "hr":
                page.put("---")
                page.block(True)
                continue
            if tag == "input":
                page.text(node.attributes.get("value", ""), False)
                continue
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                lists.append([tag, int(start) if start.lstrip("-").isdigit() else 1, page.indent])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, page.indent]
                page.indent = kind[2] + "  " * (len(lists) > 1)
                page.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                if lists:
                    todo.append((node, True))
                    todo.extend((c, False) for c in reversed(node.children))
                    continue
            elif tag in ("blockquote", "dd"):
                page.indent += "  "
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append({"rows": [], "page": len(pages), "loose": [], "lists": lists, "pre": pre})
                lists, pre = [], 0
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in _CELLS | {"caption"} and tables:
                pages.append(Page())
            elif tag in ("td", "th", "tr", "option"):
                page.block(False)
            todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children))
            continue
        if tag in ("ul", "ol", "menu") and lists:
            page.block(len(lists) == 1)
            page.indent = lists.pop()[2]
            page.mark = ""
        elif tag == "li":
            page.block(False)
            page.mark = ""
            if lists:
                page.indent = lists[-1][2]
        elif tag in ("blockquote", "dd"):
            page.block(tag in SPACED)
            page.indent = page.indent[:-2]
        elif tag == "pre":
            pre -= 1
            page.block(True)
        elif tag in _CELLS | {"caption"} and tables and len(pages) > tables[-1]["page"]:
            lines = pages.pop().done()
            if tag == "caption":
                tables[-1]["caption"] = lines
            else:
                tables[-1]["rows"] or tables[-1]["rows"].append([])
                tables[-1]["rows"][-1].append(lines)
        elif tag == "table" and tables:
            table = tables.pop()
            lists, pre = table["lists"], table["pre"]
            for line in [_SPACE.sub(" ", x).strip() for x in table["loose"]] + table.get("caption", []) + aligned([r for r in table["rows"] if r]):
                page.put(line)
                page.end_line()
            page.block(True)
        elif tag in BLOCK:
            page.block(tag in SPACED)
        elif tag == "option":
            page.block(False)
    return "\n".join(pages[0].done()).strip("\n")


def page_text(source: str | None) -> str | None:
    return None if source is None else render(build_tree(source))


def extract_text(pages: DataFrame, markup: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``markup`` as ``into`` (replaced if there). Null stays null; an empty page, or one
    without visible text, gives an empty text. Rows are independent: nothing is shuffled."""
    @F.pandas_udf("string")
    def shown(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in sources:
            yield series.map(page_text)
    return pages.withColumn(into, shown(F.col(markup)))
