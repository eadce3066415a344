"""Layout-aware text of HTML pages.

A tree builder with implied tags feeds a renderer that emits all visible text: blocks on lines of
their own, paragraphs apart, lists with marks, table cells in aligned columns. Spark maps it over
the pages; no shuffle, and memory follows the longest page.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset(("head script style template noscript noembed noframes iframe svg math object audio video canvas "
                    "datalist area base link meta param source track title").split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
                   "option p pre search section summary table ul tr td th thead tbody tfoot caption").split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                      "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul").split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: An opening tag ends open elements of these names, looked for up to an element of the limits.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("td", "th", "tr", "caption"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("td", "th", "tr", "caption", "thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("td", "th", "tr", "caption", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("td", "th", "tr", "caption", "thead", "tbody", "tfoot"), ("table",)),
}
#: Closing tags do not reach beyond these unless they name them.
WALLS = frozenset("table td th caption html template".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_MAYBE_UNSEEN = re.compile(r"hidden|style", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_START = re.compile(r"\d+")


class Node:
    """An element: name, attributes that matter, children (nodes and texts)."""

    __slots__ = ("name", "start", "hidden", "children", "parent")

    def __init__(self, name: str, parent: Node | None = None, hidden: bool = False, start: int = 1):
        self.name, self.parent, self.hidden, self.start, self.children = name, parent, hidden, start, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        value = value[1:-1] if value[:1] in ('"', "'") else value
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def build(page: str) -> Node:
    """The tree of a page. Never fails: unknown closing tags are skipped, open elements end with the page."""
    root = Node("#root")
    at, here, n = root, 0, len(page)
    depth: dict[str, int] = {}  # open elements by name

    def close(node: Node) -> Node:
        nonlocal at
        while at is not node:
            depth[at.name] -= 1
            at = at.parent
        depth[node.name] -= 1
        at = node.parent
        return at

    def text(value: str) -> None:
        if value:
            at.children.append(html.unescape(value) if "&" in value else value)

    while here < n:
        match = _TOKEN.search(page, here)
        if match is None:
            text(page[here:])
            break
        text(page[here:match.start()])
        here = match.end()
        closing, name, rest = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "p" and not depth.get("p"):
                at.children.append(Node("p", at))
            elif name == "br":
                at.children.append(Node("br", at))
            elif depth.get(name):
                node = at
                while node.name != name and (node.name not in WALLS or name in WALLS or name in ("tr", "thead", "tbody", "tfoot", "body")):
                    node = node.parent
                    if node is root:
                        break
                if node.name == name:
                    close(node)
            continue
        if depth.get("head") and name not in HEAD_ONLY and at.name == "head":
            close(at)
        if name in CLOSES_P and depth.get("p"):
            node = at
            while node.name not in ("p", "#root") and node.name not in WALLS:
                node = node.parent
            if node.name == "p":
                close(node)
        if name in IMPLIED:
            ends, limits = IMPLIED[name]
            node, last = at, None
            while node is not root and node.name not in limits:
                if node.name in ends:
                    last = node
                node = node.parent
            # A cell without a row, or a row whose own table began further in, stays where it is.
            if last is not None:
                close(last)
        hidden = name in HIDDEN
        start = 1
        if rest and not hidden and (name in ("ol", "input", "details") or _MAYBE_UNSEEN.search(rest)):
            attributes = _attributes(rest)
            hidden = "hidden" in attributes or bool(_UNSEEN.search(attributes.get("style", "")))
            if name == "ol" and _START.fullmatch(attributes.get("start", "")):
                start = int(attributes["start"][:9])
        node = Node(name, at, hidden, start)
        at.children.append(node)
        if name in VOID or rest.endswith("/") and name in ("svg", "path", "math"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, here)
            body = page[here:end.start() if end else n]
            if name in ("textarea", "title"):
                body = html.unescape(body)
            if name in ("textarea", "xmp", "plaintext"):
                node.children.append(body)
            here = end.end() if end else n
            continue
        depth[name] = depth.get(name, 0) + 1
        at = node
    return root


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Collects lines: inline text is joined with single spaces, blocks begin new lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # an empty line is due before the next text
        self.space = False

    def inline(self, text: str) -> None:
        for k, part in enumerate(_SPACES.split(text)):
            if k:
                self.space = True
            if part:
                if self.space and self.now:
                    self.now.append(" ")
                self.now.append(part)
                self.space = False

    def line(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(text)

    def flush(self) -> None:
        if self.now:
            self.line("".join(self.now))
            self.now = []
        self.space = False

    def block(self, apart: bool) -> None:
        self.flush()
        self.gap = self.gap or apart


def _table(node: Node) -> list[str]:
    """Rows of aligned cells; captions come first."""
    captions: list[str] = []
    rows: list[list[list[str]]] = []

    def walk(part: Node) -> None:
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    captions.append(_SPACES.sub(" ", child).strip())
            elif child.hidden:
                continue
            elif child.name == "tr":
                rows.append([render(cell) for cell in child.children if isinstance(cell, Node) and not cell.hidden]
                            + [[x] for x in (c.strip() for c in child.children if isinstance(c, str)) if x])
            elif child.name in ("thead", "tbody", "tfoot"):
                walk(child)
            elif child.name in ("td", "th"):
                rows.append([render(child)])
            else:
                captions.extend(render(child))

    walk(node)
    columns = max((len(r) for r in rows), default=0)
    widths = [max((width(x) for r in rows if k < len(r) for x in r[k]), default=0) for k in range(columns)]
    lines = list(captions)
    for row in rows:
        for i in range(max((len(cell) for cell in row), default=0)):
            cells = [cell[i] if i < len(cell) else "" for cell in row]
            line = "  ".join(x + " " * (widths[k] - width(x)) for k, x in enumerate(cells)).rstrip()
            if line:
                lines.append(line)
    return lines


def render(root: Node) -> list[str]:
    """Lines of the visible text of a tree. Iterative but for nested lists, tables and quotes."""
    out = _Lines()
    stack: list[tuple] = [("open", c) for c in reversed(root.children)]
    marks: list[tuple[str, int]] = [(root.name, root.start)]
    while stack:
        what, node = stack.pop()
        if what == "text":
            out.inline(node)
        elif what == "close":
            out.block(node.name in APART)
            if node.name in ("ul", "ol", "menu", "dir"):
                marks.pop()
        elif isinstance(node, str):
            out.inline(node)
        elif node.hidden:
            continue
        elif node.name == "br":
            if out.now:
                out.flush()
            else:
                out.gap = True
        elif node.name == "hr":
            out.block(True)
        elif node.name == "wbr":
            continue
        elif node.name == "pre":
            out.block(True)
            for line in _plain(node).strip("\n").split("\n"):
                out.line(line.rstrip())
            out.gap = True
        elif node.name == "table" and node.parent is not None:
            out.block(True)
            for line in _table(node) if _depth(node) < 20 else render(node):
                out.line(line)
            out.gap = True
        elif node.name in ("li", "blockquote") and _depth(node) < 60:
            out.block(node.name == "blockquote")
            lines = render(node)
            if node.name == "li":
                kind, number = marks[-1]
                mark = f"{number}. " if kind == "ol" else "- "
                marks[-1] = (kind, number + 1)
                lines = [(mark if k == 0 else " " * len(mark) if line else "") + line for k, line in enumerate(lines)]
            else:
                lines = [f"> {line}".rstrip() for line in lines]
            for line in lines:
                out.line(line)
            out.gap = out.gap or node.name == "blockquote"
        elif node.name in BLOCK:
            out.block(node.name in APART)
            if node.name in ("ul", "ol", "menu", "dir"):
                marks.append((node.name, node.start))
            stack.append(("close", node))
            stack.extend(("open", c) for c in reversed(node.children))
        else:
            if node.name == "img":
                continue
            stack.extend(("open", c) for c in reversed(node.children))
    out.flush()
    return out.lines


def _depth(node: Node) -> int:
    """How many lists, quotes and tables an element stands in (each is a call of its own)."""
    n = 0
    while node.parent is not None:
        node = node.parent
        n += node.name in ("li", "blockquote", "table")
    return n


def _plain(node: Node) -> str:
    """Visible text of an element with its white space."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        now = stack.pop()
        if isinstance(now, str):
            parts.append(now)
        elif now.name == "br":
            parts.append("\n")
        elif not now.hidden:
            stack.extend(reversed(now.children))
    return "".join(parts)


def text_of(page: str | None) -> str | None:
    """All visible text of a page; null stays null, an empty page gives the empty text."""
    return None if page is None else "\n".join(render(build(page)))


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """Add the rendered text to every row.

    Null html gives null, empty html the empty text; repeated rows are rendered alike; other columns
    pass through, one called like the result is replaced. Pages that are not HTML are their text.
    """
    if name != column:
        pages = pages.drop(name)
    at = pages.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = pa.array([text_of(x) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, name])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(name, StringType())]))
