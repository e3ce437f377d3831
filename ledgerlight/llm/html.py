"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied end tags make a tree of elements; visibility rules drop what a browser does
not show; a renderer lays out the rest as text: blocks on lines of their own, blank lines where blocks have margins, list
markers with nesting, preformatted text as it stands, and table cells aligned in columns.

A page is rendered by itself in one pass over its source, so the operator is a map without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import named, row_and, small_batches, table

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*)(?:>|\Z))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

# Element names by their role in HTML.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes noscript xmp".split())
ESCAPABLE = frozenset("title textarea".split())
NEVER_SHOWN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas map svg math rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre listing xmp table figure fieldset hr menu dir".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav optgroup option search section summary caption tr".split())
CLOSES_P = BLOCK - frozenset("html body caption tr option optgroup legend".split())
PARTS_OF_TABLE = frozenset("caption colgroup thead tbody tfoot tr td th".split())
#: An opening tag ends an open element of the second set, unless one of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}),
} | {x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot", "caption", "colgroup")}
P_BARRIERS = frozenset("table td th caption button object html".split())
MAX_DEPTH = 200  # elements nested deeper become children of the one at this depth
WIDEST = 60  # a column is padded to its widest cell up to this


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(source: str) -> Node:
    """The tree of a page's elements; text stands in it as strings with character references replaced."""
    root = Node("html", {})
    stack, at, end = [root], 0, len(source)

    def close(down_to: int) -> None:
        del stack[down_to:]

    def find(tags, barriers) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in barriers:
                return 0
        return 0

    while at < end:
        m = TAG.search(source, at)
        start = m.start() if m else end
        if start > at:
            stack[-1].children.append(unescape(source[at:start]))
        if not m:
            break
        at = m.end()
        closing, tag = m[1], m[2]
        if closing:
            tag = closing.lower()
            if tag == "p" and not find({"p"}, P_BARRIERS):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif i := find({tag}, () if tag in PARTS_OF_TABLE or tag in ("table", "body") else {"table", "td", "th"} if tag not in BLOCK else {"td", "th"}):
                close(i)
        elif tag:
            tag, attrs = tag.lower(), attributes(m[3]) if m[3] else {}
            if tag in ("html", "body") and (tag == "html" or any(x.tag == "body" for x in stack)):
                stack[0].attrs |= {k: v for k, v in attrs.items() if k not in stack[0].attrs}
                continue
            if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
                close(len(stack) - 1)
            if tag in CLOSES_P and (i := find({"p"}, P_BARRIERS)):
                close(i)
            if tag in IMPLIED:
                while i := find(*IMPLIED[tag]):
                    close(i)
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in RAW or tag in ESCAPABLE or tag == "plaintext":
                stop = None if tag == "plaintext" else re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                body = source[at: stop.start() if stop else end]
                node.children.append(unescape(body) if tag in ESCAPABLE else body)
                at = stop.end() if stop else end
            elif tag not in VOID and not (m[0].endswith("/>") and tag in ("svg", "math", "path")) and len(stack) < MAX_DEPTH:
                stack.append(node)
    return root


class Page:
    """Lines of laid-out text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line breaks owed before the next text
        self.indent, self.marker = "", ""
        self.open_space = True  # white space at hand would be dropped

    def write(self, text: str) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent + self.marker)
            self.indent += " " * len(self.marker)
            self.marker = ""
        self.line.append(text)

    def text(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if self.open_space:
            text = text.removeprefix(" ")
        if text:
            self.write(text)
            self.open_space = text.endswith(" ")

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.open_space = True

    def newline(self) -> None:
        """As for <br>: an empty line too, if nothing stands on it."""
        if self.line:
            self.end_line()
        elif self.lines and self.gap < 2:
            self.gap = 2

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def exact(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self.write(first)
        for x in rest:
            if not self.line:
                self.write("")
            self.end_line()
            if x:
                self.write(x)
        self.open_space = False

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def hidden(node: Node) -> bool:
    style = node.attrs.get("style")
    return (
        node.tag in NEVER_SHOWN or "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found" or bool(style and HIDING.search(style))
        or node.tag == "dialog" and "open" not in node.attrs
    )


def render(node: Node, page: Page, shown: bool = True, exact: bool = False) -> None:
    """shown: CSS visibility, which is inherited and can be set anew below."""
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if shown and not closed:
                page.exact(child) if exact else page.text(child)
            continue
        tag = child.tag
        if hidden(child) or closed and tag != "summary":
            continue
        style = child.attrs.get("style")
        said = VISIBILITY.search(style) if style else None
        visible = said[1].lower() == "visible" if said else shown
        if tag == "br":
            if visible:
                page.newline()
        elif tag == "table":
            page.block(2)
            before = page.indent
            for line in table_lines(child, visible):
                page.write(line)
                page.end_line()
            page.indent = before
            page.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = node.tag == "li"
            page.block(1 if nested else 2)
            render_list(child, page, visible)
            page.block(1 if nested else 2)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            page.block(gap)
            before = page.indent
            if tag == "blockquote":
                page.indent += "> "
            elif tag == "dd":
                page.indent += "    "
            render(child, page, visible, exact or tag in ("pre", "listing", "xmp"))
            page.block(gap)
            page.indent = before
        else:
            render(child, page, visible, exact or tag == "textarea")


def render_list(node: Node, page: Page, shown: bool) -> None:
    start = node.attrs.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li" and not hidden(child):
            if re.fullmatch(r"-?\d{1,9}", value := child.attrs.get("value", "")):
                number = int(value)
            before, waiting = page.indent, page.marker
            page.block(1)
            page.marker = waiting + (f"{number}. " if node.tag == "ol" else "- ")
            number += 1
            held = Node("li", child.attrs)
            held.children = child.children
            render(held, page, shown)
            page.block(1)
            page.indent, page.marker = before, ""
        else:
            held = Node(node.tag, {})
            held.children = [child]
            render(held, page, shown)


def table_lines(node: Node, shown: bool) -> Iterator[str]:
    """Captions and rows in order, each cell padded to its column's width."""
    rows: list[list[list[str]] | list[str]] = []
    captions: dict[int, list[str]] = {}

    def gather(parent: Node) -> None:
        loose: list = []
        for child in parent.children:
            if isinstance(child, str) or child.tag not in PARTS_OF_TABLE:
                loose.append(child)
            elif hidden(child):
                continue
            elif child.tag in ("td", "th"):
                rows.append(cells([child]))
            elif child.tag == "tr":
                rows.append(cells(child.children))
            elif child.tag == "caption":
                captions.setdefault(len(rows), []).extend(cell(child))
            else:
                gather(child)
        held = Node("div", {})
        held.children = loose
        if any(not isinstance(x, str) or x.strip() for x in loose):
            captions.setdefault(len(rows), []).extend(cell(held))

    def cell(child: Node) -> list[str]:
        page = Page()
        style = child.attrs.get("style")
        said = VISIBILITY.search(style) if style else None
        render(child, page, said[1].lower() == "visible" if said else shown)
        return page.done()

    def cells(children: list) -> list[list[str]]:
        out: list[list[str]] = []
        for child in children:
            if isinstance(child, Node) and not hidden(child):
                out.append(cell(child) if child.tag in ("td", "th") else cell(_held(child)))
                span = child.attrs.get("colspan", "1")
                out += [[]] * (min(int(span), 1000) - 1 if re.fullmatch(r"\d{1,9}", span) else 0)
            elif isinstance(child, str) and child.strip():
                out.append(SPACE.sub(" ", child.strip()).split("\n"))
        return out

    gather(node)
    widths: dict[int, int] = {}
    for row in rows:
        for i, lines in enumerate(row):
            for line in lines:
                if len(line) <= WIDEST:
                    widths[i] = max(widths.get(i, 0), len(line))
    for r, row in enumerate(rows):
        yield from captions.get(r, ())
        for k in range(max([len(x) for x in row], default=0)):
            line = "  ".join((x[k] if k < len(x) else "").ljust(widths.get(i, 0)) for i, x in enumerate(row)).rstrip(" ")
            yield line
    yield from captions.get(len(rows), ())


def _held(child: Node) -> Node:
    out = Node("td", {})
    out.children = [child]
    return out


def html_text(source: str) -> str:
    page = Page()
    render(parse(source), page)
    return "\n".join(page.done())


def extract_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but html, and text (a column of that name is replaced).

    Null html gives null text, empty html and pages without visible text an empty one; broken markup is read as browsers
    do as far as implied and missing tags go, and never fails. Repeated rows are rendered each; nothing is truncated.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "text")]
    packed = pages.select(F.struct(*named(kept)).alias("row") if kept else F.struct(F.lit(0).alias("_")).alias("row"), F.col(html).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else html_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    return packed.mapInArrow(extract, row_and(packed, "text string")).select(*(F.col("row")[c].alias(c) for c in kept), "text")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_html() of all pages."""
    return extract_html(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))
