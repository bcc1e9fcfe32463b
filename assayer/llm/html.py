"""HTML to text as a browser would lay it out.

A tree builder supplies the tags that HTML lets authors leave out, visibility rules drop
what is not rendered, and a renderer keeps block spacing, list markers and table columns.
Every visible character of the text is emitted.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import lean, small_batches

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
UNSEEN = frozenset("head title script style noscript template iframe noembed noframes object audio video canvas datalist map".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp tr td th thead tbody tfoot caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt".split())
#: A start tag ends these open elements, up to the nearest of the bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}), "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
HEAD_ONLY = frozenset("base basefont bgsound link meta title script style noscript template head html".split())
SCOPE = frozenset("table td th caption button object html".split())

#: Where a tag that never ends makes the search for its end fail, the rest of the page is read by this pattern, which keeps tags short.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"<]*"|'[^'<]*'|[^<>"'])*+)>|<!--(?:-?>|(.*?)(?:--!?>|\Z))|<[!?/][^>]*>|([^<]+)|<""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The end of a tag, or an attribute; a quote opens a value only after the equals sign, and an open one at the end of input sets the last group.
STEP = re.compile(r"""([\s/]*+)(?:(>)|(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"([^"]*+)(?:"|(\Z))|'([^']*+)(?:'|(\Z))|([^\s>"'][^\s>]*+|(?=>)|\Z)))?)""")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "lines", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.lines: list[str] = []  # of a table, once it is rendered


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


def _tag_end(source: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes, whether a slash ends them, and the end of the tag whose name ends at ``at``; None if the input ends before."""
    if source.startswith(">", at):
        return {}, False, at + 1
    out: dict[str, str] = {}
    while m := STEP.match(source, at):
        at = m.end()
        if m[2]:
            return out, m[1].endswith("/"), at
        if m[5] is not None or m[7] is not None:
            return None
        value = m[4] or m[6] or m[8] or ""
        out.setdefault(m[3].lower(), html.unescape(value) if "&" in value else value)
    return None


class Builder:
    """Builds the tree of a document; open elements are a chain of parents, so depth costs no recursion."""

    def __init__(self) -> None:
        self.root = self.at = Node("html", {}, None)
        self.open = {"html": 1}

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        self.at = node
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.at.tag
        self.open[tag] -= 1
        self.at = self.at.parent or self.root
        return tag

    def close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> bool:
        """Closes the innermost open element of ``tags`` that no bound hides, with all inside it."""
        if not any(self.open.get(t) for t in tags):
            return False
        node = self.at
        while node.parent is not None and node.tag not in tags and node.tag not in bounds:
            node = node.parent
        if node.tag not in tags or node.parent is None:
            return False
        while self.at is not node:
            self.pop()
        self.pop()
        return True

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag in ("html", "body") and (tag == "html" or self.open.get("body")):
            return
        if self.open.get("head") and tag not in HEAD_ONLY:
            self.close({"head"}, set())
        if tag in CLOSES_P:
            self.close({"p"}, SCOPE)
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            while self.close(ends, bounds):
                pass
        if tag in ("td", "th") and self.open.get("table") and self.at.tag in ("table", "thead", "tbody", "tfoot"):
            self.push("tr", {})
        if tag in VOID:
            self.at.children.append(Node(tag, attrs, self.at))
        else:
            self.push(tag, attrs)
            if empty and (self.open.get("svg") or self.open.get("math")):
                self.pop()

    def end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "br":
            self.at.children.append(Node("br", {}, self.at))
        elif tag == "p" and not self.close({"p"}, SCOPE):
            self.at.children.append(Node("p", {}, self.at))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.close({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPE)
        elif tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"):
            self.close({tag}, {"table"} - {tag})
        elif tag == "li":
            self.close({"li"}, {"ul", "ol", "menu", "dir"})
        elif tag != "p":
            self.close({tag}, SCOPE - {tag})

    def text(self, text: str) -> None:
        if self.open.get("head") and self.at.tag in ("head", "html") and not text.isspace():
            self.close({"head"}, set())
        self.at.children.append(text)


def build(source: str) -> Node:
    b, at, n = Builder(), 0, len(source)
    raw_ends: dict[str, re.Pattern] = {}
    endless = False
    while at < n:
        m = None if endless else OPEN.match(source, at)
        got = _tag_end(source, m.end()) if m else None
        endless |= bool(m) and got is None
        if got is None:
            m = TAG.match(source, at)
            at = m.end()
        if m[2]:
            tag = m[2].lower()
            if got is None:
                got = _attrs(m[3]) if m[3].strip(" \t\n\r\f/") else {}, m[3].endswith("/"), at
            attrs, empty, at = got
            if m[1]:
                b.end(tag)
                continue
            b.start(tag, attrs, empty)
            if tag in RAW and b.at.tag == tag:
                closing = raw_ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I))
                end = closing.search(source, at)
                body = source[at : end.start() if end else n]
                if tag == "textarea":
                    b.at.children.append(html.unescape(body))
                elif tag == "xmp":
                    b.at.children.append(body)
                b.pop()
                at = end.end() if end else n
            elif tag == "plaintext":
                b.text(source[at:])
                break
        elif m[5]:
            b.text(html.unescape(m[5]) if "&" in m[5] else m[5])
        elif m[0] == "<":
            b.text("<")
    return b.root


def _style(node: Node, name: str) -> str:
    found = re.findall(rf"(?:^|;)\s*{name}\s*:\s*([a-z-]+)", node.attrs.get("style", "").lower())
    return found[-1] if found else ""


def hidden(node: Node) -> bool:
    """Whether an element and all inside it has no box."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a or node.tag == "input" or not a:
        return node.tag in UNSEEN or node.tag in ("dialog", "input")
    return "hidden" in a and a["hidden"].lower() != "until-found" or _style(node, "display") == "none"


def _marker(node: Node, n: int) -> str:
    kind = (node.parent.attrs.get("type", "1") if node.parent else "1") or "1"
    if kind in "aA" and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
        return (s if kind == "a" else s.upper()) + ". "
    if kind in "iI" and 0 < n < 4000:
        s = ""
        for v, r in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            s, n = s + r * (n // v), n % v
        return (s if kind == "i" else s.upper()) + ". "
    return f"{n}. "


def _int(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", value) else default


def width(text: str) -> int:
    """Columns a line takes: wide characters two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Sheet:
    """Lines of text under construction: collapses white space and merges the gaps between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.mark = ""

    def add(self, text: str, keep: bool) -> None:
        if keep:
            parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.line(force=True)
                if part:
                    self._begin()
                    self.now.append(part)
            return
        words = SPACE.split(text)
        if len(words) == 1 and not words[0]:
            return
        self.space |= not words[0] and bool(self.now)
        body = " ".join(w for w in words if w)
        if body:
            self._begin()
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(body)
            self.space = False
        self.space |= not words[-1] and bool(self.now)

    def _begin(self) -> None:
        if not self.now:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            if self.mark:
                self.now.append(self.mark)
                self.mark = ""

    def line(self, gap: int = 0, force: bool = False) -> None:
        if self.now or force:
            if not self.now:
                self._begin()
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def take(self, lines: list[str]) -> None:
        """Whole lines of an inner block."""
        self.line()
        if lines:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.extend(lines)


def _cells(table: Node) -> tuple[list[str], list[list[tuple[list[str], int, str, int]]]]:
    """Lines of captions and of what stands outside cells, and the rows of (lines, columns, alignment, rows)."""
    outside, rows, late = [], [], []
    stack = [(c, False) for c in reversed(table.children)]
    while stack:
        c, foot = stack.pop()
        if isinstance(c, str):
            if c.strip():
                outside.append(SPACE.sub(" ", c).strip())
        elif hidden(c):
            continue
        elif c.tag == "tr":
            row = [(render_lines(d), max(1, min(1000, _int(d.attrs.get("colspan"), 1))), (d.attrs.get("align") or _style(d, "text-align")).lower(), min(65534, _int(d.attrs.get("rowspan"), 1)) or 65534) for d in c.children if isinstance(d, Node) and d.tag in ("td", "th") and not hidden(d)]
            stray = Node("div", {}, None)
            stray.children = [d for d in c.children if isinstance(d, str) or d.tag not in ("td", "th")]
            outside += render_lines(stray)
            if row:
                (late if foot else rows).append(row)
        elif c.tag in ("thead", "tbody", "tfoot"):
            stack += [(d, foot or c.tag == "tfoot") for d in reversed(c.children)]
        else:
            outside += render_lines(c)
    return outside, rows + late


def _placed(rows: list[list[tuple[list[str], int, str, int]]]) -> list[list[tuple[int, list[str], int, str]]]:
    """(first column, lines, columns, alignment) of each row's cells, which pass over columns that cells from above still fill."""
    out, taken = [], {}
    for row in rows:
        at, here, fresh = 0, [], {}
        for lines, span, align, deep in row:
            while taken.get(at):
                at += 1
            here.append((at, lines, span, align))
            if deep > 1:
                fresh |= dict.fromkeys(range(at, at + span), deep)
            at += span
        taken = {c: n - 1 for c, n in (taken | fresh).items() if n > 1}
        out.append(here)
    return out


def table_lines(table: Node, widest: int = 48) -> list[str]:
    """Rows with columns aligned by padding up to ``widest``; a wider cell is written whole and shifts its row."""
    out, rows = _cells(table)
    placed = _placed(rows)
    sizes: dict[int, int] = {}
    for row in placed:
        for at, lines, span, _ in row:
            if span == 1:
                sizes[at] = max(sizes.get(at, 0), min(widest, max(map(width, lines), default=0)))
    room = lambda at, span: min(sum(sizes.get(i, 0) for i in range(at, at + span)) + 3 * (span - 1), 4 * widest)
    for row in placed:
        for k in range(max((len(lines) for _, lines, _, _ in row), default=0) or 1):
            end, parts = 0, []
            for at, lines, span, align in row:
                if at > end:
                    parts.append(" " * room(end, at - end))
                text = lines[k] if k < len(lines) else ""
                left = max(0, room(at, span) - width(text))
                parts.append(" " * left + text if align == "right" else " " * (left // 2) + text + " " * (left - left // 2) if align == "center" else text + " " * left)
                end = at + span
            out.append(" | ".join(parts).rstrip())
    return out


def render_tables(root: Node) -> None:
    """Renders all tables below ``root``, inner ones before those that hold them, so that nesting costs no recursion."""
    tables, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "table":
            tables.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for table in reversed(tables):
        table.lines = table_lines(table)


def render_lines(root: Node) -> list[str]:
    """The visible text below ``root``, whose tables are rendered, in lines; an explicit stack, so that depth costs no recursion."""
    sheet = Sheet()
    # (node or text or a call to make afterwards, white space kept, drawn)
    stack: list[tuple] = [(c, False, True, 0) for c in reversed(root.children)]
    while stack:
        c, keep, drawn, deep = stack.pop()
        if callable(c):
            c()
            continue
        if isinstance(c, str):
            if drawn:
                sheet.add(c, keep)
            continue
        if hidden(c):
            continue
        tag = c.tag
        if c.attrs.get("style"):
            see = _style(c, "visibility")
            drawn = {"hidden": False, "collapse": False, "visible": True}.get(see, drawn)
            keep = {"pre": True, "pre-wrap": True, "pre-line": keep, "normal": False, "nowrap": False}.get(_style(c, "white-space"), keep)
        if tag == "br":
            sheet.line(force=True)
            continue
        if tag == "wbr" or tag in VOID and tag != "hr":
            continue
        if tag == "table":
            if drawn:
                sheet.line(1)
                sheet.take([("  " * deep + x).rstrip() if x else x for x in c.lines])
            sheet.line(1)
            continue
        shown = _style(c, "display") if c.attrs.get("style") else ""
        block = (tag in BLOCK or shown in ("block", "flex", "grid", "list-item", "table")) and not shown.startswith("inline")
        keep = keep or tag in ("pre", "textarea", "xmp")
        children = c.children
        if tag == "details" and "open" not in c.attrs:
            children = [d for d in children if isinstance(d, Node) and d.tag == "summary"][:1]
        if block:
            gap = int(tag in SPACED and not (tag in ("ul", "ol", "menu") and deep))
            sheet.line(gap)
            inner = deep + (tag in ("ul", "ol", "menu", "dir"))
            if tag == "li":
                owner = c.parent if c.parent is not None and c.parent.tag in ("ol", "ul", "menu", "dir") else None
                mark = "- "
                if owner is not None and owner.tag == "ol":
                    count = int(owner.attrs.get("\0n", _int(owner.attrs.get("start"), 1) - 1)) + 1
                    count = _int(c.attrs.get("value"), count)
                    owner.attrs["\0n"] = str(count)
                    mark = _marker(c, count)
                sheet.mark = "  " * max(0, deep - 1) + mark
            elif tag == "dd":
                sheet.mark = "  "
            elif tag == "blockquote":
                sheet.mark = "> "
            if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]

            def after(gap=gap) -> None:
                sheet.line(gap)
                sheet.mark = ""

            stack.append((after, False, True, 0))
            deep = inner
        elif tag in ("td", "th", "option", "q"):
            sheet.space = bool(sheet.now)
        stack += [(d, keep, drawn, deep) for d in reversed(children)]
    sheet.line()
    return sheet.lines


def extract(source: str | None) -> str | None:
    """Visible text of a page; null stays null."""
    if source is None:
        return None
    root = build(source)
    render_tables(root)
    lines = [x.rstrip() for x in render_lines(root)]
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([None if t is None else t.count("\n") + bool(t) for t in texts], pa.int64())],
            names=["page_id", "text", "n_chars", "n_lines"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars and n_lines of every row, in one pass without a shuffle.

    A null html gives nulls, an empty one or one without visible text an empty text.
    Repeated rows and null ids are kept, other columns are not carried, an empty table
    gives an empty table.
    """
    lean(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, text string, n_chars long, n_lines long")
