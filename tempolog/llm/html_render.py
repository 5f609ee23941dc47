"""HTML extraction by layout-aware rendering.

A tree builder reads the tags, opens and closes what HTML implies (a p ends before a block, an li before the next li, a
cell or row before the next one, a row opens before a cell), and puts before a table what may not stand between its rows and
cells. What isn't shown is left out: head matter, scripts, styles, templates, and elements hidden by the hidden attribute or
inline style, and what a closed details element doesn't show; what is visible inside an invisible element is kept, and
aria-hidden hides nothing on screen. Of svg the texts are shown, of math all but annotations. A renderer then writes all visible text: blocks on lines of their own, paragraphs and
headings apart, list items with bullets or numbers by depth, preformatted text as it is, and table cells in columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import arrow_slices, small_batches

#: An attribute: its name, and a value that is quoted as a whole or not at all; quotes inside an unquoted one are part of it.
_VALUE = r"""(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s"'>][^\s>]*+))?)?+"""
_ATTR = re.compile(rf"(=?[^\s/>=]++){_VALUE}", re.S)
_PARTS_OF_TAG = _VALUE.replace("(", "(?:").replace("(?:?:", "(?:")
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++{_PARTS_OF_TAG}|=)*+)(?:>|\Z)""", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head title script style template noscript iframe object canvas audio video datalist noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
#: Blocks with an empty line before and after them.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr".split())
_LISTS = frozenset("ul ol menu dir".split())
#: tag: (open elements that it ends, elements beyond which it doesn't look)
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    **{t: (frozenset("tr td th caption colgroup thead tbody tfoot".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}
_SECTIONS = frozenset("thead tbody tfoot".split())
#: Where a table takes only its own parts; all else goes before the table.
_GRID = _SECTIONS | {"table", "tr"}
_PARTS = _SECTIONS | frozenset("caption colgroup col tr td th script style template".split())
#: table part: open elements that it may stand in.
_HOMES = {**dict.fromkeys(("td", "th"), frozenset(["tr"])), "tr": _SECTIONS | {"table"}, "col": frozenset(["colgroup", "table"]), **dict.fromkeys(("caption", "colgroup", *_SECTIONS), frozenset(["table"]))}
_FOREIGN = frozenset(["svg", "math"])
#: Elements of svg and math that hold HTML again.
_INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: HTML that ends an svg or math left open.
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_SVG_HIDDEN = frozenset("defs symbol title desc metadata clippath mask pattern marker lineargradient radialgradient filter style script".split())
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
_CLOSES_P = (BLOCKS | {"table"}) - {"option", "optgroup", "body", "html"}
_BARRIER = frozenset("table td th caption button object template foreignobject annotation-xml html body".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    return tag in HIDDEN or "hidden" in attrs or tag == "input" or tag == "dialog" and "open" not in attrs or bool(_HIDING.search(attrs.get("style", "")))


def _shown(node: Node, inherited: bool) -> bool:
    """Whether a node's own text is visible: children may be visible where their parent isn't."""
    found = _VISIBILITY.findall(node.attrs.get("style", ""))
    word = found[-1].lower() if found else ""
    return False if word in ("hidden", "collapse") else True if word in ("visible", "initial") else inherited


def build(source: str) -> Node:
    root = Node("html", {})
    stack = [root]
    at = 0
    foreign = re.search("<(?:svg|math)", source, re.I) is not None

    def end(tags, beyond) -> None:
        i = len(stack) - 1
        while i > 0 and stack[i].tag not in beyond:
            if stack[i].tag in tags:
                del stack[i:]
            i -= 1

    def put(kid: Node | str) -> None:
        """Appends to the open element or, where a table doesn't take it, before the table."""
        part = not kid.strip() if isinstance(kid, str) else kid.tag in _PARTS
        if stack[-1].tag == "colgroup" and not part and stack[-2].tag == "table":
            stack.pop()
        if stack[-1].tag in _GRID and not part:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "table":
                    kids = stack[i - 1].kids  # the open table is the last of them
                    kids.insert(len(kids) - 1, kid)
                    return
        stack[-1].kids.append(kid)

    def home(tag: str) -> None:
        """Closes what stands between a table part and its place, and opens the row that a cell implies."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in _HOMES[tag]:
                del stack[i + 1 :]
                return
            if stack[i].tag in _GRID and tag in ("td", "th"):
                del stack[i + 1 :]
                row = Node("tr", {})
                stack[-1].kids.append(row)
                stack.append(row)
                return
            if stack[i].tag in ("table", "td", "th", "caption"):
                return

    def outer() -> int:
        """Place in the stack of the svg or math whose rules hold, 0 for HTML's."""
        for i in range(len(stack) - 1, 0, -1) if foreign else ():
            if stack[i].tag in _FOREIGN:
                return i
            if stack[i].tag in _INTEGRATION:
                return 0
        return 0

    def add(text: str) -> None:
        if text:
            put(html.unescape(text))

    while m := _TAG.search(source, at):
        add(source[at : m.start()])
        at = m.end()
        if not m[1]:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].kids.append(Node("p", {}))
            elif tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif tag not in ("body", "html"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "thead", "tbody", "tfoot"):
                        break
            continue
        attrs = {a.lower(): html.unescape(x or y or z) for a, x, y, z in reversed(_ATTR.findall(m[2]))} if m[2].strip(" /") else {}
        if tag in ("html", "body"):
            root.attrs |= attrs if tag == "html" else {}
            if tag == "body" and _hidden("body", attrs):
                root.attrs["hidden"] = ""
            if tag == "body" and "style" in attrs:
                root.attrs["style"] = f"{root.attrs.get('style', '')};{attrs['style']}"
            if stack[-1].tag == "head":
                stack.pop()
            continue
        inside = outer()
        if inside and tag in _BREAKOUT:
            del stack[inside:]
            inside = 0
        if inside:
            node = Node(tag, attrs)
            stack[-1].kids.append(node)
            if not m[2].endswith("/") or _UNQUOTED_SLASH.search(m[2]):
                stack.append(node)
            continue
        if stack[-1].tag == "head" and tag not in ("base", "link", "meta", "title", "script", "style", "template", "noscript"):
            stack.pop()
        if tag in _CLOSES_P:
            end(frozenset(["p"]), _BARRIER)
        if tag in ENDS:
            end(*ENDS[tag])
        if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            stack.pop()
        if tag in _HOMES:
            home(tag)
        if stack[-1].tag in _GRID and tag in ("table", "form"):
            if tag == "form":
                continue
            del stack[max(i for i, n in enumerate(stack) if n.tag == "table" or not i) or len(stack) :]
        node = Node(tag, attrs)
        put(node)
        if tag in _FOREIGN and m[2].endswith("/") and not _UNQUOTED_SLASH.search(m[2]):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            if tag == "textarea":
                node.kids.append(html.unescape(source[at : close.start()]))
            at = close.end()
        elif tag not in VOID:
            stack.append(node)
    add(source[at:])
    return root


class _Page:
    """Lines of output, with the space that is still due."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.space = False
        self.gap = 0  # line breaks that are due before the next text
        self.head = ""  # begins the next line, such as a bullet
        self.indent = ""

    def text(self, s: str) -> None:
        s = s.replace("\xad", "")
        words = _SPACE.sub(" ", s)
        if words.strip(" "):
            self.flush()
            if (self.space or words[0] == " ") and self.line.strip() and not self.line.endswith(" "):
                self.line += " "
            self.line += words.strip(" ")
            self.space = words[-1] == " "
        elif words:
            self.space = True

    def flush(self) -> None:
        if self.gap:
            if self.lines or self.line.strip():
                self.lines.append(self.line.rstrip())
                self.lines += [""] * (self.gap - 1)
            self.line, self.gap, self.space = "", 0, False
        if not self.line:
            self.line = self.indent + self.head
            self.indent = " " * len(self.line) if self.head else self.indent
            self.head = ""

    def block(self, lines: int) -> None:
        if self.line.strip() or self.lines:
            self.gap = max(self.gap, lines)

    def raw(self, s: str) -> None:
        for i, x in enumerate(s.split("\n")):
            if i:
                self.lines.append(self.line.rstrip())
                self.line = self.indent
            else:
                self.flush()
            self.line += x

    def done(self) -> str:
        out = [*self.lines, self.line.rstrip()]
        while out and not out[0].strip():
            out.pop(0)
        while out and not out[-1].strip():
            out.pop()
        return "\n".join(out)


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _span(node: Node) -> int:
    return _count(node, "colspan", 1000)


def _count(node: Node, name: str, most: int) -> int:
    n = node.attrs.get(name, "1").strip()
    return min(max(1, int(n)), most) if n.isascii() and n.isdigit() and len(n) < 9 else 1


def _rows(table: Node) -> Iterator[Node]:
    for k in table.kids:
        if isinstance(k, Node) and not _hidden(k.tag, k.attrs):
            if k.tag == "tr":
                yield k
            elif k.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(k)


def _inner_tables(root: Node) -> None:
    """Renders each table that isn't hidden, the innermost first, and keeps its text with it: so tables nest to any depth."""
    found: list[tuple[Node, bool]] = []
    work: list[tuple[Node, bool]] = [(root, True)]
    while work:
        node, seen = work.pop()
        if _hidden(node.tag, node.attrs) and node is not root:
            continue
        seen = _shown(node, seen)
        if node.tag == "table":
            found.append((node, seen))
        work += [(k, seen) for k in node.kids if isinstance(k, Node)]
    for table, seen in reversed(found):
        page = _Page()
        _table(page, table, seen)
        table.attrs["\0text"] = page.done()


def _table(page: _Page, table: Node, seen: bool) -> None:
    for k in table.kids:
        if isinstance(k, Node) and k.tag == "caption" or not isinstance(k, Node) and k.strip() or isinstance(k, Node) and k.tag not in ("tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col"):
            page.block(1)
            _render(page, k, seen=seen)
    grid: list[list[tuple[int, list[str]]]] = []
    below: dict[int, int] = {}  # columns that cells from above reach into, and how many rows further
    for tr in _rows(table):
        row, at, taken = [], 0, below
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        in_row = _shown(tr, seen)
        for cell in tr.kids:
            if isinstance(cell, str) and not cell.strip() or isinstance(cell, Node) and _hidden(cell.tag, cell.attrs):
                continue
            while at in taken:
                at += 1
            inner = _Page()
            is_cell = isinstance(cell, Node) and cell.tag in ("td", "th")
            for k in cell.kids if is_cell else [cell]:
                _render(inner, k, seen=_shown(cell, in_row) if is_cell else in_row)
            row.append((at, inner.done().split("\n")))
            wide = _span(cell) if isinstance(cell, Node) else 1
            if is_cell and (deep := _count(cell, "rowspan", 65534)) > 1:
                below |= dict.fromkeys(range(at, at + wide), deep - 1)
            at += wide
        grid.append(row)
    widths: dict[int, int] = {}
    for row in grid:
        for i, (at, lines) in enumerate(row):
            if i + 1 < len(row) and row[i + 1][0] == at + 1:
                widths[at] = max(widths.get(at, 0), *map(_width, lines))
    wide = max([at for row in grid for at, _ in row], default=0) + 1
    starts = [0]
    for c in range(wide):
        starts.append(starts[-1] + widths.get(c, 0) + 2)
    for row in grid:
        if any(x.strip() for _, lines in row for x in lines):
            page.block(1)
            out = []
            for j in range(max(len(lines) for _, lines in row)):
                line = ""
                for at, lines in row:
                    part = lines[j] if j < len(lines) else ""
                    if part:
                        line += " " * max(2 * bool(line.strip()), starts[at] - _width(line)) + part
                out.append(line.rstrip())
            page.raw("\n".join(out))


def _drawn(svg: Node) -> list[Node]:
    """The text elements and embedded HTML that an svg shows, in order."""
    out, work = [], [svg]
    while work:
        node = work.pop()
        if node.tag in _SVG_HIDDEN or _hidden(node.tag, node.attrs) or node.attrs.get("display") == "none" or node.attrs.get("visibility") in ("hidden", "collapse"):
            continue
        if node.tag in ("text", "foreignobject"):
            out.append(node)
        else:
            work += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def _render(page: _Page, node: Node | str, pre: bool = False, seen: bool = True) -> None:
    """Appends a node's visible text; without recursion, as the tables in it are rendered already."""
    work: list = [("in", node, pre, seen)]
    lists: list[list] = []
    while work:
        step, it, pre, seen = work.pop()
        if step == "out":
            if it.tag in _LISTS:
                lists.pop()
            if it.tag in ("li", "dd", "blockquote"):
                page.indent, page.head = it.attrs["\0indent"], ""
            if it.tag == "q" and seen:
                page.text("”")
            if it.tag in BLOCKS:
                page.block(1 + (it.tag in APART and not (it.tag in _LISTS and lists)))
            continue
        if isinstance(it, str):
            if seen:
                page.raw(it) if pre else page.text(it)
            continue
        tag = it.tag
        if _hidden(tag, it.attrs):
            continue
        seen = _shown(it, seen)
        if tag == "br":
            page.flush()
            page.gap += 1
            continue
        if tag == "img":
            page.text(it.attrs.get("alt", "") if seen else "")
            continue
        if tag == "svg":
            work += [("in", x, False, seen) for k in reversed(_drawn(it)) for x in (" ", k, " ")]
            continue
        if tag in BLOCKS:
            page.block(1 + (tag in APART and not (tag in _LISTS and lists)))
        if tag == "table":
            if it.attrs["\0text"]:
                page.block(1)
                page.raw(it.attrs["\0text"])
            page.block(2)
            continue
        if tag in _LISTS:
            start = it.attrs.get("start", "1")
            lists.append([tag, int(start) if start.lstrip("-").isdigit() else 1])
        if tag in ("li", "dd", "blockquote"):
            it.attrs["\0indent"] = page.indent
            if tag == "li":
                own = lists[-1] if lists else ["ul", 1]
                value = it.attrs.get("value", "")
                number = int(value) if value.lstrip("-").isdigit() else own[1]
                own[1] = number + 1
                page.head = f"{number}. " if own[0] == "ol" else "- "
            else:
                page.indent += "  "
        if tag == "q" and seen:
            page.text("“")
        work.append(("out", it, pre, seen))
        inner = pre or tag in ("pre", "textarea", "listing", "xmp")
        kids = it.kids
        if tag == "details" and "open" not in it.attrs:  # closed, it shows its summary only
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag == "semantics":  # of a formula's forms the first is shown
            first = next((i for i, k in enumerate(kids) if isinstance(k, Node)), 0)
            kids = kids[: first + 1]
        if tag == "pre" and kids and isinstance(kids[0], str):
            kids = [kids[0].removeprefix("\r").removeprefix("\n"), *kids[1:]]
        work += [("in", k, inner, seen) for k in reversed(kids)]


def render(source: str | None) -> str:
    """The visible text of a page; empty for null, empty and wholly hidden pages."""
    if not source:
        return ""
    root = build(source)
    page = _Page()
    if "hidden" not in root.attrs and not _HIDING.search(root.attrs.get("style", "")):
        _inner_tables(root)
        for k in root.kids:
            _render(page, k, seen=_shown(root, True))
    return page.done()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (id, text) with the visible text of every page, whole pages however long. Rows that repeat are each returned;
    null and empty pages give empty texts; other columns aren't read; elements and tables nest to any depth."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([render(h) for h in batch["html"].to_pylist()], pa.string())], ["id", "text"])

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "id bigint, text string")
