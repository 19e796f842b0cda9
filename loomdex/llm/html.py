"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags make the element tree; visibility rules
(hidden attribute, inline style, simple selectors of style elements, elements that are
never shown) select what a reader sees; a renderer walks the tree and emits all visible
text: blocks on lines of their own, a blank line where a margin stands, list items with
bullets or numbers, table cells (of any number of lines, and spanning rows or columns) padded
to columns. Both walks use explicit stacks, so any nesting depth is handled, and time grows
linearly with the page: open elements are known by name, and where a quote or bracket has no
end is found out once. Lists show INDENT levels of indentation at most, columns are padded to
PAD characters at most, and a table has COLUMNS spanned columns at most; no text is cut.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stream import frugal

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?/][^a-zA-Z>][^>]*>|<![^>]*>|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)|(?P<text>[^<]+|<)",
    re.S,
)
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SIMPLE = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")
INDENT, PAD, COLUMNS = 32, 120, 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template noscript title meta link iframe object audio video canvas datalist noembed noframes area".split())
#: Parts of svg and math that are never shown.
UNSEEN = frozenset("desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul xmp".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir fieldset xmp".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "option", "optgroup", "legend", "p"} | {"p"}
_SCOPE = frozenset("table td th caption html body button object template".split())
#: A start tag ends open elements of these names, up to a barrier.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | _SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | _SCOPE),
    "dd": ({"dt", "dd"}, {"dl"} | _SCOPE),
    "option": ({"option"}, {"select", "optgroup", "datalist"} | _SCOPE),
    "optgroup": ({"option", "optgroup"}, {"select"} | _SCOPE),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "td": ({"td", "th"}, {"tr", "table", "template"}),
    "th": ({"td", "th"}, {"tr", "table", "template"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict:
    out: dict = {}
    for m in _ATTR.finditer(source):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class _TagEnds:
    """Where start tags end: at the first > outside of quotes or, if a quote is never closed,
    at the first > of all. A quote that leads nowhere is remembered, as every tag that comes
    to it ends the same way."""

    def __init__(self, html: str):
        self.html, self.last, self.dead = html, {q: html.rfind(q) for q in "\"'"}, set()

    def find(self, at: int) -> int:
        """Position of the >, or -1."""
        seen, i = [], at
        while (m := _STOP.search(self.html, i)) is not None:
            i, what = m.start(), m[0]
            if what == ">":
                return i
            if i >= self.last[what] or i in self.dead:
                break
            seen.append(i)
            i = self.html.find(what, i + 1) + 1
        self.dead.update(seen)
        return self.html.find(">", at)


class _Open:
    """The stack of open elements, with the places of each name."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def last(self, names) -> int:
        """Place of the innermost element of these names, 0 if there is none."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)

    def close(self, names, barrier) -> bool:
        """Ends the innermost of ``names`` and all within, unless a barrier is further in."""
        at = self.last(names)
        if not at or at < self.last(barrier):
            return False
        while len(self.nodes) > at:
            self.pop()
        return True


def parse(html: str) -> tuple[Node, list]:
    """(root, style rules)."""
    root, rules = Node("#root", {}), []
    stack, ends, at, n = _Open(root), _TagEnds(html), 0, len(html)
    last_tag, last_cdata = html.rfind(">"), html.rfind("]]>")

    def add(child) -> None:
        stack.nodes[-1].children.append(child)

    while at < n:
        if at > last_tag:  # no tag can end any more
            comment = html.find("<!--", at)
            rest = html[at : comment if comment >= 0 else n]
            add(unescape(rest))
            break
        if html.startswith("<![CDATA[", at) and at > last_cdata:
            at = html.find(">", at) + 1  # a comment for browsers
            continue
        m = _TOKEN.match(html, at)
        if m is None:  # a '<' that opens nothing
            add(html[at])
            at += 1
            continue
        at = m.end()
        if (text := m["text"] or m["cdata"]) is not None:
            add(unescape(text) if "&" in text and m["cdata"] is None else text)
            continue
        if m["close"]:
            tag = m["close"].lower()
            if tag == "br":
                add(Node("br", {}))
            elif not stack.close({tag}, _SCOPE - {tag} if tag not in ("table", "html", "body") else ()) and tag == "p":
                add(Node("p", {}))
            continue
        if not m["open"]:
            continue
        end = ends.find(at)
        tag, source, at = m["open"].lower(), html[at:end], end + 1
        if tag in ("html", "body") and stack.places.get(tag):
            continue
        if tag in CLOSES_P:
            stack.close({"p"}, _SCOPE)
        if tag in _ENDS:
            while stack.close(*_ENDS[tag]):
                pass
        if stack.nodes[-1].tag == "head" and tag not in NEVER and tag != "base":
            stack.pop()  # the first visible element ends the head
        node = Node(tag, _attributes(source) if source.strip(" /\n\t\r") else {})
        add(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            body = html[at : end.start() if end else n]
            if tag == "style":
                rules += _rules(body)
            elif tag in ("textarea", "xmp"):
                node.children.append(unescape(body) if tag == "textarea" else body)
            at = html.find(">", end.end()) + 1 if end else n
            at = at or n
        elif tag not in VOID:  # HTML ignores the slash of a start tag
            stack.push(node)
    return root, rules


def _shows(declarations: str) -> dict:
    """What a list of declarations says: {'none': bool, 'seen': bool}."""
    out = {}
    for part in declarations.lower().split(";"):
        k, _, v = part.partition(":")
        k, v = k.strip(), v.replace("!important", "").strip()
        if k == "display":
            out["none"] = v == "none"
        elif k == "visibility" and v in ("hidden", "collapse", "visible"):
            out["seen"] = v == "visible"
    return out


def _top_level(css: str):
    """(selectors, declarations) of the rules that stand in no other block and hold none."""
    clear, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        clear.append(css[at:start])
        at = css.find("*/", start + 2) + 2
        if at < 2:
            break
    else:
        clear.append(css[at:])
    css = " ".join(clear)
    depth = opened = after = 0
    plain = True
    for m in re.finditer("[{}]", css):
        if m[0] == "{":
            if not depth:
                opened, plain = m.start(), True
            plain &= not depth
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                selectors = css[after:opened].rpartition(";")[2]
                if plain and "@" not in selectors:
                    yield selectors, css[opened + 1 : m.start()]
                after = m.end()


def _rules(css: str) -> list:
    """(tag or None, classes, ids, what it says) of rules with one compound selector."""
    out = []
    for selectors, body in _top_level(css):
        if not (says := _shows(body)):
            continue
        for s in selectors.split(","):
            if (m := _SIMPLE.match(s.strip())) and (m[1] or m[2]):
                names = re.findall(r"([.#])([\w-]+)", m[2])
                tag = m[1].lower() if m[1] and m[1] != "*" else None
                out.append((tag, {n for k, n in names if k == "."}, {n for k, n in names if k == "#"}, says))
    return out


class Rules:
    """Style rules by the rarest thing they ask for, so that an element meets few of them."""

    def __init__(self, rules: list):
        last: dict[tuple, tuple] = {}  # of rules with one selector the last one counts, for each property
        for order, (tag, classes, ids, says) in enumerate(rules):
            for name, value in says.items():
                last[tag, frozenset(classes), frozenset(ids), name] = (order, value)
        self.by: dict[tuple, list] = {}
        for (tag, classes, ids, name), (order, value) in last.items():
            key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
            self.by.setdefault(key, []).append((order, tag, classes, ids, {name: value}))

    def __bool__(self) -> bool:
        return bool(self.by)

    def says(self, tag: str, attrs: dict) -> dict:
        classes, ident = set(attrs.get("class", "").split()), attrs.get("id")
        keys = [("#", ident), ("", tag), ("", None), *((".", c) for c in classes)]
        met = [r for k in keys for r in self.by.get(k, ()) if (r[1] is None or r[1] == tag) and r[2] <= classes and (not r[3] or r[3] == {ident})]
        out: dict = {}
        for _, _, _, _, what in sorted(met, key=lambda r: r[0]):
            out |= what
        return out


def visibility(node: Node, rules: Rules, seen: bool) -> tuple[bool, bool]:
    """(whether the element takes part at all, whether its own text is seen)."""
    a, tag = node.attrs, node.tag
    if tag in NEVER or "hidden" in a or tag == "dialog" and "open" not in a or tag == "input":
        return False, seen
    says = rules.says(tag, a) if rules else {}
    if "style" in a:
        says |= _shows(a["style"])
    return not says.get("none", False), says.get("seen", seen)


class _Writer:
    """Lines of text; a margin becomes one blank line between two blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.margin = False
        self.indent, self.mark = "", None

    def text(self, s: str, keep: bool = False) -> None:
        if keep:
            first, *more = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in more:
                self.end(True)
                self._put(x)
            return
        s = _SPACE.sub(" ", s)
        if not s:
            return
        if s == " ":
            self.space = bool(self.line)
            return
        body = s.strip(" ")
        self._put((" " if self.line and (self.space or s[0] == " ") else "") + body)
        self.space = s[-1] == " "

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            lead, self.mark = (self.mark if self.mark is not None else self.indent), None
            self.line.append(lead)
        self.line.append(s)

    def end(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        elif force and self.lines and not self.margin:
            self.lines.append("")
        self.line, self.space = [], False

    def block(self, margin: bool) -> None:
        self.end()
        self.margin |= margin

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _span(value: str, most: int) -> int:
    value = value.strip()
    return min(max(int(value[:9]), 1), most) if value.isascii() and value.isdigit() else 1


class _Table:
    """Cells at their columns: those that earlier rows hold by a rowspan are passed over."""

    def __init__(self, out: _Writer):
        self.out, self.caption = out, []
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines)
        self.until: dict[int, int] = {}  # a column's last row that a cell from above holds
        self.at = 0

    def row(self) -> None:
        self.rows.append([])
        self.at = 0

    def cell(self, lines: list[str], attrs: dict) -> None:
        if not self.rows:
            self.row()
        now = len(self.rows) - 1
        while self.until.get(self.at, -1) >= now:
            self.at += 1
        wide = max(1, min(_span(attrs.get("colspan", "1"), COLUMNS), COLUMNS - self.at))
        high = attrs.get("rowspan", "1").strip()
        high = 65534 if high == "0" else _span(high, 65534)  # 0: all rows that follow
        self.rows[-1].append((self.at, wide, lines))
        if high > 1:
            for c in range(self.at, self.at + wide):
                self.until[c] = now + high - 1
        self.at += wide

    def lines(self):
        width: dict[int, int] = {}
        for row in self.rows:
            for at, wide, lines in row:
                width[at] = max(width.get(at, 0), min(PAD, max(map(len, lines), default=0)) if wide == 1 else 0)
                width.setdefault(at + wide - 1, 0)
        start, place = {}, 0
        for c in range(max(width, default=-1) + 1):
            start[c] = place
            place += width.get(c, 0) + 2
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                out, used = [], 0
                for at, _, lines in row:
                    if i < len(lines) and lines[i]:
                        gap = max(start[at] - used, 2 if used else 0)
                        out.append(" " * gap + lines[i])
                        used += gap + len(lines[i])
                yield "".join(out).rstrip()


def render(html: str) -> str:
    """All visible text of a page."""
    root, rules = parse(html)
    rules = Rules(rules)
    out = _Writer()
    tables: list[_Table] = []  # open ones
    lists: list[list] = []  # open lists: kind, next number, indent before
    pre = foreign = level = 0
    work: list[tuple] = [("in", c, True) for c in reversed(root.children)]
    while work:
        what, node, seen = work.pop()
        if what == "in":
            if isinstance(node, str):
                if seen:
                    out.text(node, pre > 0)
                continue
            takes, seen = visibility(node, rules, seen)
            tag = node.tag
            if not takes or foreign and tag in UNSEEN:
                continue
            if tag == "br":
                out.end(True)
                continue
            if tag == "wbr":
                continue
            if tag in BLOCK or foreign and tag == "text":
                out.block(tag in MARGIN and not (lists and tag in ("ul", "ol", "menu", "dir")))
            if tag in ("pre", "xmp", "textarea"):
                pre += 1
            elif tag in ("svg", "math"):
                foreign += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1, out.indent])
                if 1 < len(lists) <= INDENT:
                    out.indent += "  "
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, ""]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                out.mark = out.indent + mark
            elif tag == "dd" or tag == "blockquote":
                level += 1
                if level <= INDENT:
                    out.indent += "  "
            elif tag == "table":
                tables.append(_Table(out))
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th", "caption") and tables:
                work.append(("out", node, (out, lists, level)))
                out, lists, level = _Writer(), [], 0
                work += [("in", c, seen) for c in reversed(node.children)]
                continue
            work.append(("out", node, None))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            work += [("in", c, seen) for c in reversed(children)]
            continue
        tag = node.tag
        if tag in ("td", "th", "caption") and tables:
            lines = [x for x in out.result().split("\n") if x.strip()]
            out, lists, level = seen  # the writer and the lists that were in use before the cell
            if tag == "caption":
                tables[-1].caption += lines
            else:
                tables[-1].cell(lines, node.attrs)
            continue
        if tag == "table":
            table = tables.pop()
            for line in [*table.caption, *table.lines()]:
                if line:
                    out._put(line)
                    out.end()
        elif tag in ("pre", "xmp", "textarea"):
            pre -= 1
        elif tag in ("svg", "math"):
            foreign -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            out.indent = lists.pop()[2]
        elif tag == "li":
            out.mark = None
        elif tag == "dd" or tag == "blockquote":
            if level <= INDENT:
                out.indent = out.indent[:-2]
            level -= 1
        if tag in BLOCK or foreign and tag == "text":
            out.block(tag in MARGIN and not (lists and tag in ("ul", "ol", "menu", "dir")))
    return out.result()


def _render(names: list[str]):
    def run(batches):
        for batch in batches:
            html = batch.column("html")
            text = [None if (h := x.as_py()) is None else render(h) for x in html]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(text, pa.string())], names=names)

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), name: str = "text") -> DataFrame:
    """Columns ``keep`` of ``pages`` and the visible text of column html as ``name``, one
    row per row. Null html gives null, empty or invisible html an empty text; broken markup
    is read as browsers read it, never refused. No shuffle; other columns are not read."""
    base = pages.select(*keep, F.col("html").cast("string").alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep).schema.fields)
    return base.mapInArrow(frugal(_render([*keep, name])), f"{schema}, `{name}` string")
