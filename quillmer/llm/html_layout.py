"""HTML extraction by layout-aware rendering.

A tree builder with implied tags turns a page into elements; visibility rules (elements that never show, the hidden
attribute, inline styles, style sheets by importance, specificity and order) drop what a reader wouldn't see; rendering emits all the rest: blocks on
lines of their own with their blank lines, lists with markers and indents, preformatted text as it is, and tables with
aligned cells, those over several rows or columns too. Hidden visibility is inherited, and what is visible in it shows. Every table
is laid out alike, whatever its size: a line of over WIDE characters doesn't widen its column, and no column begins beyond PAGE
characters, so a line has at most PAGE of padding before a cell. Neither building nor rendering recurses, so depth is bounded by memory alone.

Defined results: a null or empty page gives an empty text; text outside any element is text; unclosed elements close at the
end, end tags without a start are ignored, an unclosed comment or tag ends with the page; repeated rows each get their row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, col

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
#: what isn't shown inside these elements
NEVER_INSIDE = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset("annotation annotation-xml".split())}
#: blank lines around a block
BLOCKS = {t: 0 for t in "html body div section article main header footer nav aside address form fieldset legend figure figcaption details summary dialog center hgroup dt dd li tr caption thead tbody tfoot option optgroup search menuitem text textarea".split()}
BLOCKS |= {t: 1 for t in "p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote hr listing xmp".split()}
#: which open elements a start tag closes, and the elements that stop the search
_CELL, _ROW = ("td", "th"), ("tr", "td", "th")
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("optgroup", "option"), ("select",)),
    "td": (_CELL, ("table",)), "th": (_CELL, ("table",)), "tr": (_ROW, ("table",)), "caption": (("caption",), ("table",)), "body": (("head",), ()), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
} | {t: (("thead", "tbody", "tfoot", "colgroup", "caption", *_ROW), ("table",)) for t in ("thead", "tbody", "tfoot", "colgroup")}
CLOSES_P = frozenset(BLOCKS) - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "text", "textarea", "li", "dt", "dd"} | {"li", "dt", "dd"}
P_SCOPE = frozenset("button td th caption table html body object".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())

_TAG = re.compile(r"""<(?:!--(?:(?!-->).)*+(?:-->|$)|!\[CDATA\[|[!?][^>]*+(?:>|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)(\s*!\s*important)?", re.I)
_PARTS = re.compile(r"\s*(>)\s*|(\s+)")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_MEDIA = re.compile(r"@media([^{};]*+)\{((?:[^{}]++|\{[^{}]*+\})*+)\}", re.I)
_SCREEN = re.compile(r"^\s*(?:only\s+)?(?:screen|all)\s*$", re.I)
_SELECTOR = re.compile(r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
_SPACE = " \t\n\r\f"


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        value = a or b or c
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def build(page: str) -> tuple[Element, list[str]]:
    """The tree of a page and the texts of its style sheets."""
    root = Element("html")
    stack, styles, at, n = [root], [], 0, len(page)
    opened: Counter = Counter()  # open elements by tag; what isn't open isn't searched for

    def pop_from(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def add_text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    def close(names: tuple, stops: tuple) -> None:
        if not any(opened[t] for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t in names:
                pop_from(i)
                return
            if t in stops:
                return

    def close_all(names: tuple, stops: tuple) -> None:
        """The outermost of ``names`` inside the innermost of ``stops``, and all in it."""
        found = 0
        if not any(opened[t] for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t in stops:
                break
            if t in names:
                found = i
        if found:
            pop_from(found)

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add_text(page[at:])
            break
        add_text(page[at : m.start()])
        at = m.end()
        slash, tag, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                end = page.find("]]>", at)
                stack[-1].children.append(page[at : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            continue
        tag = tag.lower()
        if slash:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Element("p"))
            elif tag == "br":
                stack[-1].children.append(Element("br"))
            elif tag not in ("html", "body") and opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if t == tag:
                        pop_from(i)
                        break
                    if t in _CELL and tag not in ("tr", "table", "tbody", "thead", "tfoot") or t == "table" and tag != "table":
                        break
            continue
        if tag == "html":
            root.attributes += " " + rest
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            pop_from(len(stack) - 1)
        if tag in CLOSES_P:
            close(("p",), P_SCOPE)
        if tag in CLOSES:
            close_all(*CLOSES[tag])
        if tag in _CELL and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Element("tr")
            stack[-1].children.append(row)
            stack.append(row)
            opened["tr"] += 1
        e = Element(tag, rest)
        if any(opened[t] and tag in inner for t, inner in NEVER_INSIDE.items()):
            e.attributes = "hidden"
        stack[-1].children.append(e)
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : end.start() if end else n]
            if tag == "style":
                styles.append(raw)
            elif tag in ("textarea", "title", "xmp"):
                e.children.append(raw if tag == "xmp" else unescape(raw))
            at = (page.find(">", end.start()) + 1 or n) if end else n
            continue
        stack.append(e)
        opened[tag] += 1
    return root, styles


def on_screen(sheet: str) -> str:
    """A style sheet without comments; of its @media blocks only the rules for any screen stay, since others depend on the reader."""
    return _MEDIA.sub(lambda m: m.group(2) if any(_SCREEN.match(x) for x in m.group(1).split(",")) else "", re.sub(r"/\*.*?\*/", "", sheet, flags=re.S))


#: what declarations say: by property, whether the declaration is important, and whether it hides
Said = dict[str, tuple[bool, bool]]


def declared(body: str) -> Said:
    """The last declaration of each property, important ones first."""
    out: Said = {}
    for name, value, important in _DECLARED.findall(body):
        name, value = name.lower(), value.lower()
        if bool(important) >= out.get(name, (False, False))[0]:
            out[name] = (bool(important), value == "none" if name == "display" else value in ("hidden", "collapse"))
    return out


class Sheet:
    """The rules of a page's style sheets on display and visibility. A selector is a chain of simple ones (tag, classes, ids) joined by
    descent or ``>``; rules with other selectors are left out. ``state`` of an element tells, for each rule, how much of its chain
    ends at the element and how much at one above or at it, so a child needs its parent's state alone."""

    def __init__(self, styles: list[str]):
        self.rules: list[tuple[list, tuple, Said]] = []
        for sheet in styles:
            for selectors, body in _RULE.findall(on_screen(sheet)):
                says = declared(body)
                for s in selectors.split(",") if says else ():
                    if chain := self.chain(s.strip()):
                        ids, classes, tags = (sum(f(c) for c in chain) for f in (lambda c: len(c[3]), lambda c: len(c[2]), lambda c: c[1] != "*"))
                        self.rules.append((chain, (ids, classes, tags, len(self.rules)), says))
        self.start = ([0] * len(self.rules), [0] * len(self.rules))

    @staticmethod
    def chain(selector: str) -> list[tuple[str, str, frozenset, frozenset]] | None:
        out, at, way = [], 0, " "
        for m in [*_PARTS.finditer(selector), None]:
            simple = _SELECTOR.match(selector[at : m.start() if m else len(selector)])
            if not simple or not simple.group():
                return None
            marks = re.findall(r"[.#][\w-]+", simple.group(2))
            out.append((way, (simple.group(1) or "*").lower(), frozenset(x[1:] for x in marks if x[0] == "."), frozenset(x[1:] for x in marks if x[0] == "#")))
            if m:
                at, way = m.end(), m.group(1) or " "
        return out

    def meet(self, tag: str, classes: set[str], own: set[str], above: tuple) -> tuple[list, tuple]:
        """(specificity, declarations) of the rules that an element meets, and its state, from its parent's."""
        over, parent = above
        met, here = [], []
        for r, (chain, rank, says) in enumerate(self.rules):
            got = 0
            for k, (way, t, c, i) in enumerate(chain):
                if (t == "*" or t == tag) and c <= classes and i <= own and (not k or (parent if way == ">" else over)[r] >> k - 1 & 1):
                    got |= 1 << k
            here.append(got)
            if got >> len(chain) - 1:
                met.append((rank, says))
        return met, ([a | b for a, b in zip(over, here)], here)


def shown(e: Element, sheet: Sheet, inherited: bool, above: tuple) -> tuple[bool | None, tuple]:
    """Whether the text right in an element shows, None if the element is gone with all in it; and its state for its children. Of the declarations of a
    property the important ones win, then inline ones, then the most specific, then the last."""
    tag = e.tag
    a = attributes(e.attributes) if e.attributes and not e.attributes.isspace() else {}
    met, state = sheet.meet(tag, set(a.get("class", "").split()), {a.get("id", "")}, above) if sheet.rules else ([], above)
    if tag in NEVER or tag == "rp" or tag == "input" and a.get("type", "").lower() == "hidden":
        return None, state
    if "style" in a:
        met.append(((1 << 30,), declared(a["style"])))
    won = {}
    for name in ("display", "visibility"):
        said = [(says[name][0], rank, says[name][1]) for rank, says in met if name in says]
        won[name] = max(said)[2] if said else None
    # without a declaration, what browsers' own sheets say
    gone = won["display"] if won["display"] is not None else "hidden" in a or tag == "dialog" and "open" not in a
    return None if gone else inherited if won["visibility"] is None else not won["visibility"], state


class Flow:
    """Lines under construction: collapsed inline text, breaks, and blank lines between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = -1  # blank lines that go before the next line; -1 within a line

    def text(self, s: str) -> None:
        words = s.split() if s.isascii() else [w for w in re.split(r"[ \t\n\r\f]+", s) if w]
        if not words:
            self.space = self.space or bool(self.now)
            return
        if self.now and (self.space or s[0] in _SPACE):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = s[-1] in _SPACE

    def put(self, line: str) -> None:
        if self.gap > 0 and self.lines:
            self.lines += [""] * self.gap
        self.gap = -1
        self.lines.append(line)

    def flush(self) -> None:
        if self.now:
            self.put("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def brk(self) -> None:
        if self.now:
            self.flush()
        else:
            self.put("")

    def block(self, margin: int) -> None:
        self.flush()
        self.gap = max(self.gap, margin)

    def pre(self, s: str) -> None:
        parts = s.split("\n")
        for i, part in enumerate(parts):
            if i:
                self.put("".join(self.now))
                self.now = []
            if part:
                self.now.append(part)

    def done(self) -> list[str]:
        self.flush()
        out = self.lines
        while out and not out[-1]:
            out.pop()
        return out


#: a longer line doesn't widen its column; the column furthest right that cells are aligned to
WIDE, PAGE = 80, 240


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table whose cells are (lines, columns, rows; 0 for all that follow): each column as wide as its widest cell of
    one column, two spaces apart. What follows a line that reaches over its column's end comes two spaces after it."""
    width = lambda lines: max((len(x) for x in lines if len(x) <= WIDE), default=0)
    placed, until, widths = [], [], []  # until: per column the row from which it is free again
    for r, row in enumerate(rows):
        k, cells = 0, []
        for lines, span, down in row:
            while k < len(until) and until[k] > r:
                k += 1
            until += [0] * (k + span - len(until))
            for c in range(k, k + span):
                until[c] = r + down if down else len(rows)
            cells.append((k, lines, span))
            k += span
        widths += [0] * (len(until) - len(widths))
        for k, lines, span in cells:
            if span == 1:
                widths[k] = max(widths[k], width(lines))
        placed.append(cells)
    for cells in placed:  # what a cell over several columns lacks goes to its last one
        for k, lines, span in cells:
            if span > 1:
                widths[k + span - 1] += max(0, width(lines) - sum(widths[k : k + span]) - 2 * (span - 1))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    out = []
    for cells in placed:
        for i in range(max([1, *(len(lines) for _, lines, _ in cells)])):
            line = ""
            for k, lines, _ in cells:
                if i < len(lines) and lines[i]:
                    line = (line and line + "  ").ljust(min(starts[k], PAGE)) + lines[i]
            out.append(line.rstrip())
    return out


def _whole(s: str, other: int) -> int:
    return int(s) if re.fullmatch(r"-?\d{1,9}", s) else other


def render(page: str | None) -> str:
    """All visible text of a page, laid out."""
    if not page:
        return ""
    root, styles = build(page)
    sheet = Sheet(styles)
    flows = [Flow()]
    lists: list[list] = []  # per open list: ordered?, next number, step
    tables: list[list] = []  # per open table: rows of (lines, columns, rows)
    pre = 0
    stack: list[tuple] = [(root, False, True, sheet.start)]
    while stack:
        node, leaving, shows, state = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not shows:
                continue
            if pre:
                flow.pre(node)
            elif not (tables and tables[-1][0] is flow and node.isspace()):
                flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            shows, state = shown(node, sheet, shows, state)
            if shows is None or not shows and tag in ("br", "hr", "img"):
                continue
            if tag == "br":
                flow.brk()
                continue
            if tag == "hr":
                flow.block(1)
                flow.put("---")
                flow.block(1)
                continue
            if tag == "img":
                if "alt" in node.attributes and (alt := attributes(node.attributes).get("alt")):
                    flow.text(alt)
                continue
            if tag in _CELL and tables:
                flow.flush()
                flows.append(Flow())
            elif tag == "tr" and tables:
                tables[-1][1].append([])
            elif tag in BLOCKS:
                flow.block(BLOCKS[tag] if not (tag in ("ul", "ol", "menu") and lists) else 0)
            if tag in ("ul", "ol", "menu"):
                own = attributes(node.attributes) if tag == "ol" and node.attributes else {}
                step = -1 if "reversed" in own else 1
                first = sum(isinstance(c, Element) and c.tag == "li" for c in node.children) if step < 0 else 1
                lists.append([tag == "ol", _whole(own.get("start", ""), first), step])
            elif tag == "table":
                tables.append([flow, []])
            elif tag in ("li", "blockquote", "dd"):
                flows.append(Flow())
            elif tag in ("pre", "textarea"):
                pre += 1
                if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                    node.children[0] = node.children[0][1:]
            elif tag == "q" and shows:
                flow.text("“")
            stack.append((node, True, shows, state))
            stack.extend((c, False, shows, state) for c in reversed(node.children))
            continue
        if tag in _CELL and tables and len(flows) > 1:
            lines = flows.pop().done()
            own = attributes(node.attributes) if "span" in node.attributes.lower() else {}
            number = lambda name, least: max(least, int(own[name])) if re.fullmatch(r"\d{1,4}", own.get(name, "")) else 1
            rows = tables[-1][1]
            if not rows:
                rows.append([])
            rows[-1].append((lines, min(1000, number("colspan", 1)), number("rowspan", 0)))
            continue
        if tag in ("li", "blockquote", "dd"):
            lines = flows.pop().done()
            flow = flows[-1]
            if tag == "li" and lines:
                marker = "- "
                if lists and lists[-1][0]:
                    here = _whole(attributes(node.attributes).get("value", ""), lists[-1][1]) if node.attributes else lists[-1][1]
                    marker = f"{here}. "
                    lists[-1][1] = here + lists[-1][2]
                indent = " " * len(marker)
                lines = [marker + lines[0], *[indent + x if x else "" for x in lines[1:]]]
            elif tag != "li":
                lines = ["  " + x if x else "" for x in lines]
            for x in lines:
                flow.put(x)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "table":
            for x in aligned(tables.pop()[1]):
                flow.put(x)
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "q" and shows:
            flow.text("”")
        if tag in BLOCKS and not (tag == "tr" and tables):
            flow.block(BLOCKS[tag] if not (tag in ("ul", "ol", "menu") and lists) else 0)
    return "\n".join(flows[0].done())


@F.pandas_udf(T.StringType())
def _render(pages: pd.Series) -> pd.Series:
    return pages.map(render)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, text."""
    bounded_batches(pages.sparkSession)
    return pages.select(col(id_col).alias("page_id"), _render(F.coalesce(col(html_col), F.lit(""))).alias("text"))


def report(pages: DataFrame, **columns) -> DataFrame:
    """page_id, text, n_chars, n_lines of each page; an empty text has no lines."""
    t = F.col("text")
    return extract(pages, **columns).select("page_id", "text", F.length(t).cast("long").alias("n_chars"), F.when(t == "", 0).otherwise(F.size(F.split(t, "\n"))).cast("long").alias("n_lines"))
