"""HTML extraction by layout: all visible text, with block spacing, lists and aligned table cells.

Three steps run over a page's characters once, each linear in its length and none recursive:
a tokenizer (tags, comments, raw-text elements), a tree builder that opens and closes implied tags and
knows which elements are hidden, and a renderer that lays out blocks, lists and tables.

Hidden are: head, script, style and other elements that never show; ``hidden`` and ``display:none`` on the
element, or given to it by the page's own style sheets; closed details (but for their summary) and dialogs;
hidden inputs. ``visibility`` given in the same ways is inherited, so ``visible`` shows an element within one that
isn't; what is invisible keeps its place in the layout. Of the sheets count the rules that apply to a screen of
``SCREEN`` pixels, by importance, specificity and order, where the selector is a tag, an id, classes or
these together; rules with other selectors are left out, so that what they hide is kept.

Of a select its chosen option shows (all of a list box), of svg its text, of math its text in order.

Layout: paragraphs, headings, lists, tables and the like stand between blank lines, other blocks start
on a line of their own, ``br`` breaks the line, ``pre`` keeps its white space. Items of lists have a
dash or number and are indented by their depth. The cells of a table row are separated by `` | `` and
padded to the width of their column; a cell over several columns to theirs, and a cell over several rows leaves its
place empty in the rows below. A table whose padding would be over ``PADDING`` times its text, which one
very long cell in a column of many short ones does, pads no further than ``WIDEST`` characters; longer cells stand whole there. A table
with cells of several lines is taken for page layout: its cells follow as blocks.

Defined cases: null or empty HTML gives the empty text; text without tags is itself, white space
collapsed. Broken markup is read as browsers would, roughly, and never raises. Null ids and urls are
passed through, repeated rows give repeated rows, other columns don't matter, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a page's output: padding of a table as a multiple of its text and in itself; the width of its columns beyond that.
PADDING, LEAST_PADDING, WIDEST = 4, 1 << 16, 60
SCREEN = (1280, 800)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"\"(?:\\.|[^\"\\])*+\"?|'(?:\\.|[^'\\])*+'?|[{};]", re.S)
_COMPOUND = re.compile(r"(?:[\w-]+|\*)?(?:[.#][\w-]+)*")
_SHOWS = re.compile(r"\s*(display|visibility)\s*:\s*([\w-]+)[^!]*(!\s*important)?\s*", re.I)
_WIDTHS = re.compile(r"(min|max)-(?:device-)?(width|height)\s*:\s*([0-9.]+)(px|r?em)?")
_RANGE = re.compile(r"(?:([0-9.]+)(px|r?em)?\s*(<=?|>=?)\s*)?(width|height)(?:\s*(<=?|>=?)\s*([0-9.]+)(px|r?em)?)?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER = set("head script style template noscript title iframe object embed audio video canvas datalist noembed noframes".split())
#: Never shown within svg or math.
FOREIGN = set("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset form hr article section".split())
BLOCK = SPACED | set("html body address aside center dd details dialog dir div dt figcaption footer header hgroup legend li main menu nav option search summary caption optgroup".split())
IN_TABLE = set("table thead tbody tfoot tr td th caption colgroup".split())
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Tags that may stand in a head; any other closes it.
HEAD = set("head title base link meta style script noscript template".split())


def _true_feature(f: str) -> bool:
    """Whether one feature of a media query holds on the usual screen."""
    size = dict(zip(("width", "height"), SCREEN, strict=True))
    pixels = lambda n, unit: float(n) * (16 if unit and unit.endswith("em") else 1)
    try:
        if m := _WIDTHS.fullmatch(f):
            return size[m[2]] >= pixels(m[3], m[4]) if m[1] == "min" else size[m[2]] <= pixels(m[3], m[4])
        if (m := _RANGE.fullmatch(f)) and (m[3] or m[5]):
            holds = lambda a, op, b: (a < b or "=" in op and a == b) if op[0] == "<" else (a > b or "=" in op and a == b)
            return (not m[3] or holds(pixels(m[1], m[2]), m[3], size[m[4]])) and (not m[5] or holds(size[m[4]], m[5], pixels(m[6], m[7])))
    except ValueError:
        return False
    return re.sub(r"\s", "", f) in {"color", "hover", "hover:hover", "any-hover:hover", "pointer:fine", "any-pointer:fine", "orientation:landscape", "prefers-color-scheme:light", "prefers-reduced-motion:no-preference", "scripting:enabled", "width", "height"}


def _on_screen(queries: str) -> bool:
    """Whether a list of media queries takes in a screen of the usual width."""
    for q in queries.lower().split(","):
        words = q.split()
        negated = words[:1] == ["not"]
        q = " ".join(words[words[:1] in (["not"], ["only"]) :])
        ok = True
        for part in re.split(r"\band\b", q):
            part = part.strip()
            if part.startswith("("):
                ok = ok and any(_true_feature(f.strip("() ")) for f in re.split(r"\)\s*or\s*\(", part))
            else:
                ok = ok and part in ("", "all", "screen")
        if ok != negated:
            return True
    return False


class _Lines:
    """Text being laid out: lines, with blank lines asked for before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.lead, self.span = 0, False, "", "", 1

    def block(self, gap: int) -> None:
        if self.parts:
            self.lines.append(self.indent + self.lead + "".join(self.parts))
            self.parts, self.lead = [], " " * len(self.lead)
        self.space = False
        self.gap = max(self.gap, gap)

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or (bool(s) and bool(self.parts))
            return
        self._open()
        if self.parts and (self.space or s[0] == " ") and not self.parts[-1].endswith(" "):
            self.parts.append(" ")
        self.space = s[-1] == " "
        self.parts.append(s.strip(" "))

    def verbatim(self, s: str) -> None:
        for k, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.newline()
            if line:
                self._open()
                self.parts.append(line)

    def newline(self) -> None:
        if self.parts:
            self.block(0)
        elif self.lines and not self.gap:
            self.lines.append("")

    def _open(self) -> None:
        if not self.parts and self.gap > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0

    def done(self) -> str:
        self.block(0)
        return "\n".join(x.rstrip(" ") for x in self.lines).strip("\n")


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []  # cells: text, columns, rows
        self.caption = ""

    def grid(self) -> list[list[tuple[str, int, int]]]:
        """Rows of (text, first column, columns); cells of rows above that reach down are empty texts. No cell is wider than the row of the most
        cells, and no more than ``PADDING`` empty texts a cell are made in all, so that what a page says of spans can't outgrow it."""
        out: list[list[tuple[str, int, int]]] = []
        widest, left_over = max(map(len, self.rows), default=0), PADDING * sum(map(len, self.rows)) + LEAST_PADDING // 16
        below: dict[int, tuple[int, int]] = {}  # first column -> columns, rows left
        for r in self.rows:
            made, at, cells = [], 0, iter(r)
            left, below = below, {}
            rest = iter(sorted(left))
            while True:
                if at in left:
                    span, n = left.pop(at)
                    made.append(("", at, span))
                    left_over -= 1
                    if n > 1 and left_over > 0:
                        below[at] = (span, n - 1)
                elif (c := next(cells, None)) is not None:
                    # a cell ends where one from above begins
                    text, span, down = c
                    span = min(span, widest)
                    if span > 1:
                        span = next((k - at for k in range(at + 1, at + span) if k in left), span)
                    made.append((text, at, span))
                    if down > 1 and left_over > 0:
                        below[at] = (span, down - 1)
                elif left:
                    at = next(k for k in rest if k in left)
                    continue
                else:
                    break
                at += span
            out.append(made)
        return [r for r in out if any(c for c, _, _ in r)]

    def widths(self, rows: list[list[tuple[str, int, int]]], most: int | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for c, at, span in sorted((x for r in rows for x in r), key=lambda x: x[2]):
            if most is None or len(c) <= most:
                short = len(c) - sum(out.get(k, 0) for k in range(at, at + span)) - 3 * (span - 1)
                if short > 0:
                    out[at + span - 1] = out.get(at + span - 1, 0) + short
        return out

    def put(self, out: _Lines) -> None:
        rows = self.grid()
        out.block(2)
        if self.caption:
            out.verbatim(self.caption)
            out.block(1)
        if any("\n" in c for r in rows for c, _, _ in r):
            for r in rows:
                for c, _, _ in r:
                    if c:
                        out.verbatim(c)
                        out.block(1)
        else:
            widths = self.widths(rows, None)
            text = sum(len(c) for r in rows for c, _, _ in r)
            close = (sum(widths.values()) + 3 * max((at + span for r in rows for _, at, span in r), default=0)) * len(rows) > max(PADDING * text, LEAST_PADDING)
            if close:
                widths = self.widths([[x for x in r if x[2] == 1] for r in rows], WIDEST)
            for r in rows:
                padded = (c if close and span > 1 else c.ljust(sum(widths.get(k, 0) for k in range(at, at + span)) + 3 * (span - 1)) for c, at, span in r)
                out.verbatim(" | ".join(padded).rstrip())
                out.block(1)
        out.block(2)


class _Page:
    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # open elements: name, hidden by itself, invisible
        self.opened: Counter = Counter()  # by name, so that nothing is searched in vain
        self.hidden = self.pre = 0
        self.out: list[_Lines] = [_Lines()]
        self.tables: list[_Table] = []
        self.lists: list[list] = []  # kind, next number
        self.selects: list[list] = []  # shows all; options: text, chosen
        #: compound selector -> property -> (important, order, hides); and the compounds by one of their parts
        self.styled: dict[tuple, dict[str, tuple[bool, int, bool]]] = {}
        self.by_part: dict[str, list[tuple]] = {}
        self.rules = 0

    def sheet(self, css: str) -> None:
        css = _COMMENT.sub(" ", css).replace("<!--", " ").replace("-->", " ")
        blocks: list[tuple[bool, list[str] | None]] = [(True, None)]  # open ones: applies, selectors
        at = 0
        for m in _CSS.finditer(css):
            if m[0] not in "{};":
                continue
            before, at = css[at : m.start()].strip(), m.end()
            applies, selectors = blocks[-1]
            if m[0] != "{":
                self._declare(before, applies, selectors)
                if m[0] == "}" and len(blocks) > 1:
                    blocks.pop()
            elif before.startswith("@"):
                name, _, rest = before[1:].replace("(", " (", 1).partition(" ")
                name = name.lower()
                holds = _on_screen(rest) if name == "media" else name == "layer" or (name == "supports" and not rest.strip().lower().startswith("not"))
                blocks.append((applies and holds, selectors))
            else:
                # a rule within a rule has a selector with a combinator
                blocks.append((applies and selectors is None, before.split(",")))
        self._declare(css[at:], *blocks[-1])

    def _declare(self, declaration: str, applies: bool, selectors: list[str] | None) -> None:
        if not applies or not selectors or not (m := _SHOWS.fullmatch(declaration)):
            return
        kind, value = m[1].lower(), m[2].lower()
        self.rules += 1
        new = (bool(m[3]), self.rules, value in ("none", "hidden", "collapse"))
        for x in selectors:
            x = x.strip().lower()
            if not x or x == "*" or not _COMPOUND.fullmatch(x):
                continue
            parts = tuple(sorted(set(re.findall(r"[.#]?[\w-]+", x))))
            if parts not in self.styled:
                self.styled[parts] = {}
                self.by_part.setdefault(parts[0], []).append(parts)
            if kind not in self.styled[parts] or self.styled[parts][kind] < new:
                self.styled[parts][kind] = new

    @property
    def unseen(self) -> bool:
        """Whether text here shows nothing though it has its place."""
        return bool(self.stack) and self.stack[-1][2]

    def _hidden(self, name: str, attrs: dict[str, str]) -> tuple[bool, bool]:
        """Whether the element isn't there, and whether it is invisible."""
        if name in NEVER or (name in FOREIGN and (self.opened["svg"] or self.opened["math"])) or (name == "dialog" and "open" not in attrs):
            return True, self.unseen
        #: property -> (important, of the element itself, ids, classes, tags, order, hides)
        best = {"display": (False, False, -1, 0, 0, 0, True)} if "hidden" in attrs else {}
        if self.styled:
            own = {name, *("." + c for c in attrs.get("class", "").lower().split()), "#" + attrs.get("id", "").lower()}
            for part in own:
                for parts in self.by_part.get(part, ()):
                    if own.issuperset(parts):
                        ids, classes = (sum(p[0] == c for p in parts) for c in "#.")
                        for kind, (important, order, hides) in self.styled[parts].items():
                            best[kind] = max(best.get(kind, (False, False, -2)), (important, False, ids, classes, len(parts) - ids - classes, order, hides))
        for k, declaration in enumerate(attrs["style"].split(";") if "style" in attrs else ()):
            if m := _SHOWS.fullmatch(declaration):
                kind = m[1].lower()
                best[kind] = max(best.get(kind, (False, False, -2)), (bool(m[3]), True, 0, 0, 0, k, m[2].lower() in ("none", "hidden", "collapse")))
        return "display" in best and best["display"][-1], best["visibility"][-1] if "visibility" in best else self.unseen

    def start(self, name: str, raw: str) -> None:
        attrs = {a.lower(): unescape(q or s or u) for a, q, s, u in _ATTR.findall(raw)} if raw and raw != "/" else {}
        if name not in HEAD and self.stack and any(n == "head" for n, *_ in self.stack[:3]):
            self.end("head")
        if self.opened["select"]:
            if name == "select":
                self.end("select")
                return
            if name in ("input", "textarea", "button") or (name in IN_TABLE and self.opened["table"]):
                self.end("select")
            elif name not in ("option", "optgroup", "script", "template", "style"):
                return
        if name in CLOSES:
            self._close(*CLOSES[name])
        if (name in BLOCK or name in ("table", "hr")) and not self.opened["select"]:
            self._close({"p"}, {"td", "th", "table", "caption", "button", "object"})
        if name in ("td", "th") and self.tables and not any(n == "tr" for n, *_ in self._since("table")):
            self.start("tr", "")
        if name in VOID:
            gone, unseen = self._hidden(name, attrs) if not self.hidden else (True, True)
            if not gone and (not unseen or name in ("br", "hr")):
                self._void(name, attrs)
            return
        if raw.endswith("/") and (name in ("svg", "math") or self.opened["svg"] or self.opened["math"]) and not self.opened["foreignobject"]:
            return
        details = self.stack[-1][0] == "details?" if self.stack else False
        hide, unseen = self._hidden(name, attrs)
        hide = hide or (details and name != "summary")
        self.opened[name] += 1
        self.stack.append(("details?" if name == "details" and "open" not in attrs else name, hide, unseen))
        if hide:
            self.hidden += 1
        if self.hidden:
            return
        out = self.out[-1]
        if name == "table":
            out.block(2)
            self.tables.append(_Table())
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif name in ("td", "th", "caption") and self.tables:
            number = lambda n, most: min(int(attrs[n]), most) if re.fullmatch("[0-9]{1,9}", attrs.get(n, "")) else 1
            self.out.append(_Lines())
            # a row span of 0 reaches to the end of the table
            self.out[-1].span, self.out[-1].down = max(1, number("colspan", 1000)), number("rowspan", 65534) or 65534
        elif name == "select":
            size = attrs.get("size", "1")
            self.selects.append(["multiple" in attrs or (size.isdigit() and int(size[:9]) > 1), []])
        elif name == "option" and self.selects:
            self.out.append(_Lines())
            self.selects[-1][1].append([attrs.get("label", ""), "selected" in attrs, "disabled" in attrs])
        elif name == "optgroup" and self.selects:
            pass
        elif name == "text" and self.opened["svg"]:
            out.block(1)
        elif name in BLOCK:
            gap = 1 if name in ("ul", "ol") and self.lists else 2 if name in SPACED else 1
            out.block(gap)
            if name in ("ul", "ol", "menu", "dir"):
                first = attrs.get("start", "1")
                self.lists.append([name, int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1])
            elif name == "li":
                out.indent = "  " * max(0, len(self.lists) - 1)
                if self.lists and self.lists[-1][0] == "ol":
                    out.lead = f"{self.lists[-1][1]}. "
                    self.lists[-1][1] += 1
                else:
                    out.lead = "- "
        if name == "pre":
            self.pre += 1

    def _void(self, name: str, attrs: dict[str, str]) -> None:
        out = self.out[-1]
        if name == "br":
            out.newline()
        elif name == "hr":
            out.block(2)
        elif name == "img" and attrs.get("alt"):
            self.text(attrs["alt"])
        elif name == "input" and attrs.get("type", "").lower() in ("submit", "button", "reset") and attrs.get("value"):
            self.text(attrs["value"])

    def _since(self, name: str) -> list[tuple[str, bool, bool]]:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                return self.stack[k:]
        return self.stack

    def _close(self, names: set[str], until: set[str]) -> None:
        if not any(self.opened[n] for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            n = self.stack[k][0]
            if n in names:
                self._pop(k)
                return
            if n in until:
                return

    def end(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1) if self.opened[name] else ():
            n = self.stack[k][0].rstrip("?")
            if n == name:
                self._pop(k)
                return
            if n in ("td", "th", "table", "caption") and name not in IN_TABLE:
                return  # a stray end tag doesn't close a cell
        if name == "p" and not self.hidden:
            self.out[-1].block(2)

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, hid, _ = self.stack.pop()
            name = name.rstrip("?")
            self.opened[name] -= 1
            if not self.hidden:
                self._leave(name)
            self.hidden -= hid

    def _leave(self, name: str) -> None:
        if name in ("td", "th", "caption") and self.tables and len(self.out) > 1:
            lines = self.out.pop()
            if name == "caption":
                self.tables[-1].caption = lines.done()
            else:
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append((lines.done(), lines.span, lines.down))
        elif name == "option" and self.selects:
            text = self.out.pop().done()
            self.selects[-1][1][-1][0] = self.selects[-1][1][-1][0] or text
        elif name == "select" and self.selects:
            whole, options = self.selects.pop()
            if not whole:
                options = ([x for x in options if x[1]] or [x for x in options if not x[2]][:1] or options[:1])[-1:]
            for text, *_ in options:
                if whole:
                    self.out[-1].block(1)
                self.text(text)
            if whole:
                self.out[-1].block(1)
        elif name == "optgroup" and self.selects:
            pass
        elif name == "text" and self.opened["svg"]:
            self.out[-1].block(1)
        elif name == "table" and self.tables:
            self.tables.pop().put(self.out[-1])
        elif name in BLOCK:
            out = self.out[-1]
            if name in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
                out.block(1 if self.lists else 2)
                out.indent = "  " * max(0, len(self.lists) - 1) if self.lists else ""
            else:
                out.block(2 if name in SPACED else 1)
            if name == "li" or not self.lists:
                out.lead = ""
        if name == "pre" and self.pre:
            self.pre -= 1

    def text(self, s: str) -> None:
        if self.hidden or self.unseen:
            return
        if self.stack and self.stack[-1][0] == "details?":
            return
        if (self.opened["select"] and not self.opened["option"]) or (self.opened["svg"] and not (self.opened["text"] or self.opened["foreignobject"])):
            return
        if self.stack and self.stack[-1][0] in ("table", "thead", "tbody", "tfoot", "tr", "colgroup") and not s.strip():
            return
        if self.pre:
            self.out[-1].verbatim(s)
        else:
            self.out[-1].text(s)

    def done(self) -> str:
        self._pop(0)
        return self.out[0].done()


def _pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes or raw text): text, end, start, and raw for the content of the
    raw-text element that the start before it opened."""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            yield "text", unescape(html[at:]), ""
            return
        if m.start() > at:
            yield "text", unescape(html[at : m.start()]), ""
        at = m.end()
        if name := m["end"]:
            yield "end", name.lower(), ""
        elif name := m["start"]:
            name = name.lower()
            yield "start", name, m["attrs"]
            if name == "plaintext":
                yield "text", html[at:], ""
                return
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                yield "raw", name, html[at : end.start() if end else n]
                at = end.end() if end else n
        elif m[0].startswith("<![CDATA["):
            yield "text", m[0][9:].removesuffix("]]>"), ""


def render(html: str | None) -> str:
    """The visible text of a page."""
    html = html or ""
    page = _Page()
    if "<style" in html.lower():
        attrs = ""
        for kind, name, more in _pieces(html):  # sheets anywhere apply to the whole page
            if kind == "start":
                attrs = more
            elif kind == "raw" and name == "style":
                media = {a.lower(): unescape(q or s or u) for a, q, s, u in _ATTR.findall(attrs)}.get("media", "")
                if _on_screen(media):
                    page.sheet(more)
    for kind, name, more in _pieces(html):
        if kind == "text":
            page.text(name)
        elif kind == "end":
            page.end(name)
        elif kind == "start":
            page.start(name, more)
        else:
            if name == "xmp":
                page.text(more)
            elif name == "textarea" and not page.hidden and not page.unseen:
                page.out[-1].verbatim(unescape(more).removeprefix("\r").removeprefix("\n"))
            page.end(name)
    return page.done()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 500):
            part = b.slice(at, 500)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([render(h.as_py()) for h in part.column(2)], pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in p.schema.fields[:2]]
    return p.mapInArrow(_run, ", ".join([*kinds, "text string"]))
