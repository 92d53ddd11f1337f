"""HTML extraction by layout: a tree builder with implied tags feeds a text renderer.

``Builder`` keeps the stack of open elements and calls ``Renderer`` as elements
open and close: it closes what a new tag implies closed (paragraphs before
blocks, list items, table cells and rows, options), opens what a table row or
cell needs, and drops end tags that match nothing.  ``Renderer`` skips what is
not visible, folds white space as a browser does, puts blocks on lines of
their own, marks and indents list items, and aligns table cells in columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import pieces_of

_TAG = re.compile(
    r"<(?:"
    r"!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|[!?][^>]*(?:>|\Z)"
    r"|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)"
    r")",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GONE = re.compile(r"(?:^|[;{\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;{\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Style rules with a simple selector: a tag, a class or an id, or a list of them.
_BRACE = re.compile(r"[{};]")
#: At-rules whose rules hold on a screen of any size.
_HOLDS = re.compile(r"@(?:supports|layer|container|scope)\b|@media\s+(?:[^,]*,\s*)*(?:only\s+)?(?:all|screen)\s*(?:,|$)", re.I)
_SIMPLE = re.compile(r"[a-z][a-z0-9]*|[.#][\w-]+", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes")
RAW_TEXT = _set("title textarea")
#: What a reader without scripts and plug-ins never sees.
HIDDEN = _set("head title script style template datalist iframe noembed noframes audio video canvas annotation annotation-xml metadata desc defs")
#: The standard's limits of spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Layout that would let a text grow beyond its page is left out, never text:
#: columns are at most so wide (longer cells push what follows), a table whose
#: cells would need more spaces than so many for each visible character and
#: each line has two spaces between cells, deeper tables are plain blocks,
#: lines are indented so far at most, and so many cells of a table reach down.
WIDEST, SPACES, LINE_SPACES, MOST_NESTED, MOST_INDENT, MOST_OPEN = 80, 4, 40, 4, 40, 1000
#: Blocks with an empty line around them, and blocks on a line of their own.
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table xmp menu")
BLOCKS = SPACED | _set("html body div section article aside header footer nav main address li dt dd figcaption form fieldset legend details summary dialog hr center caption thead tbody tfoot tr td th option optgroup hgroup search")
ENDS_P = (BLOCKS - _set("html body caption thead tbody tfoot tr td th option optgroup legend")) | _set("hr xmp plaintext")
#: What a start tag closes, and the elements at which the search for it stops.
CLOSES = {
    "li": (_set("li"), _set("ul ol menu table td th")),
    "dt": (_set("dt dd"), _set("dl table td th")),
    "dd": (_set("dt dd"), _set("dl table td th")),
    "option": (_set("option"), _set("select datalist")),
    "optgroup": (_set("option optgroup"), _set("select")),
    "td": (_set("td th"), _set("tr table")),
    "th": (_set("td th"), _set("tr table")),
    "tr": (_set("td th tr"), _set("table")),
    "thead": (_set("td th tr thead tbody tfoot caption colgroup"), _set("table")),
    "tbody": (_set("td th tr thead tbody tfoot caption colgroup"), _set("table")),
    "tfoot": (_set("td th tr thead tbody tfoot caption colgroup"), _set("table")),
    "h1": (_set("h1 h2 h3 h4 h5 h6"), _set("table td th li div section article body")),
}
CLOSES |= {f"h{i}": CLOSES["h1"] for i in range(2, 7)}
SCOPE = _set("table td th caption html")


class Buffer:
    """Text under construction: lines, pending breaks and the folding of white space."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.indent = 0, False, 0
        self.marker = ""

    def block(self, breaks: int) -> None:
        self.space = False
        if self.parts:
            self.breaks = max(self.breaks, breaks)

    def line(self) -> None:
        """A forced line break."""
        self.space = False
        if self.parts:
            self.breaks = min(self.breaks + 1, 2) if self.breaks else 1

    def _begin(self) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
            self.breaks = 0
            fresh = True
        else:
            fresh = not self.parts
        if fresh:
            marker, self.marker = self.marker, ""
            self.parts.append(" " * min(max(0, self.indent - len(marker)), MOST_INDENT) + marker)
            self.space = False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        space = self.space
        self._begin()
        if space and self.space:
            self.parts.append(" ")
        self.space = words[-1:] == " "
        self.parts.append(words[:-1] if self.space else words)

    def kept(self, text: str) -> None:
        """Text whose line ends and spaces stay."""
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.breaks += 1 if self.parts else 0
                self.space = False
            if line:
                self._begin()
                self.parts.append(line)

    def value(self) -> str:
        return "".join(self.parts)


def _span(value: str, most: int) -> int:
    return min(max(1, int(value)), most) if re.fullmatch(r"\d{1,9}", value) else 1


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []

    def _grid(self) -> list[list[tuple[int, int, list[str]]]]:
        """Cells as (first column, column after, lines), beside those that reach down from rows above.

        Only columns where some cell begins are counted.
        """
        taken: list[tuple[int, int, int]] = []  # (column, column after, rows still to go), by column
        rows: list[list[tuple[int, int, list[str]]]] = []
        for row in self.rows:
            at, cells, left, below = 0, [], iter(taken), []
            block = next(left, None)
            for text, columns, down in row:
                while block and block[0] <= at:  # places that rows above have taken
                    at = max(at, block[1])
                    block = next(left, None)
                cells.append((at, at + columns, text.split("\n")))
                if down > 1 and len(taken) + len(below) < MOST_OPEN:
                    below.append((at, at + columns, down))
                at += columns
            rows.append(cells)
            taken = sorted((a, b, n - 1) for a, b, n in (*taken, *below) if n > 1)
        first = sorted({a for cells in rows for a, _, _ in cells})
        return [[(bisect_left(first, a), max(bisect_left(first, b), bisect_left(first, a) + 1), lines) for a, b, lines in cells] for cells in rows]

    def render(self) -> str:
        """Rows with cells padded to common column widths; cells of several lines take several lines."""
        grid = self._grid()
        widths = [0] * max((b for cells in grid for _, b, _ in cells), default=0)
        for cells in grid:
            for a, b, lines in cells:
                if b == a + 1:
                    widths[a] = min(WIDEST, max(widths[a], *map(len, lines)))
        for cells in grid:  # what spans columns widens the last of them
            for a, b, lines in cells:
                if b > a + 1:
                    widths[b - 1] = min(WIDEST, widths[b - 1] + max(0, max(map(len, lines)) - sum(widths[a:b]) - 2 * (b - a - 1)))
        begins = list(accumulate((w + 2 for w in widths), initial=0))
        rows: list[list[tuple[int, str]]] = []  # lines as texts with the spaces before each
        spaces = visible = 0
        for cells in grid:
            for i in range(max((len(lines) for _, _, lines in cells), default=0)):
                line, reach = [], 0
                for a, _, lines in cells:
                    if i < len(lines) and lines[i]:
                        gap = max(begins[a] - reach, 2 if reach else 0)
                        line.append((gap, lines[i]))
                        reach += gap + len(lines[i])
                        spaces, visible = spaces + gap, visible + len(lines[i]) - lines[i].count(" ")
                rows.append(line)
        if spaces > SPACES * visible + LINE_SPACES * len(rows):
            rows = [[(2 if k else 0, text) for k, (_, text) in enumerate(line)] for line in rows]
        return "\n".join("".join([x for gap, text in line for x in (" " * gap, text)]).rstrip() for line in rows)


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules of a style sheet that hold on screens; those of other at-rules are passed over."""
    sheet = _COMMENT.sub("", sheet)
    at, open_, rule = 0, [True], None
    for m in _BRACE.finditer(sheet):
        if m[0] == ";":
            at = at if rule is not None else m.end()
        elif m[0] == "{":
            prelude = sheet[at : m.start()].strip()
            if rule is None and prelude.startswith("@"):
                open_.append(open_[-1] and bool(_HOLDS.match(prelude)))
            elif rule is None:
                rule = prelude
            at = m.end()
        else:
            if rule is not None:
                if open_[-1]:
                    yield rule, sheet[at : m.start()]
                rule = None
            elif len(open_) > 1:
                open_.pop()
            at = m.end()


class Renderer:
    """Turns opening and closing elements and text into laid-out text."""

    def __init__(self) -> None:
        self.buffers = [Buffer()]
        self.hidden = self.pre = 0
        self.visible = [True]
        self.lists: list[list] = []
        self.tables: list[Table] = []
        self.title: str | None = None
        #: Depth of hiding at each closed ``details`` that is open as an element.
        self.folds: list[int] = []
        #: Elements of tables beyond MOST_NESTED that are laid out as blocks.
        self.deep = 0
        #: Declarations of simple selectors that hide or show.
        self.styles: dict[str, str] = {}

    def style(self, sheet: str) -> None:
        """Take the rules of a style element that hide or show tags, classes or ids."""
        for selectors, body in _rules(sheet):
            if _GONE.search(body) or _VISIBILITY.search(body):
                for name in selectors.split(","):
                    if _SIMPLE.fullmatch(name := name.strip()):
                        key = name if name[0] in ".#" else name.lower()
                        self.styles[key] = f"{self.styles.get(key, '')};{body}"

    def _declared(self, tag: str, attrs: dict[str, str]) -> str:
        if not self.styles:
            return attrs.get("style", "")
        names = [tag, *("." + c for c in attrs.get("class", "").split()), "#" + attrs.get("id", "")]
        return ";".join([*(self.styles[n] for n in names if n in self.styles), attrs.get("style", "")])

    def open(self, tag: str, attrs: dict[str, str]) -> int:
        """Begin an element: 1 if it is taken out with all it holds, 2 if it sets visibility, 3 if only its summary shows, 4 for that summary, else 0.

        What is invisible keeps its place in the layout but not its text, and
        elements within may be visible again.
        """
        declared = self._declared(tag, attrs)
        hides = tag in HIDDEN or "hidden" in attrs or bool(_GONE.search(declared)) or (tag == "dialog" and "open" not in attrs)
        if tag == "summary" and not hides and self.folds and self.hidden == self.folds[-1]:
            self.hidden -= 1
            self.folds[-1] = -1  # only the first one
            self._layout(tag, attrs)
            return 4
        if self.hidden or hides:
            self.hidden += hides
            return int(hides)
        seen = _VISIBILITY.findall(declared)
        if seen:
            self.visible.append(seen[-1].lower() == "visible")
        self._layout(tag, attrs)
        if tag == "details" and "open" not in attrs and not seen:
            self.hidden += 1
            self.folds.append(self.hidden)
            return 3
        return 2 * bool(seen)

    def _layout(self, tag: str, attrs: dict[str, str]) -> None:
        buffer = self.buffers[-1]
        if tag == "br":
            buffer.line()
        elif tag == "hr":
            buffer.block(1)
            buffer.text("---")
            buffer.block(1)
        elif tag == "img" and attrs.get("alt") and not attrs.get("src"):
            if self.visible[-1]:
                buffer.text(attrs["alt"])
        elif tag == "input" and self.visible[-1] and attrs.get("type", "").lower() in ("submit", "button", "reset") and attrs.get("value"):
            buffer.text(f" {attrs['value']} ")
        elif tag == "table" and len(self.tables) >= MOST_NESTED:
            self.deep += 1
            buffer.block(1)
        elif self.deep and tag in ("td", "th", "tr"):
            buffer.block(1)
        elif tag in ("td", "th"):
            if self.tables:
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                down = MOST_ROWS if attrs.get("rowspan", "").strip() == "0" else _span(attrs.get("rowspan", "1"), MOST_ROWS)
                self.tables[-1].rows[-1].append(("", _span(attrs.get("colspan", "1"), MOST_COLUMNS), down))
                self.buffers.append(Buffer())
        elif tag == "tr":
            if self.tables:
                self.tables[-1].rows.append([])
        elif tag == "table":
            buffer.block(2)
            self.tables.append(Table())
        elif tag in ("ul", "ol", "menu", "dl"):
            buffer.block(1 if self.lists else 2)
            start = attrs.get("start", "1")
            self.lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            buffer.block(1)
            kind = self.lists[-1] if self.lists else ["ul", 1]
            if kind[0] == "ol":
                value = attrs.get("value", "")
                kind[1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else kind[1]
                marker = f"{kind[1]}. "
                kind[1] += 1
            else:
                marker = "- "
            buffer.indent += len(marker)
            buffer.marker = marker
            self.lists.append(["li", len(marker)])
        elif tag in ("blockquote", "dd"):
            buffer.block(2 if tag == "blockquote" else 1)
            buffer.indent += 2
        elif tag in BLOCKS:
            buffer.block(2 if tag in SPACED else 1)
        if tag in ("pre", "xmp", "textarea"):
            self.pre += 1

    def close(self, tag: str, kind: int) -> None:
        if kind == 3:
            self.folds.pop()
            self.hidden -= 1
        if self.hidden:
            self.hidden -= kind == 1
            return
        if kind == 2:
            self.visible.pop()
        self._end(tag)
        self.hidden += kind == 4

    def _end(self, tag: str) -> None:
        buffer = self.buffers[-1]
        if tag in ("pre", "xmp", "textarea"):
            self.pre -= 1
        if self.deep and tag in ("td", "th", "tr", "table"):
            self.deep -= tag == "table"
            buffer.block(1)
        elif tag in ("td", "th"):
            if self.tables:
                self.buffers.pop()
                row = self.tables[-1].rows[-1]
                row[-1] = (buffer.value(), *row[-1][1:])
        elif tag == "table":
            text = self.tables.pop().render()
            if text.strip():
                buffer.kept(text)
            buffer.block(2)
        elif tag in ("ul", "ol", "menu", "dl"):
            self.lists.pop()
            buffer.block(1 if self.lists else 2)
        elif tag == "li":
            buffer.indent -= self.lists.pop()[1]
            buffer.marker = ""
            buffer.block(1)
        elif tag in ("blockquote", "dd"):
            buffer.indent -= 2
            buffer.block(2 if tag == "blockquote" else 1)
        elif tag in BLOCKS and tag != "tr":
            buffer.block(2 if tag in SPACED else 1)

    def text(self, text: str) -> None:
        if self.hidden or not self.visible[-1]:
            return
        if self.pre:
            self.buffers[-1].kept(text)
        elif self.tables and len(self.buffers) <= len(self.tables) and not text.strip():
            return  # white space between rows and cells
        else:
            self.buffers[-1].text(text)


class Builder:
    """The stack of open elements, and where on it each name lies: searches never walk the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.renderer = Renderer()

    def _pop(self) -> None:
        tag, kind = self.stack.pop()
        self.places[tag].pop()
        self.renderer.close(tag, kind)

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._pop()

    def _last(self, names: frozenset[str]) -> int:
        """The innermost open element of these names; -1 if none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _find(self, names: frozenset[str], stop: frozenset[str]) -> int:
        """The outermost open element of these names above the nearest stop; -1 if none."""
        limit, found = self._last(stop - names), []
        for n in names:
            some = self.places.get(n)
            if some and some[-1] > limit:
                found.append(some[bisect_right(some, limit)])
        return min(found, default=-1)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.renderer.open(tag, attrs)))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        if self.stack and self.stack[-1][0] == "head" and tag not in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
            self._pop()  # the body begins
        if tag in ENDS_P and (at := self._find(_set("p"), SCOPE)) >= 0:
            self._pop_to(at)
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            at = self._find(names, stop)
            if at >= 0:
                self._pop_to(at)
        if tag in ("td", "th") and self._find(_set("tr"), _set("table")) < 0 and self._find(_set("table"), frozenset()) >= 0:
            self._push("tr", {})
        if tag in VOID:
            self.renderer.close(tag, self.renderer.open(tag, attrs)) if tag != "hr" else self.renderer.open(tag, attrs)
        else:
            self._push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.renderer.open("br", {})
            return
        if tag in ("html", "body"):
            return
        stop = _set("table") if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else frozenset() if tag == "table" else SCOPE
        at = self._last(frozenset((tag,)))
        if at >= 0 and at > self._last(stop - {tag}):
            self._pop_to(at)
            return
        if tag == "p":  # an end tag alone stands for an empty paragraph
            self.start("p", {})
            self._pop()

    def text(self, text: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and text.strip():
            self._pop()
        self.renderer.text(text)

    def finish(self) -> str:
        self._pop_to(0)
        return "\n".join(line.rstrip() for line in self.renderer.buffers[0].value().split("\n")).strip("\n")


def extract(source: str | None) -> tuple[str, str]:
    """Title and visible text of one page."""
    builder, title = Builder(), ""
    source = (source or "").replace("\x00", "�")
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if not m:
            builder.text(html.unescape(source[at:]))
            break
        if m.start() > at:
            builder.text(html.unescape(source[at : m.start()]))
        at = m.end()
        if tag := m["start"]:
            tag = tag.lower()
            raw = m["attrs"]
            attrs: dict[str, str] = {}
            if raw:
                for name, a, b, c in _ATTR.findall(raw):
                    attrs.setdefault(name.lower(), html.unescape(a or b or c))
            if tag == "plaintext":
                builder.start("pre", attrs)
                builder.text(source[at:])
                break
            builder.start(tag, attrs)
            if tag in RAW or tag in RAW_TEXT:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(source, at)
                text = source[at : stop.start()]
                text = html.unescape(text) if tag in RAW_TEXT else text
                if tag == "style":
                    builder.renderer.style(text)
                if tag == "title" and not title:
                    title = _SPACE.sub(" ", text).strip()
                builder.text(text)
                builder.end(tag)
                at = stop.end()
        elif tag := m["end"]:
            builder.end(tag.lower())
    return title, builder.finish()


def render(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_chars and n_lines of every whole page.

    A null page is an empty one: empty title and text.  Repeated rows are
    rendered each alone; markup that never closes is closed at the end; an
    empty table gives no rows.  Scripts do not run, so that ``noscript`` and the
    content of ``object`` show; of a closed ``details`` the summary shows; style
    elements hide what comes after them, by tag, class or id, where their
    at-rules hold on any screen.  Texts and time grow with the length of a page,
    however deep its elements lie and however wide its cells are: see WIDEST and
    what follows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces_of(batch, "html"):
                done = [extract(h) for h in some.column(1).to_pylist()]
                text = [t for _, t in done]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in text], pa.int64())],
                    names=["page_id", "title", "text", "n_chars", "n_lines"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string, n_chars long, n_lines long")
