"""Visible text of web pages, laid out: blocks apart, lists marked, table cells in aligned columns."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_fields

# Elements of HTML by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style title template noscript iframe noembed noframes object datalist audio video canvas".split())
#: Elements within svg and math that are not shown, and one of svg that stands apart.
HIDDEN_FOREIGN = set("title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
FOREIGN, FOREIGN_BLOCK = ("svg", "math"), "text"
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dir dl table figure fieldset hr".split())
CLOSES_P = BLOCK - set("html body dd dt li option optgroup td th tr tbody thead tfoot caption legend".split())
#: Start tags that leave an open head open; any other, and text that is not blank, ends it and begins the body.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: A start tag of the key ends open elements of the first kind, up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Start tags that need an open parent, which is put in.
PARENT = {"tr": ("table", {"table", "tbody", "thead", "tfoot"}), "td": ("tr", {"tr"}), "th": ("tr", {"tr"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(/?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_GONE = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_SEEN = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
#: Bounds that HTML itself sets to colspan and rowspan.
COLSPAN, ROWSPAN = 1000, 65534


class _Box:
    """An open element, with what it has put out so far: finished lines and the line in work."""

    __slots__ = ("tag", "hidden", "pre", "gone", "block", "lines", "line", "gap", "count", "rows", "span", "own")

    def __init__(self, tag: str, up: "_Box | None", own: bool):
        self.tag, self.own = tag, own
        # gone with all it holds; hidden also where only its own text is not seen
        self.gone, self.hidden, self.pre = (up.gone, up.hidden, up.pre) if up else (False, False, False)
        self.block = tag in BLOCK
        if own or up is None:
            self.lines, self.line, self.gap = [], [], 0
        self.count, self.rows, self.span = 0, None, (1, 1)


class _Page:
    def __init__(self):
        self.open = [_Box("", None, True)]
        self.at = defaultdict(list)  # where in it the open elements of each tag are
        self.out = [self.open[0]]  # the boxes with lines of their own

    def innermost(self, tags: Iterable[str]) -> int:
        """Where the last open element of these is; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.at[t])), default=0)

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and _BLANK.sub("", data):
            self.start("body", "")
        box = self.open[-1]
        if box.hidden or (box.tag == "details" and box.count):
            return
        out = self.out[-1]
        if box.pre:
            first, *rest = data.split("\n")
            if first:
                out.line.append(first)
            for part in rest:
                self.end_line(True)
                if part:
                    out.line.append(part)
            return
        data = _BLANK.sub(" ", data)
        if box.tag in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol") and data == " ":
            return
        if not out.line or out.line[-1].endswith(" "):
            data = data[1:] if data[:1] == " " else data
        if data:
            out.line.append(data)

    def end_line(self, keep: bool = False) -> None:
        out = self.out[-1]
        line = "".join(out.line).rstrip(" ")
        out.line = []
        if line or keep:
            if out.gap and out.lines:
                out.lines += [""] * out.gap
            out.gap = 0
            out.lines.append(line)

    def apart(self, spaced: bool) -> None:
        self.end_line()
        if spaced:
            self.out[-1].gap = 1

    def start(self, tag: str, attributes: str, closed: bool = False) -> None:
        if self.open[-1].tag == "head" and tag not in IN_HEAD and tag != "body":
            self.start("body", "")
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            self.close_within(ends, stop)
        if tag in CLOSES_P:
            self.close_within({"p"}, {"td", "th", "li", "table", "button", "caption"})
        if tag in PARENT and self.open[-1].tag not in PARENT[tag][1]:
            self.start(PARENT[tag][0], "")
        up = self.open[-1]
        if tag == "br":
            if not up.hidden:
                self.end_line(True)
            return
        if tag in VOID:
            if tag in BLOCK and not up.hidden:
                self.apart(True)
            return
        box = _Box(tag, up, tag in ("table", "td", "th", "li", "caption"))
        foreign = self.innermost(FOREIGN) > 0
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        style = unescape(found.get("style", ""))
        if tag in HIDDEN or "hidden" in found or _GONE.search(style) or (tag == "dialog" and "open" not in found) or (foreign and tag in HIDDEN_FOREIGN):
            box.gone = True
        if up.tag == "details" and up.count and tag != "summary":
            box.gone = True
        if seen := _SEEN.findall(style):
            box.hidden = seen[-1].lower() != "visible"
        box.hidden |= box.gone
        box.block |= foreign and tag == FOREIGN_BLOCK
        if tag == "details" and "open" not in found:
            box.count = 1
        if box.block and not box.hidden:
            self.apart(tag in SPACED)
        if tag in ("pre", "textarea", "xmp"):
            box.pre = True
        if tag == "table":
            box.rows = []
        elif tag == "ol":
            start = found.get("start", "1")
            box.count = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
        elif tag in ("td", "th"):
            across, down = (found.get(k, "1") for k in ("colspan", "rowspan"))
            across = min(int(across), COLSPAN) if re.fullmatch(r"[1-9]\d{0,8}", across) else 1
            box.span = across, (min(int(down), ROWSPAN) or ROWSPAN) if re.fullmatch(r"\d{1,9}", down) else 1
        self.at[tag].append(len(self.open))
        self.open.append(box)
        if box.own:
            self.out.append(box)
        if tag == "tr" and (at := self.innermost(("table",))):
            self.open[at].rows.append([])
        if closed and foreign | (tag in FOREIGN):
            self.pop()

    def close_within(self, ends: set[str], stop: set[str]) -> None:
        least = self.innermost(stop)
        found = [at[k] for t in ends if (k := bisect_right(at := self.at[t], least)) < len(at)]
        if found:
            self.pop_to(min(found))

    def pop_to(self, size: int) -> None:
        while len(self.open) > size:
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "p" and not self.at["p"]:
            self.start("p", "")
        at = self.innermost((tag,))
        inner = tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") and self.innermost(("table", "td", "th")) > at
        if at and not inner:
            self.pop_to(at)

    def pop(self) -> None:
        box = self.open[-1]
        if box.block and not box.hidden or box.own:
            self.apart(False)
        self.open.pop()
        self.at[box.tag].pop()
        if box.own:
            self.out.pop()
            if not box.gone:
                self.put(box)
        if box.block and not box.hidden:
            self.apart(box.tag in SPACED)

    def put(self, box: _Box) -> None:
        """Set what a finished box has put out into the box around it."""
        if box.tag in ("td", "th"):
            table = self.open[self.innermost(("table",))]
            if table.rows:
                table.rows[-1].append((box.lines, *box.span))
                return
        lines = box.lines
        if box.tag == "table":
            lines = [*lines, *_aligned(box.rows)]
        elif box.tag == "li":
            owner = self.open[self.innermost(("ul", "ol", "menu", "dir"))]
            mark = "- "
            if owner.tag == "ol":
                owner.count += 1
                mark = f"{owner.count}. "
            if box.hidden:
                mark = ""
            lines = [(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(lines)]
        out = self.out[-1]
        for i, line in enumerate(lines):
            if i == 0 and out.gap and out.lines:
                out.lines += [""] * out.gap
            out.gap = 0
            out.lines.append(line)


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(first column, column behind, lines) of the cells of each row, beside those that reach down from earlier rows."""
    out = []
    taken: list[tuple[int, int, int]] = []  # (first column, column behind, first row below) of cells that reach further down
    for r, row in enumerate(rows):
        taken = [x for x in taken if x[2] > r]
        above, k, c, placed = sorted(taken), 0, 0, []
        for lines, across, down in row:
            while k < len(above) and above[k][0] <= c:
                c, k = max(c, above[k][1]), k + 1
            placed.append((c, c + across, lines))
            below = min(r + down, len(rows))
            if below > r + 1:
                if taken and taken[-1][1:] == (c, below):  # side by side and as far down: one
                    taken[-1] = (taken[-1][0], c + across, below)
                else:
                    taken.append((c, c + across, below))
            c += across
        out.append(placed)
    return out


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells as lines: each column as wide as its widest cell needs, two blanks between columns.

    A column in which no cell begins takes no room, and a cell that spans several widens the last one where it needs to.
    """
    placed = _placed(rows)
    columns = sorted({a for row in placed for a, _, _ in row})
    ending = defaultdict(dict)  # by the column they end before: the widest cell from each column
    cells = [[(bisect_left(columns, a), bisect_left(columns, b), lines) for a, b, lines in row] for row in placed]
    for row in cells:
        for a, b, lines in row:
            ending[b][a] = max(ending[b].get(a, 0), max(map(len, lines), default=0))
    edges = [0]  # where each column begins
    for k in range(1, len(columns) + 1):
        edges.append(max([edges[-1] + 2, *(edges[a] + width + 2 for a, width in ending[k].items())]))
    out = []
    for row in cells:
        for y in range(max((len(lines) for _, _, lines in row), default=0)):
            line, width = [], 0
            for a, _, lines in row:
                if y < len(lines):
                    line += [" " * (edges[a] - width), lines[y]]
                    width = edges[a] + len(lines[y])
            out.append("".join(line).rstrip())
    return out


def render(html: str | None) -> str:
    """All visible text of a page, by its tags and their own attributes; style sheets are not read. Null and empty pages give ''. Any text is accepted: tags are implied, closed or ignored as browsers do."""
    page, at, html = _Page(), 0, html or ""
    search, n = _TOKEN.search, len(html)
    while at < n:
        m = search(html, at)
        if m is None:
            page.text(unescape(html[at:]))
            break
        if m.start() > at:
            page.text(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, m[3], bool(m[4]))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = close.start() if close else n
            if tag == "textarea":
                page.text(unescape(html[at:stop]))
            at = stop
            if close is None:
                break
    while len(page.open) > 1:
        page.pop()
    page.end_line()
    return "\n".join(page.open[0].lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """pages with `text`, the visible text of the whole html, replacing a column of that name.

    Null html gives '' and so does a page without visible text; rows repeated are rendered alike; an empty table gives an empty result.
    """
    kept = [f.name for f in pages.schema.fields if f.name.lower() != "text"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([render(h.as_py()) for h in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], text], [*kept, "text"])

    plain = pages.select(*[F.col(f"`{c}`") for c in kept], F.col("html").cast("string").alias("__html"))
    return plain.mapInArrow(of, with_fields(pages.schema, ("text", "string")))
