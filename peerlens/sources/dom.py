"""Pages as node tables, selectors as column expressions, and tables as grids.

A page is parsed once, into one row for each element with the path from the root (number, tag, id, classes, attributes of each step). A selector becomes a
boolean expression over that path: a fold that carries which steps of the selector are met so far, so any number of selectors is read off one
scan and Spark prunes and combines them like other expressions. Cells of tables come with their place in the grid, where those that span
several rows or columns stand in each place they cover.

Void elements have no content; an open p, li, tr, td, th, dt, dd or option ends where the next one begins; script and style have no text;
character references that end in a semicolon are decoded; text of an element is all text within it, pieces and white space joined by one blank; of a root, pieces by a line
break. Null pages have no elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An open element of the first kind ends where one of the others begins (within the nearest element that holds such ones).
ENDS = {"p": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "div", "table", "section", "article"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDED = {tag: {e for e, begins in ENDS.items() if tag in begins} for tag in set().union(*ENDS.values())}
HOLDERS = {"table", "ul", "ol", "dl", "select", "div", "section", "article", "td", "th", "body"}
SILENT = {"script", "style"}

STEP = "struct<n: int, tag: string, id: string, classes: array<string>, attrs: map<string, string>>"
NODES = f"page_id bigint, node int, parent int, depth int, text string, own string, path array<{STEP}>"


NONE: dict[str, str] = {}  # of all elements without attributes


class Element:
    __slots__ = ("number", "tag", "parent", "attrs", "own", "pieces", "begin", "end")

    def __init__(self, number: int, tag: str, attrs: list[tuple[str, str | None]], parent: Element | None, pieces: list[str]):
        self.number, self.tag, self.parent, self.pieces = number, tag, parent, pieces
        self.attrs: dict[str, str] = {} if attrs else NONE
        for name, value in attrs:
            self.attrs.setdefault(name, value or "")
        self.own: list[str] | tuple = ()
        self.begin, self.end = len(pieces), None

    @property
    def texts(self) -> list[str]:
        """Pieces of text within the element: they lie together in the page."""
        return self.pieces[self.begin : self.end]


#: An ampersand that begins no reference with a semicolon at its end stands for itself.
_OPEN_REFERENCE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")
#: Tags of plain markup: attributes in double quotes, without references. What follows one of the second kind is not read as markup.
_TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_:-]*="[^"<>&]*")*)[ \t\n\r\f]*>')
_UNREAD = re.compile(r"<(?:script|style|xmp|iframe|noembed|noframes|noscript|plaintext|textarea|svg|math)(?![a-z0-9-])|<title(?![a-z0-9-])[^<]*<(?!/title>)", re.IGNORECASE)
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_:-]*)="([^"]*)"')


class Tree(HTMLParser):
    """Elements of a page in the order of their start tags. Pages of plain markup are cut at their tags at once, which gives the parser's events.

    Without `decode`, character references stay as they are written.
    """

    def __init__(self, page: str | None, decode: bool = True):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.pieces: list[str] = []
        text = page or ""
        if "&" in text:
            text = _OPEN_REFERENCE.sub("&amp;", text) if decode else text.replace("&", "&amp;")
        if not self._plain_markup(text):
            self.feed(text)
            self.close()

    def _plain_markup(self, page: str) -> bool:
        cut = _TAG.split(page)  # text, slash, tag, attributes, text, ...
        if any("<" in t for t in cut[::4]) or "\0" in page or _UNREAD.search(page):
            return False
        if cut[0]:
            self.handle_data(unescape(cut[0]))
        start, end = self.handle_starttag, self.handle_endtag
        opened, pieces = self.open, self.pieces
        for slash, tag, attrs, data in zip(cut[1::4], cut[2::4], cut[3::4], cut[4::4]):
            if slash:
                end(tag.lower())
            else:
                start(tag.lower(), [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else ())
            if data and opened and opened[-1].tag not in SILENT:
                if "&" in data:
                    data = unescape(data)
                if opened[-1].own:
                    opened[-1].own.append(data)
                else:
                    opened[-1].own = [data]
                pieces.append(data)
        return True

    def _shut(self, i: int) -> None:
        at, opened = len(self.pieces), self.open
        while len(opened) > i:
            opened.pop().end = at

    def handle_starttag(self, tag, attrs):
        opened = self.open
        if tag in ENDED:
            ended = ENDED[tag]
            for i in range(len(opened) - 1, -1, -1):
                above = opened[i].tag
                if above in ended:
                    self._shut(i)
                elif above in HOLDERS:
                    break
        e = Element(len(self.elements), tag, attrs, opened[-1] if opened else None, self.pieces)
        self.elements.append(e)
        if tag not in VOID:
            opened.append(e)
        else:
            e.end = e.begin

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._shut(i)
                return

    def handle_data(self, data):
        if self.open and self.open[-1].tag not in SILENT:
            self.open[-1].own = [*self.open[-1].own, data]
            self.pieces.append(data)


def _plain(parts: list[str]) -> str:
    if len(parts) == 1:
        return " ".join(parts[0].split())
    return " ".join(" ".join(parts).split())


def _lines(parts: list[str]) -> str:
    return "\n".join(t for t in (" ".join(p.split()) for p in parts) if t)


ROWS = 2_000  # elements in a batch that leaves the parser, or those of one page


def _offsets(lists: list) -> pa.Array:
    return pa.array(accumulate((len(x) for x in lists), initial=0), pa.int32())


def _listed(lists: list[list]) -> pa.Array:
    """A column of lists of strings."""
    return pa.ListArray.from_arrays(_offsets(lists), pa.array(chain.from_iterable(lists), pa.string()))


def _node_batch(trees: list[tuple[int, Tree]]) -> pa.RecordBatch:
    """Elements of pages, made column by column; each step of a path is stored once and taken for all elements below it."""
    elements = [e for _, t in trees for e in t.elements]
    paths: list[list[int]] = []
    for _, t in trees:
        first = len(paths)
        for e in t.elements:
            paths.append([*(paths[first + e.parent.number] if e.parent else ()), len(paths)])
    attrs = [list(e.attrs.items()) for e in elements]
    flat = list(chain.from_iterable(attrs))
    numbers = pa.array([e.number for e in elements], pa.int32())
    steps = pa.StructArray.from_arrays(
        [
            numbers, pa.array([e.tag for e in elements], pa.string()), pa.array([e.attrs.get("id", "") for e in elements], pa.string()), _listed([e.attrs["class"].split() if "class" in e.attrs else [] for e in elements]),
            pa.MapArray.from_arrays(_offsets(attrs), pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())),
        ],
        names=["n", "tag", "id", "classes", "attrs"],
    )
    at = pa.array(chain.from_iterable(paths), pa.int32())
    columns = [
        pa.array([page_id for page_id, t in trees for _ in t.elements], pa.int64()), numbers, pa.array([e.parent.number if e.parent else None for e in elements], pa.int32()), pa.array([len(p) for p in paths], pa.int32()),
        pa.array([_plain(e.texts) if e.parent else _lines(e.texts) for e in elements], pa.string()), pa.array([_plain(e.own) if e.own else "" for e in elements], pa.string()), pa.ListArray.from_arrays(_offsets(paths), steps.take(at)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "node", "parent", "depth", "text", "own", "path"])


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", decode: bool = True) -> DataFrame:
    """One row for each element of each page; without `decode`, character references stay as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((page_id, Tree(page.as_py(), decode)))
                n += len(held[-1][1].elements)
                if n >= ROWS:
                    yield _node_batch(held)
                    held, n = [], 0
        if n:
            yield _node_batch(held)

    return pages.select(F.col(key).cast("long").alias("page_id"), html).mapInArrow(run, NODES)


_SIMPLE = re.compile(r"""\s*(>)?\s*((?:[a-zA-Z][\w-]*|\*)?(?:[#.][\w-]+|\[\s*[\w:-]+\s*(?:[~^$*]?=\s*(?:"[^"]*"|'[^']*'|[^\]\s]+))?\s*\])*)""")
_PART = re.compile(r"""([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]|([a-zA-Z][\w-]*|\*)""")


def _steps(selector: str) -> list[tuple[bool, str]]:
    """(child of the step before, simple selector) of a selector without commas."""
    out, at = [], 0
    text = selector.strip()
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or not m.group(2):
            raise ValueError(f"not a selector: {selector!r}")
        out.append((m.group(1) == ">", m.group(2)))
        at = m.end()
    if not out or out[0][0]:
        raise ValueError(f"not a selector: {selector!r}")
    return out


def _simple(simple: str, step: Column) -> Column:
    """Whether one step of a path meets `tag#id.class[attr^="x"]`."""
    test = F.lit(True)
    for sign, name, attr, how, a, b, c, tag in _PART.findall(simple):
        if tag and tag != "*":
            test = test & (step["tag"] == tag.lower())
        elif sign == "#":
            test = test & (step["id"] == name)
        elif sign == ".":
            test = test & F.array_contains(step["classes"], name)
        elif attr:
            value, want = F.element_at(step["attrs"], F.lit(attr.lower())), a or b or c
            match how:
                case "":
                    met = value.isNotNull()
                case "=":
                    met = value == want
                case "~=":
                    met = F.array_contains(F.split(value, r"\s+"), want)
                case "^=":
                    met = value.startswith(want)
                case "$=":
                    met = value.endswith(want)
                case _:
                    met = value.contains(want)
            test = test & F.coalesce(met, F.lit(False))
    return test


def _mover(steps: list[tuple[bool, str]]):
    """One step of the fold: which beginnings of the selector are met at this element, and which at it or above."""

    def move(state: Column, step: Column) -> Column:
        last, seen = state["last"], state["seen"]
        now = F.lit(0)
        for k, (child, simple) in enumerate(steps):
            before = F.lit(True) if k == 0 else (last if child else seen).bitwiseAND(F.lit(1 << (k - 1))) != 0
            now = now.bitwiseOR(F.when(before & _simple(simple, step), F.lit(1 << k)).otherwise(F.lit(0)))
        return F.struct(now.alias("last"), seen.bitwiseOR(now).alias("seen"))

    return move


def matches(selector: str, path: Column | str = "path") -> Column:
    """Whether an element meets a selector: tag, #id, .class, [attr], [attr=x] (also ~= ^= $= *=), *, descendants by blank, children by >, alternatives by comma.

    The fold keeps, as bits, which beginnings of the selector are met at the last step and which anywhere above.
    """
    path = F.col(path) if isinstance(path, str) else path
    found = F.lit(False)
    for one in _alternatives(selector):
        steps = _steps(one)

        end = F.aggregate(path, F.struct(F.lit(0).alias("last"), F.lit(0).alias("seen")), _mover(steps))
        found = found | (end["last"].bitwiseAND(F.lit(1 << (len(steps) - 1))) != 0)
    return found


def _alternatives(selector: str) -> list[str]:
    """The parts between commas that stand outside brackets."""
    return re.findall(r"(?:[^,\[]|\[[^\]]*\])+", selector)


def attribute(name: str) -> Column:
    """An attribute of the element itself."""
    return F.element_at(F.element_at("path", -1)["attrs"], F.lit(name))


def within(selector: str) -> Column:
    """Number of the innermost step of an element's path, itself included, that meets a simple selector; null if none does."""
    return F.try_element_at(F.filter("path", lambda s: _simple(selector, s)), F.lit(-1))["n"]


def select(elements: DataFrame, selector: str) -> DataFrame:
    return elements.where(matches(selector))


GRID = "page_id bigint, grid int, row int, col int, header boolean, text string, links array<string>"
Cell = tuple[int, int, int, bool, str, list[str]]  # grid, row, col, header, text, links


def _cells(tree: Tree) -> Iterator[Cell]:
    """Cells of all tables with their place; one that spans several stands in each. A table within a cell is a table of its own."""
    n = len(tree.elements)
    table, row, cell = [None] * n, [None] * n, [None] * n  # of each element, above it; the cell may be itself
    links: dict[int, list[str]] = {}
    for e in tree.elements:
        i, up = e.number, e.parent
        if up:
            p = up.number
            cell[i] = cell[p]
            if up.tag == "table":
                table[i] = p
            else:
                table[i], row[i] = table[p], p if up.tag == "tr" else row[p]
        if e.tag == "td" or e.tag == "th":
            cell[i] = i
        elif e.tag == "a" and "href" in e.attrs:
            c = cell[i]
            while c is not None:
                links.setdefault(c, []).append(e.attrs["href"])
                above = tree.elements[c].parent
                c = cell[above.number] if above else None
    grids: dict[int, tuple[int, dict[int, int], set[tuple[int, int]], dict[int, int]]] = {}
    none: list[str] = []
    for e in tree.elements:
        tag = e.tag
        if tag == "table":
            grids[e.number] = (len(grids), {}, set(), {})
        elif tag in ("tr", "td", "th") and table[e.number] is not None:
            grid, rows, taken, begins = grids[table[e.number]]
            if tag == "tr":
                rows[e.number] = len(rows)
            elif row[e.number] is not None:
                at = rows[row[e.number]]
                col = begins.get(at, 0)  # those of its row before it are taken
                while (at, col) in taken:
                    col += 1
                begins[at] = col
                text, header, own = _plain(e.texts), tag == "th", links.get(e.number, none)
                if not e.attrs:
                    taken.add((at, col))
                    yield grid, at, col, header, text, own
                    continue
                down, wide = (max(1, int(e.attrs[s])) if e.attrs.get(s, "").isdigit() else 1 for s in ("rowspan", "colspan"))
                for i in range(min(down, 1000)):
                    for j in range(min(wide, 1000)):
                        if (at + i, col + j) not in taken:
                            taken.add((at + i, col + j))
                            yield grid, at + i, col + j, header, text, own


def _grid_batch(cells: list[tuple[int, Cell]]) -> pa.RecordBatch:
    at = list(zip(*((page_id, *c) for page_id, c in cells)))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(at, kinds)], _listed(at[6])], names=["page_id", "grid", "row", "col", "header", "text", "links"])


def grids(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, grid, row, col, header, text, links: every place of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for cell in _cells(Tree(page.as_py())):
                    held.append((page_id, cell))
                    if len(held) == ROWS:
                        yield _grid_batch(held)
                        held = []
        if held:
            yield _grid_batch(held)

    return pages.select(F.col(key).cast("long").alias("page_id"), html).mapInArrow(run, GRID)


ROW = "struct<row: int, texts: map<int, string>, links: map<int, array<string>>>"
GRID_ROWS = f"page_id bigint, grid int, heads array<struct<col: int, text: string>>, rows array<{ROW}>"


def _kept_heads(cells: list[Cell]) -> list[tuple[int, str]]:
    """Header cells of one table, the leftmost of each text."""
    first: dict[str, int] = {}
    for _, _, col, header, text, _ in cells:
        if header and col < first.get(text, col + 1):
            first[text] = col
    return [(col, text) for text, col in first.items()]


def _row_batch(made: list[tuple[int, int, list[tuple[int, str]], list[list[Cell]]]]) -> pa.RecordBatch:
    heads = [h for _, _, h, _ in made]
    rows = [r for _, _, _, rs in made for r in rs]
    linked = [[c for c in r if c[5]] for r in rows]
    texts = pa.MapArray.from_arrays(_offsets(rows), pa.array([c[2] for r in rows for c in r], pa.int32()), pa.array([c[4] for r in rows for c in r], pa.string()))
    links = pa.MapArray.from_arrays(_offsets(linked), pa.array([c[2] for r in linked for c in r], pa.int32()), _listed([c[5] for r in linked for c in r]))
    row = pa.StructArray.from_arrays([pa.array([r[0][1] for r in rows], pa.int32()), texts, links], names=["row", "texts", "links"])
    head = pa.StructArray.from_arrays([pa.array([c for h in heads for c, _ in h], pa.int32()), pa.array([t for h in heads for _, t in h], pa.string())], names=["col", "text"])
    columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int32()), pa.ListArray.from_arrays(_offsets(heads), head), pa.ListArray.from_arrays(_offsets([m[3] for m in made]), row)]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "grid", "heads", "rows"])


def grid_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, grid, heads, rows: tables with their header cells (the leftmost of each text) and, up to ROWS in a record, the rows that have other cells.

    A row's texts and links are keyed by column; header cells are left out. Each record tells all heads, so no row has to look for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: dict[int, list[Cell]] = {}
                for cell in _cells(Tree(page.as_py())):
                    found.setdefault(cell[0], []).append(cell)
                for grid, cells in found.items():
                    heads, rows = _kept_heads(cells), {}
                    for cell in cells:
                        if not cell[3]:
                            rows.setdefault(cell[1], []).append(cell)
                    listed = list(rows.values())
                    for i in range(0, len(listed), ROWS):
                        held.append((page_id, grid, heads, listed[i : i + ROWS]))
                        n += len(held[-1][3]) + len(heads)
                        if n >= ROWS:
                            yield _row_batch(held)
                            held, n = [], 0
        if held:
            yield _row_batch(held)

    return pages.select(F.col(key).cast("long").alias("page_id"), html).mapInArrow(run, GRID_ROWS)
