"""Page tables: scan stored pages, extract their tables and lists into long
cells, promote a header row to column names and stack pages by class.

Each page is walked once with the standard library's ``html.parser`` in
``mapInArrow``: nesting is followed by depth, all character references are
decoded, and spanned cells are repeated in every row and column they cover.
The walk gives each cell its column name and carries the page's url, so header
promotion and class need no join.  Cells stay long (page, table, row, column)
because each page brings its own header.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.session import scratch_path

# The per-partition Python functions of this module run on executors; they
# are pickled with their code, so executors need not have this package on
# their path (on a cluster it can still be shipped with --py-files).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASS_IN_URL = r"/(\d+)(?:[?#].*)?$"
TABLE_SCHEMA = ("page_id long, url string, table_idx long, row_idx long, col_idx long, cell string, href string, "
                "is_body boolean, col_name string")
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
#: Cells that a task hands on together.
CELLS_OUT = 4096
#: Largest colspan and rowspan, as browsers have it.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
_SPACE = re.compile(r"[\s\xa0]+")


def class_from_url(url: Column) -> Column:
    """The number ending the URL path; NULL when there is none."""
    return F.regexp_extract(url, CLASS_IN_URL, 1).try_cast("bigint")


def page_scan(pages: DataFrame) -> DataFrame:
    """One row per stored page with its class (the number ending the URL
    path) and size; replaces fetching one URL per class."""
    return pages.select("page_id", "url", class_from_url(F.col("url")).alias("class_year"),
                        F.length("html").cast("bigint").alias("n_chars"))


class _Cell:
    def __init__(self, colspan: int = 1, rowspan: int = 1, head: bool = False):
        self.parts: list[str] = []
        self.href: str | None = None
        self.colspan, self.rowspan, self.head = colspan, rowspan, head

    @property
    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


class _Container:
    """A table or list; ``rows`` are lists of cells as written."""

    def __init__(self, kind: str):
        self.kind, self.rows, self.cell = kind, [], None

    def grid(self) -> list[list[_Cell]]:
        """Rows with spanned cells repeated in all places they cover."""
        out: list[list[_Cell]] = []
        pending: dict[int, tuple[_Cell, int]] = {}   # column -> cell, rows it still covers
        for row in self.rows:
            line: dict[int, _Cell] = {c: cell for c, (cell, _) in pending.items()}
            below = {c: (cell, n - 1) for c, (cell, n) in pending.items() if n > 1}
            at = 0
            for cell in row:
                while at in line:
                    at += 1
                for c in range(at, at + cell.colspan):
                    line.setdefault(c, cell)
                    if cell.rowspan > 1:
                        below.setdefault(c, (cell, cell.rowspan - 1))
            pending = below
            out.append([line[c] for c in sorted(line)])
        return out


class _Walker(HTMLParser):
    """Collects containers in page order; text of a nested table also counts
    in the cell around it, as a reading of its text content gives."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[_Container] = []
        self.open: list[_Container] = []

    @staticmethod
    def _span(attrs: dict, name: str, most: int) -> int:
        value = (attrs.get(name) or "").strip()
        return min(max(int(value), 1), most) if value.isdigit() else 1

    def handle_starttag(self, tag, attrs):
        attrs, top = dict(attrs), self.open[-1] if self.open else None
        if tag in ("table", "ul", "ol"):
            self.open.append(_Container(tag))
            self.found.append(self.open[-1])
        elif top and (tag == "tr" and top.kind == "table" or tag == "li" and top.kind != "table"):
            top.rows.append([])
            top.cell = None
            if tag == "li":
                self._begin(top, _Cell())
        elif top and tag in ("td", "th") and top.kind == "table":
            if not top.rows:
                top.rows.append([])
            self._begin(top, _Cell(self._span(attrs, "colspan", MAX_COLSPAN),
                                   self._span(attrs, "rowspan", MAX_ROWSPAN), tag == "th"))
        elif tag == "a" and attrs.get("href"):
            for c in self.open:
                if c.cell and c.cell.href is None:
                    c.cell.href = attrs["href"]

    @staticmethod
    def _begin(top: _Container, cell: _Cell) -> None:
        top.rows[-1].append(cell)
        top.cell = cell

    def handle_endtag(self, tag):
        if tag in ("table", "ul", "ol"):
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth].kind == tag:  # an unclosed inner container ends with it
                    del self.open[depth:]
                    break
        elif self.open and tag in ("td", "th", "li", "tr"):
            self.open[-1].cell = None

    def handle_data(self, data):
        for c in self.open:
            if c.cell:
                c.cell.parts.append(data)


class _Done(Exception):
    """The first table or list has ended."""


class _FirstWalker(_Walker):
    """Reads a page to the end of its first table or list."""

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if self.found and not self.open:
            raise _Done


def _containers(html: str, first_only: bool) -> list[_Container]:
    walker = _FirstWalker() if first_only else _Walker()
    try:
        walker.feed(html)
        walker.close()
    except _Done:
        pass
    return walker.found[:1] if first_only else walker.found


def unique_names(names: Sequence[str]) -> list[str]:
    """Names made unique in order: the second ``MP`` becomes ``MP.1``, or the
    first ``MP.<n>`` that no other column has."""
    taken, seen, out = set(names), set(), []
    for name in names:
        new, n = name, 0
        while new in seen or n and new in taken:
            n += 1
            new = f"{name}.{n}"
        seen.add(new)
        out.append(new)
    return out


def _header_row(grid: list[list[_Cell]], header_row: int | None) -> int:
    """Where the names are: the given row, else the first, or the second if
    the first is a row of headings over a row of headings."""
    if header_row is not None:
        return header_row
    heads = [bool(row) and all(c.head for c in row) for row in grid[:2]]
    return 1 if heads == [True, True] else 0


def page_tables(pages: DataFrame, header_row: int | None = None, first_only: bool = False) -> DataFrame:
    """All cells of all tables and lists, or of each page's first only (which is
    read no further): page_id, url, table_idx, row_idx,
    col_idx (from 0), cell text, first link target, whether the row lies below
    the header row, and the column's unique name (NULL beyond the header).

    A task holds one page, and the cells of ``CELLS_OUT`` places at a time."""
    names, kinds = zip(*((f.split()[0], _ARROW[f.split()[1]]) for f in TABLE_SCHEMA.split(", ")))

    def cells(page_id: int, url: str | None, html: str | None) -> Iterator[tuple]:
        for t, container in enumerate(_containers(html or "", first_only)):
            grid = container.grid()
            head = _header_row(grid, header_row)
            heads = unique_names([c.text for c in grid[head]]) if head < len(grid) else []
            for r, line in enumerate(grid):
                for c, cell in enumerate(line):
                    yield page_id, url, t, r, c, cell.text, cell.href, r > head, heads[c] if c < len(heads) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (cell for b in batches for page in zip(*b.columns) for cell in cells(*(x.as_py() for x in page)))
        while part := list(islice(read, CELLS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=list(names))

    # a page without an id has no cells that could be told apart: it is left out
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").alias("html"))
    return src.where("page_id is not null").mapInArrow(run, TABLE_SCHEMA)


_CELLS = ["page_id", "table_idx", "row_idx", "col_idx", "cell", "href"]


def page_cells(pages: DataFrame) -> DataFrame:
    """Long cells: page_id, table_idx, row_idx, col_idx, cell text and the
    first link target in the cell (NULL if none)."""
    return page_tables(pages).select(*_CELLS)


def page_first_table(pages: DataFrame) -> DataFrame:
    """The cells of the first table (or list) of each page."""
    return page_tables(pages, first_only=True).select(*_CELLS)


def header_promote(pages: DataFrame, header_row: int | None = None) -> DataFrame:
    """The rows below each table's header row, long, with their column name."""
    return page_tables(pages, header_row).where("is_body").select(
        "page_id", "table_idx", "row_idx", "col_idx", "col_name", "cell", "href")


def to_wide(named: DataFrame, names: Sequence[str], keys: Sequence[str] = ("page_id", "table_idx", "row_idx"),
            column: str = "col_name") -> DataFrame:
    """Long named cells to one row per table row with the listed columns: one
    aggregate over an explicit value list.  The cells of a row come from one
    task, which combines them before the shuffle."""
    name = F.col(column).cast("string")
    return named.groupBy(*keys).agg(*[F.first(F.when(name == n, F.col("cell")), ignorenulls=True).alias(n) for n in names])


def class_union(pages: DataFrame) -> DataFrame:
    """Cells of the first table of every page, stacked, with the page's class
    attached: one scan over all pages instead of one load per class."""
    first = page_tables(pages, first_only=True)
    return first.select("page_id", class_from_url(F.col("url")).alias("class_year"), *_CELLS[1:])


def raw_table(pages: DataFrame, columns: Sequence[str], header_row: int | None = None) -> DataFrame:
    """The first table of every page as rows of text: page_id, class_year,
    row_pos (row in page order) and the named ``columns`` (NULL where a page
    has no such column)."""
    keys = ["page_id", "class_year", "row_pos"]
    body = page_tables(pages, header_row, first_only=True).where("is_body").select(
        "page_id", class_from_url(F.col("url")).alias("class_year"), F.col("row_idx").alias("row_pos"), "col_name", "cell")
    return to_wide(body, columns, keys)


def stored_rows(raw: DataFrame) -> DataFrame:
    """``raw`` written to the shared folder and read back, for plans that read
    it several times: the pages are walked once."""
    path = scratch_path(raw.sparkSession, "page-rows")
    raw.write.parquet(path)
    return raw.sparkSession.read.schema(raw.schema).parquet(path)
