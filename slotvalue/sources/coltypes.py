"""Column types of page tables: the narrowest type that holds all cells of a
column, and rows with their columns in those types.

Kinds of cells are bits, so the kinds of a column are one ``bit_or``: it is
combined in the map tasks, and the kinds of a column over many pages are the
``bit_or`` of the pages' kinds.  Rules of the type conversion that table
readers apply to text:

- missing: NULL, blank text and ``NA``; a column of nothing else is logical;
- logical: ``T F TRUE FALSE true false``;
- integer: digits with an optional sign, at most 2147483647 in size;
- double: decimal numbers, ``Inf`` (signed), ``infinity`` and ``NaN``;
- text: everything else, hexadecimal numbers included.

Integers and doubles together are double; logical cells beside numbers make
the column text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.text import NUMERIC, parse_number
from slotvalue.sources.pages import page_tables, raw_table, stored_rows

# Fixed values of the conversion rules.
TRUE_WORDS = ["T", "TRUE", "true"]
FALSE_WORDS = ["F", "FALSE", "false"]
MISSING_WORD = "NA"
INTEGER = r"^\s*[-+]?\d+\s*$"
MAX_INTEGER = 2147483647
SPECIAL = r"^\s*([-+]?(Inf|(?i:infinity))|NaN)\s*$"

LOGICAL_BIT, INTEGER_BIT, DOUBLE_BIT, TEXT_BIT = 1, 2, 4, 8
#: Spark's name of each type.
SPARK_TYPES = {"logical": "boolean", "integer": "bigint", "double": "double", "text": "string"}


def _bare(c: Column) -> Column:
    """Text without the white space around it (tabs and line ends too)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def is_missing(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*$") | (_bare(c) == MISSING_WORD)


def cell_kind(c: Column) -> Column:
    """The bit of a cell's own type; 0 for a missing cell."""
    return (F.when(is_missing(c), 0)
            .when(_bare(c).isin(TRUE_WORDS + FALSE_WORDS), LOGICAL_BIT)
            .when(c.rlike(INTEGER) & (F.abs(parse_number(c)) <= MAX_INTEGER), INTEGER_BIT)
            .when(c.rlike(NUMERIC) | c.rlike(SPECIAL), DOUBLE_BIT)
            .otherwise(TEXT_BIT))


def type_of(kinds: Column) -> Column:
    """The type of a column whose cells have these kinds (``bit_or``)."""
    return (F.when(kinds <= LOGICAL_BIT, "logical")
            .when((kinds >= TEXT_BIT) | (kinds.bitwiseAND(LOGICAL_BIT) > 0), "text")
            .when(kinds >= DOUBLE_BIT, "double")
            .otherwise("integer"))


def typed(c: Column, name: str) -> Column:
    """Text cells as a column of the named type.  Missing cells are NULL, but
    blank text stays in a text column."""
    if name == "text":
        return F.when(_bare(c) != MISSING_WORD, c)
    if name == "logical":
        return F.when(_bare(c).isin(TRUE_WORDS), True).when(_bare(c).isin(FALSE_WORDS), False)
    if name == "integer":
        return F.when(c.rlike(INTEGER), _bare(c).try_cast("bigint"))
    if name == "double":
        return F.when(c.rlike(NUMERIC) | c.rlike(SPECIAL), _bare(c).try_cast("double"))
    raise ValueError(f"no such type: {name}")


def column_types(pages: DataFrame, header_row: int | None = None, first_only: bool = False) -> DataFrame:
    """One row per page column below the header: page_id, table_idx, col_idx,
    col_name, n_cells, n_missing and type.  A column without cells has no row."""
    body = page_tables(pages, header_row, first_only).where("is_body")
    cell = F.col("cell")
    return (body.groupBy("page_id", "table_idx", "col_idx", "col_name")
            .agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(is_missing(cell)).alias("n_missing"),
                 F.bit_or(cell_kind(cell)).alias("_kinds"))
            .withColumn("type", type_of(F.col("_kinds"))).drop("_kinds"))


def stacked_types(raw: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The type of each of ``columns`` over all rows: one aggregate with one
    value a column reaches the driver, as when a reader infers a schema."""
    kinds = [type_of(F.coalesce(F.bit_or(cell_kind(F.col(f"`{c}`"))), F.lit(0))).alias(str(i))
             for i, c in enumerate(columns)]
    return dict(zip(columns, raw.agg(*kinds).head()))


def typed_table(pages: DataFrame, columns: Sequence[str], header_row: int | None = None,
                types: Mapping[str, str] | None = None) -> DataFrame:
    """The first table of every page as typed rows: page_id, class_year,
    row_pos and ``columns``, each in the one type that holds its cells on all
    pages.  Where ``types`` are given (column to ``logical``, ``integer``,
    ``double`` or ``text``) the pages are read once and a cell that does not fit
    is NULL; else the rows are stored and a first pass over them infers them."""
    raw = raw_table(pages, columns, header_row)
    if types is None:
        raw = stored_rows(raw)
    known = dict(types) if types is not None else stacked_types(raw, columns)
    return raw.select("page_id", "class_year", "row_pos",
                      *[typed(F.col(f"`{c}`"), known[c]).cast(SPARK_TYPES[known[c]]).alias(c) for c in columns])
