"""Typed entrants from raw (all-text) page tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.text import empty_zero_number, parse_number
from slotvalue.operators.keys import entity_key
from slotvalue.sources.pages import raw_table, stored_rows


# Column names of the page tables.
PAGE_COLUMNS = ["Pk", "Player", "Yrs", "WS", "VORP"]


def clean_entrants(raw: DataFrame, *, slot_col: str = "Pk", name_col: str = "Player",
                   exposure_col: str = "Yrs", value_col: str = "WS", value2_col: str = "VORP",
                   klass: str = "class_year", row_pos: str = "row_pos", keep: Sequence[str] = ()) -> DataFrame:
    """Parse the slot, exposure and values of a raw page table and keep rows
    with a parsed slot and a non-empty name (repeated header rows and
    separators parse to a NULL slot).

    Exposure and values: ``""`` is 0, non-numeric text is NULL.  The slot is
    a number, fractions included.  Columns of ``keep`` stay as they are.
    """
    typed = raw.select(
        F.col(klass).cast("bigint").alias("class_year"),
        parse_number(F.col(slot_col)).alias("slot"),
        F.col(name_col).alias("name"),
        empty_zero_number(F.col(exposure_col)).alias("exposure"),
        empty_zero_number(F.col(value_col)).alias("value"),
        empty_zero_number(F.col(value2_col)).alias("value2"),
        F.col(row_pos).cast("bigint").alias("row_pos"), *keep,
    )
    return typed.where(F.col("slot").isNotNull() & (F.col("name") != ""))


def load_pages(pages: DataFrame, header_row: int | None = None) -> DataFrame:
    """Typed entrants with their entity keys, straight from stored pages: the
    first table of each page, its class from the page's url.  Equal names are
    numbered by class, page and row.  The rows are stored, as numbering reads
    them several times."""
    typed = clean_entrants(stored_rows(raw_table(pages, PAGE_COLUMNS, header_row)), keep=["page_id"])
    return entity_key(typed, order=("class_year", "page_id", "row_pos"))
