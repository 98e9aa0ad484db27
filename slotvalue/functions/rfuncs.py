"""Column expressions that reproduce R's missing-value and formatting rules
with built-in Spark functions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(agg_col: str, n: str = "_n", n_value: str = "_nv") -> Column:
    """An aggregate that is NULL when its group holds a NULL input, as R's
    ``sum``/``mean``/``median`` without ``na.rm``.  Expects the group's row
    count in ``n`` and non-NULL count in ``n_value``."""
    return F.when(F.col(n) == F.col(n_value), F.col(agg_col))


def flag(c: Column, focus) -> Column:
    """``ifelse(c == focus, "yes", "no")``: NULL in, NULL out."""
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c == F.lit(focus), "yes").otherwise("no")


def r_paste(*cols: Column) -> Column:
    """``paste0``: missing parts are written as the text ``NA``."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero or NULL denominator (R gives
    NaN/Inf; ANSI ``/`` raises)."""
    return F.try_divide(num, den)


def nan_to_null(c: Column) -> Column:
    """R's ``na.rm`` drops NaN as well as NA; Spark's ``avg`` would return NaN."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def percent_label(x: Column, digits: int = 1) -> Column:
    """``scales::percent(x, accuracy = 0.1)``: half-even rounding first,
    then fixed formatting."""
    return F.format_string(f"%.{digits}f%%", F.bround(x * 100, digits))


def number_label(x: Column, digits: int = 1) -> Column:
    """``fmt_number(decimals = 1)``: thousands separators, fixed decimals."""
    return F.format_number(x, digits)
