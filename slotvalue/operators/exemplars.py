"""Exemplars: the bottom, top and middle three entrants of each slot by rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotvalue.functions.rfuncs import safe_ratio
from slotvalue.operators.bands import mature
from slotvalue.operators.ordinal import number_within

# Exemplar categories in display order.
CATEGORIES = ["Top", "Middle", "Bottom"]


def label(category: str, k: int) -> str:
    return f"{category} {k}"


def category_ord(c: Column, k: int = 3) -> Column:
    expr = F.lit(None).cast("bigint")
    for i, name in reversed(list(enumerate(CATEGORIES, start=1))):
        expr = F.when(c == label(name, k), F.lit(i).cast("bigint")).otherwise(expr)
    return expr


def exemplars(entrants: DataFrame, *, as_of: str, max_slot: int = 14, years: int = 4, k: int = 3,
              value: str = "value", exposure: str = "exposure", slot: str = "slot",
              klass: str = "class_year", tie: Sequence[str] = ("class_year", "id")) -> DataFrame:
    """Bottom, top and middle ``k`` (default 3) mature entrants with exposure
    > 0 in each slot up to ``max_slot``, by rate = value / exposure.

    Rows are put in (rate asc NULLS LAST, tie) order within the slot by the
    skew-safe numbering operator, giving each row its position ``rn`` and the
    slot size ``n``:

    * bottom k: ``rn <= k``;
    * middle k: the k rows nearest position (n + 1) / 2, the lower one first
      on equal distance (a filter on ``rn`` and ``n``);
    * top k: the first k by (rate desc NULLS LAST, rn).

    All three come from one pass over the numbered rows: a filter keeps the
    rows that can be in a category (for the top, the first k of each bucket of
    the numbering, which are together already), and only those are ranked and
    get one row per category.  In a slot of fewer than 3k rows one entrant can
    hold several categories.
    """
    base = mature(entrants.where((F.col(slot) <= max_slot) & (F.col(exposure) > 0)), as_of, years, klass)
    rated = base.withColumn("rate", safe_ratio(F.col(value), F.col(exposure)))
    numbered = number_within(rated, [slot], ["rate", *tie], rn="rn", n="n", bucket="_bucket")
    mid = (F.col("n") + 1) / 2
    best = [F.col("rate").desc_nulls_last(), F.col("rn")]
    # middle: in (middle_dist, rn) order the i-th row has
    # i = 2 * middle_dist + (0 below the centre, 1 at or above it), for odd
    # and even n alike, so the middle k rows are a filter, not a sort
    order_idx = 2 * F.col("middle_dist") + F.when(F.col("rn") < mid, 0).otherwise(1)
    numbered = (numbered.withColumn("middle_dist", F.abs(F.col("rn") - mid))
                .withColumn("_in_bucket", F.row_number().over(Window.partitionBy("_bucket").orderBy(*best))))
    few = numbered.where((F.col("rn") <= k) | (order_idx <= k) | (F.col("_in_bucket") <= k))
    few = few.withColumn("_t", F.row_number().over(Window.partitionBy(slot).orderBy(*best)))
    top, middle, bottom = [label(c, k) for c in CATEGORIES]
    held = F.array(F.when(F.col("rn") <= k, F.lit(bottom)), F.when(F.col("_t") <= k, F.lit(top)),
                   F.when(order_idx <= k, F.lit(middle)))
    out = few.withColumn("category", F.explode(F.array_compact(held)))
    return out.drop("_bucket", "_in_bucket", "_t").withColumn("category_ord", category_ord(F.col("category"), k))
