"""Slot summaries: value by slot (total, mean, exact median), dense rank of
value within each class, and mean / median class rank by slot."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotvalue.functions.rfuncs import flag, guarded
from slotvalue.operators.ordinal import number_within, place_among


#: Shares of the rows at which the middle is looked for: 41 bounds, as close as
#: the sketch can tell them apart, out to 20 times its error.
_NEAR = [0.5 + i / 10_000 for i in range(-20, 21)]
_ACCURACY = 10_000


def summarise_by(df: DataFrame, keys: Sequence[str], value: str, median: str = "exact") -> DataFrame:
    """Per group: ``_n`` rows, ``_nv`` non-NULL values, ``_total``, ``_avg``
    and ``_med`` of ``value``.

    ``median="exact"``: the first pass takes, with the sums, a sketch's bounds
    around the middle (``percentile_approx``, off by one part in ``_ACCURACY``
    of the rows at most).  The second counts the values between two neighbouring
    bounds one by one, with a partial aggregate, and all others as two numbers.
    The counts tell for certain which stretch holds the middle; a running sum
    over its values alone, some ten thousandth of the group, finds it.  Were the
    sketch worse than it promises, the count would show it and raise an error.
    No task holds a whole group (``percentile``/``median`` merge every distinct
    value of a group in one task).

    ``median="approx"``: ``percentile_approx`` alone.
    """
    if median not in ("exact", "approx"):
        raise ValueError(f"unknown median method {median!r}")
    base = [F.count(F.lit(1)).alias("_n"), F.count(value).alias("_nv"),
            F.sum(value).alias("_total"), F.avg(value).alias("_avg")]
    if median == "approx":
        return df.groupBy(*keys).agg(*base, F.percentile_approx(value, 0.5, _ACCURACY).cast("double").alias("_med"))
    stats = df.groupBy(*keys).agg(*base, F.percentile_approx(value, _NEAR, _ACCURACY).alias("_ends"))
    group = [f"_s{i}" for i in range(len(keys))]
    bounds = stats.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], "_nv", "_ends")
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, group)]
    top = len(_NEAR)
    stretch = F.when(F.col("_v") < F.col("_ends")[0], -1).when(F.col("_v") > F.col("_ends")[top - 1], top).otherwise(
        place_among(F.col("_ends"), F.col("_v"), math.ceil(math.log2(top + 1))))
    inner = (F.col("_stretch") >= 0) & (F.col("_stretch") < top)
    near = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull()).join(bounds, same) \
        .withColumn("_stretch", stretch).groupBy(*group, "_stretch", F.when(inner, F.col("_v")).alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_nv").alias("_nv"))
    lo, hi = F.floor((F.col("_nv") + 1) / 2), F.ceil((F.col("_nv") + 1) / 2)
    sizes = near.groupBy(*group, "_stretch").agg(F.sum("_c").alias("_held"), F.first("_nv").alias("_nv"))
    below = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_held").over(below), F.lit(0)))
    chosen = sizes.where(((F.col("_before") < lo) & (lo <= F.col("_before") + F.col("_held")))
                         | ((F.col("_before") < hi) & (hi <= F.col("_before") + F.col("_held"))))
    chosen = chosen.select(*[F.col(c).alias(f"{c}_") for c in [*group, "_stretch"]], "_before")
    values = near.join(chosen, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*group, "_stretch"]])
    upto = Window.partitionBy(*group, "_stretch").orderBy("_v")
    values = values.withColumn("_upto", F.col("_before") + F.sum("_c").over(upto))
    known = F.when(inner, F.col("_v")).otherwise(F.raise_error(F.lit("the middle lies outside the sketch's bounds")).cast("double"))

    def at(place: Column) -> Column:
        return F.min(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_c") < place), known))

    mid = values.groupBy(*group).agg(((at(lo) + at(hi)) / 2).cast("double").alias("_med"))
    return stats.join(mid, same, "left").select(*keys, "_n", "_nv", "_total", "_avg", "_med")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "med") -> DataFrame:
    """Exact median of ``value`` per group (NULL if the group holds a NULL)."""
    return summarise_by(df, keys, value).select(*keys, guarded("_med").alias(out))


def slot_value(entrants: DataFrame, *, value: str = "value", slot: str = "slot",
               max_slot: int | None = 30, focus_slot: int = 2, median: str = "exact") -> DataFrame:
    """Total, mean and median value by slot, with rounded labels and a flag
    for the focus slot; slots above ``max_slot`` are dropped.

    Sum, mean and median are NULL for a slot holding a NULL value (R's
    missing-propagating aggregates).  Entrants with zero exposure are kept.
    The slot filter is on the grouping key, so it is applied before the
    aggregate (the same plan Catalyst derives from filter-after-summarise).
    """
    df = entrants if max_slot is None else entrants.where(F.col(slot) <= max_slot)
    out = summarise_by(df, [slot], value, median)
    total, avg, medc = guarded("_total"), guarded("_avg"), guarded("_med")
    return out.select(
        F.col(slot).alias("slot"), total.alias("total"), avg.alias("avg"), medc.alias("med"),
        F.bround(avg, 1).alias("label_avg"), F.bround(medc, 1).alias("label_med"),
        flag(F.col(slot), focus_slot).alias("highlight"))


def class_rank(entrants: DataFrame, *, value: str = "value", klass: str = "class_year",
               exposure: str = "exposure", tie: Sequence[str] = ("id",),
               out: str = "class_rank") -> DataFrame:
    """Dense rank of value, best first, within each class, over entrants with
    exposure > 0.  NULL values get a NULL rank.

    Computed with the skew-safe numbering operator (dense rank over the
    value), so a class holding most entrants is still split across tasks.
    """
    played = entrants.where(F.col(exposure) > 0)
    ranked = number_within(played, [klass], [(value, "desc"), *tie], dense_on=1, rn="_rn", n="_n", dr="_dr")
    return ranked.select(*played.columns,
                         F.when(F.col(value).isNull(), F.lit(None))
                          .otherwise(F.col("_dr")).cast("bigint").alias(out))


def slot_rank(ranked: DataFrame, *, rank: str = "class_rank", slot: str = "slot",
              max_slot: int | None = 30, focus_slot: int = 2, median: str = "exact") -> DataFrame:
    """Mean and median class rank by slot.  The slot filter comes after the
    class ranking (ranks are computed over all slots)."""
    df = ranked if max_slot is None else ranked.where(F.col(slot) <= max_slot)
    out = summarise_by(df, [slot], rank, median)
    avg, medc = guarded("_avg"), guarded("_med")
    return out.select(
        F.col(slot).alias("slot"), avg.alias("avg_rank"), medc.alias("med_rank"),
        F.bround(avg, 1).alias("label_avg"), F.bround(medc, 1).alias("label_med"),
        flag(F.col(slot), focus_slot).alias("highlight"))
