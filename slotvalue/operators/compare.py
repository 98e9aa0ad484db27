"""Comparisons between slots stated in the analysis's prose, as queries over
the per-slot summaries (one row per slot, so their windows and sorts run
over a table as small as the number of slots)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lowest_mean(summary: DataFrame, *, first: int = 5, col: str = "avg") -> DataFrame:
    """The slot with the lowest mean among slots 1..first (lower slot on ties)."""
    return (summary.where(F.col("slot") <= first).orderBy(F.col(col).asc_nulls_last(), "slot")
            .limit(1).select("slot", col))


def nearest_mean(summary: DataFrame, *, focus: int = 2, col: str = "avg") -> DataFrame:
    """The other slot whose mean is nearest the focus slot's (lower slot on
    ties).  The focus mean is a scalar subquery, not a join."""
    fcol = "focus_" + col
    focus_val = summary.where(F.col("slot") == focus).select(F.max(col)).scalar()
    others = (summary.where(F.col("slot") != focus).select("slot", col, focus_val.alias(fcol))
              .withColumn("diff", F.abs(F.col(col) - F.col(fcol))))
    return others.orderBy(F.col("diff").asc_nulls_last(), "slot").limit(1)


def ratio_to_focus(summary: DataFrame, *, focus: int = 2, col: str = "med") -> DataFrame:
    """For every other slot, the focus slot's value divided by the slot's."""
    fcol = "focus_" + col
    focus_val = summary.where(F.col("slot") == focus).select(F.max(col)).scalar()
    return (summary.where(F.col("slot") != focus).select("slot", col, focus_val.alias(fcol))
            .withColumn("ratio", F.try_divide(F.col(fcol), F.col(col))))


def worst_rank(rank_summary: DataFrame, *, first: int = 5) -> DataFrame:
    """Slots 1..first ordered from worst (largest) mean and median class
    rank: position by mean and by median (``rank``, ties share a place)."""
    df = rank_summary.where(F.col("slot") <= first)
    return df.select(
        "slot", "avg_rank", "med_rank",
        F.rank().over(Window.orderBy(F.col("avg_rank").desc_nulls_last())).cast("bigint").alias("avg_pos"),
        F.rank().over(Window.orderBy(F.col("med_rank").desc_nulls_last())).cast("bigint").alias("med_pos"))


def bust_rank(shares: DataFrame, *, bands=("bust", "mega_bust")) -> DataFrame:
    """Slots ranked by their combined share of the given bands, largest first."""
    per_slot = shares.groupBy("slot").agg(
        F.coalesce(F.sum(F.when(F.col("band").isin(list(bands)), F.col("prop"))), F.lit(0.0))
        .alias("bust_share"))
    return per_slot.select(
        "slot", "bust_share",
        F.rank().over(Window.orderBy(F.col("bust_share").desc())).cast("bigint").alias("bust_pos"))
