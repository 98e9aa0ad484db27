"""Report tables: exemplars per slot with an image path from a file
dimension, display labels, and one partitioned write for all slots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotvalue.functions.rfuncs import number_label

# Default display names of the report columns.
DISPLAY_LABELS = {"path": "", "name": "", "class_year": "Class", "exposure": "Exposure",
                  "value": "Total Value", "rate": "Value per Year"}


def slot_report(exemplars: DataFrame, images: DataFrame, *, slots: Iterable[int] | None = None,
                placeholder: str = "images/placeholder.jpg", key: str = "player_id") -> DataFrame:
    """Exemplars of the chosen slots (all when ``slots`` is None) with the
    image path of each entrant (``placeholder`` when the dimension has none).

    Left join on ``key``: a key repeated in the dimension repeats the row.
    The dimension is a file listing whose size is not known in advance, so
    no broadcast is forced; it is first cut down to the report's keys.
    """
    ex = exemplars if slots is None else exemplars.where(F.col("slot").isin(list(slots)))
    # the report holds a few rows per slot while the dimension can be large:
    # reduce the dimension to the report's keys first (a semi join whose
    # small side AQE can broadcast), then join the two small tables
    needed = images.select(key, "path").join(ex.select(key).distinct(), key, "left_semi")
    joined = ex.join(needed, key, "left")
    return joined.select(
        "slot", "category", "category_ord",
        F.coalesce(F.col("path"), F.lit(placeholder)).alias("path"),
        "name", "class_year", "exposure", "value", "rate",
        number_label(F.col("value")).alias("value_label"),
        number_label(F.col("rate")).alias("rate_label"))


def slot_report_placed(df: DataFrame, tie: Sequence[str] = ("class_year", "name", "path")) -> DataFrame:
    """The report with each row's place in its slot in report order; a slot
    has at most a few rows per category."""
    w = Window.partitionBy("slot").orderBy("category_ord", F.col("rate").desc_nulls_last(), *tie)
    return df.withColumn("place", F.row_number().over(w).cast("bigint"))


def report_order(df: DataFrame, tie: Sequence[str] = ("class_year", "name")) -> DataFrame:
    """Category order (Top, Middle, Bottom), then rate from high to low."""
    return df.orderBy("slot", "category_ord", F.col("rate").desc_nulls_last(), *tie)


def display_labels(df: DataFrame, labels: Mapping[str, str] = DISPLAY_LABELS) -> DataFrame:
    """Rename columns to display names (empty names become ``_`` + column)."""
    return df.withColumnsRenamed({k: (v or f"_{k}") for k, v in labels.items() if k in df.columns})


def write_slot_reports(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One job writes every slot's table as its own partition directory.

    The report holds at most nine rows per slot (three per category), so
    clustering it by slot puts a bounded number of rows in each task; rows
    are sorted in report order inside each file.
    """
    (report.repartition("slot")
     .sortWithinPartitions("category_ord", F.col("rate").desc_nulls_last(), "class_year", "name")
     .write.mode(mode).partitionBy("slot").parquet(path))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a chart-input table (slot summaries, band shares) as parquet."""
    df.write.mode(mode).parquet(path)
