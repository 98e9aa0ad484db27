"""Outcome bands: each mature entrant's rate against the mean and standard
deviation of all rates, shares of each band by slot, stacked-bar bounds and
the zero-filled slot x band grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotvalue.functions.rfuncs import nan_to_null, percent_label, safe_ratio

# Band names and their level order (best first), as in the
# analysis being reproduced.
BANDS = ["mega_boom", "boom", "role_player", "bust", "mega_bust"]
# Display labels of the bands.
BAND_LABELS = {"mega_boom": "Mega Boom", "boom": "Boom", "role_player": "Role Player",
               "bust": "Bust", "mega_bust": "Mega Bust"}


def band_ord(band: Column) -> Column:
    """Level position of a band (1 = mega_boom ... 5 = mega_bust)."""
    expr = F.lit(None).cast("bigint")
    for i, b in reversed(list(enumerate(BANDS, start=1))):
        expr = F.when(band == b, F.lit(i).cast("bigint")).otherwise(expr)
    return expr


def band_label(band: Column) -> Column:
    return F.create_map(*[x for k, v in BAND_LABELS.items() for x in (F.lit(k), F.lit(v))])[band]


def mature(df: DataFrame, as_of: str, years: int = 4, klass: str = "class_year") -> DataFrame:
    """Classes at least ``years`` before the year of ``as_of`` (a parameter,
    never the current date, so results do not drift)."""
    return df.where(F.col(klass) <= F.year(F.lit(as_of).cast("date")) - years)


def band_assign(entrants: DataFrame, *, as_of: str, max_slot: int = 14, years: int = 4,
                value: str = "value", exposure: str = "exposure", slot: str = "slot",
                klass: str = "class_year") -> DataFrame:
    """Rate = value / exposure for mature entrants in slots up to
    ``max_slot``; band by distance of the rate from the mean, in standard
    deviations (bounds at -1, -0.5, +0.5, +1; strict ``<``).  Zero exposure is
    ``mega_bust``; a NULL rate with non-zero exposure falls through to
    ``mega_boom`` (no test matches), as in the analysis reproduced.

    Mean and sample standard deviation are over all filtered rows with a
    rate.  They are one scalar subquery (a global partial aggregate), not a
    window without partition (which would put every row in one task) and not
    a join.
    """
    base = mature(entrants.where(F.col(slot) <= max_slot), as_of, years, klass)
    rated = base.withColumn("rate", nan_to_null(safe_ratio(F.col(value), F.col(exposure))))
    stats = rated.select(F.struct(F.avg("rate").alias("m"), F.stddev_samp("rate").alias("s"))).scalar()
    # the subquery is attached once as a column and its fields referenced
    # from there, so it is planned (and run) once
    rated = rated.withColumn("_stats", stats)
    m, s = F.col("_stats.m"), F.col("_stats.s")
    r = F.col("rate")
    band = (F.when(F.col(exposure) == 0, "mega_bust")
            .when(r < m - s, "mega_bust")
            .when(r < m - 0.5 * s, "bust")
            .when(r < m + 0.5 * s, "role_player")
            .when(r < m + s, "boom")
            .otherwise("mega_boom"))
    return (rated.withColumn("mean_rate", m).withColumn("sd_rate", s)
            .withColumn("band", band).withColumn("band_ord", band_ord(F.col("band"))).drop("_stats"))


def band_share(assigned: DataFrame, *, slot: str = "slot") -> DataFrame:
    """Count and share of each observed band per slot, with a percent label.
    The share window runs over the aggregated (slot, band) rows: at most
    five per slot."""
    counts = assigned.groupBy(slot, "band").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(slot)
    prop = F.col("count") / F.sum("count").over(w)
    return (counts.withColumn("prop", prop)
            .select(F.col(slot).alias("slot"), "band", band_ord(F.col("band")).alias("band_ord"),
                    F.col("count").cast("bigint").alias("count"), "prop",
                    percent_label(F.col("prop")).alias("label")))


def band_stack(shares: DataFrame) -> DataFrame:
    """Stacked-bar bounds per slot: the last level (mega_bust) at the bottom,
    each segment from ``ymin`` to ``ymax`` with the label at ``ymid``."""
    w = (Window.partitionBy("slot").orderBy(F.col("band_ord").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ymax = F.sum("prop").over(w)
    return (shares.select("slot", "band", "band_ord", "prop", "label")
            .withColumn("ymax", ymax)
            .withColumn("ymin", F.col("ymax") - F.col("prop"))
            .withColumn("ymid", F.col("ymax") - F.col("prop") / 2))


def band_zero_fill(assigned: DataFrame, *, slot: str = "slot") -> DataFrame:
    """Every slot with every band; bands never seen in a slot get count 0 and
    share 0.  One aggregate counts each band per slot, and every slot's row
    is exploded into its five bands."""
    counts = assigned.groupBy(F.col(slot).alias("slot")).agg(
        F.count("band").alias("_n"), *[F.count_if(F.col("band") == b).alias(b) for b in BANDS])
    filled = counts.select("slot", "_n", F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(b).alias("count")) for b in BANDS])).alias("b"))
    return filled.select("slot", "b.band", band_ord(F.col("b.band")).alias("band_ord"),
                         F.col("b.count").cast("bigint").alias("count"), (F.col("b.count") / F.col("_n")).alias("prop"),
                         band_label(F.col("b.band")).alias("band_label"))
