"""Exact row numbers, dense ranks and group sizes within groups, without
putting any group into one task.

``Window.partitionBy(g)`` sends every row of a group to one task.  When one
group holds a large share of the rows (one slot, one class, one name key
for a third of the table) that task holds the whole group.  This operator
computes the same ``row_number`` / ``dense_rank`` / ``count(*) over (g)``
values in three steps, all with built-in functions:

1. one aggregate takes quantile bounds of every order column over the whole
   table (``percentile_approx``, a sketch of bounded size), attached as a
   scalar subquery.  A row's bucket is its place among the bounds of the
   leading order column.  Rows that equal a bound (a value that many rows
   share) have a bucket of their own, which the next order column's bounds
   split in the same way, and so on;
2. numbers are counted within (group, bucket), which holds about one part in
   ``buckets`` of all rows at most;
3. rows per (group, bucket) come from a partial aggregate; running sums over
   the few buckets of each group give the offsets, joined on (group, bucket).

Nothing runs while the plan is built.  A bucket cannot be split where all
order columns tie, where a bound falls among integers beyond 2**53 (bounds
are taken as doubles) or where the tied column is text (its first seven bytes
are compared with the bounds); the numbers are exact in every case.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An order column: its name (ascending) or (name, "asc" / "desc"); NULLs last.
Order = str | tuple[str, str]


def _parsed(order: Sequence[Order]) -> list[tuple[str, bool]]:
    return [(o, False) if isinstance(o, str) else (o[0], o[1] == "desc") for o in order]


def _sorted_by(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order]


def _measure(kind: T.DataType, name: str, desc: bool) -> tuple[Column, bool]:
    """(a number that never falls along the order, whether equal numbers mean
    equal values)."""
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (-c if desc else c).cast("double"), True
    if isinstance(kind, T.DecimalType):
        return (-c if desc else c).cast("double"), False
    exact = True
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        v = c.cast("long")
    elif isinstance(kind, T.DateType):
        v = F.unix_date(c).cast("long")
    elif isinstance(kind, T.TimestampType):
        v = F.unix_micros(c)
    elif isinstance(kind, T.StringType):
        v, exact = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"), False
    else:
        v, exact = F.when(c.isNotNull(), F.lit(0).cast("long")), False
    return (F.bitwise_not(v) if desc else v), exact


def place_among(bounds: Column, value: Column, depth: int) -> Column:
    """The number of ``bounds`` (an ascending array of up to 2**depth - 1
    values) below ``value``, by binary search."""
    return F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(depth))]), F.lit(0),
        lambda found, step: found + F.when(F.try_element_at(bounds, found + step) < value, step).otherwise(F.lit(0)))


def _with_buckets(df: DataFrame, order: list[tuple[str, bool]], parts: int) -> tuple[DataFrame, list[str]]:
    """``df`` with one bucket column per order column."""
    depth = max(1, math.ceil(math.log2(parts)))
    m = (1 << depth) - 1
    measures = [_measure(df.schema[c].dataType, c, desc) for c, desc in order]

    def nan(c: str) -> Column:
        floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        return F.coalesce(F.isnan(c), F.lit(False)) if floating else F.lit(False)

    shares = [i / (m + 1) for i in range(1, m + 1)]
    bounds = df.select(F.struct(*[
        F.percentile_approx(F.when(~nan(c), p), shares, 10 * (m + 1)).alias(f"c{i}")
        for i, ((c, _), (p, _)) in enumerate(zip(order, measures))])).scalar()
    out = df.withColumn("_bounds", bounds)
    split, names = F.lit(True), []
    for i, ((c, desc), (p, exact)) in enumerate(zip(order, measures)):
        at, null = F.col(f"_bounds.c{i}"), F.col(c).isNull()
        # later columns are looked at only where the earlier ones tie
        out = out.withColumn(f"_below{i}", F.when(split, place_among(at, p, depth)))
        tie = F.coalesce(F.try_element_at(at, F.col(f"_below{i}") + 1) == p, F.lit(False)) if exact else F.lit(False)
        code = 2 * F.col(f"_below{i}") + tie.cast("int")
        code = F.when(null, 2 * m + 3).when(nan(c), -1 if desc else 2 * m + 2).otherwise(code)
        # never NULL, and Spark knows it: else it tests the buckets' join keys for NULL early, on the rows below an
        # aggregate that makes ``df``, and works them out for each of those
        out = out.withColumn(f"_b{i}", F.coalesce(F.when(split, code), F.lit(-2)))
        names.append(f"_b{i}")
        split = split & (null | nan(c) | tie)
    return out, names


def _plain_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """NULL-free copies of the keys, so that windows, aggregates and the join
    share one hash partitioning."""
    names = []
    for i, k in enumerate(keys):
        kind, c = df.schema[k].dataType, F.col(k)
        plain = F.coalesce(c, F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.coalesce(c.cast("string"), F.lit(""))
        df = df.withColumn(f"_k{i}", plain).withColumn(f"_null{i}", c.isNull())
        names += [f"_k{i}", f"_null{i}"]
    return df, names


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Order], *,
                  dense_on: int = 0, buckets: int | None = None,
                  rn: str = "rn", n: str = "n", dr: str | None = None, bucket: str | None = None) -> DataFrame:
    """Add ``rn`` (row_number within ``keys`` ordered by ``order``), ``n``
    (group size) and, when ``dr`` is given, the dense rank of the first
    ``dense_on`` order columns within the group.

    ``order`` should make the order total (end it with a unique column) for a
    deterministic ``rn``; ``n`` and the dense rank do not depend on ties.
    ``buckets`` (default: twice ``spark.sql.shuffle.partitions``) is how
    finely a large group is split.  ``bucket`` names a column that keeps the
    (group, bucket) of each row: rows with equal values are together already.
    """
    spec, cols = _parsed(order), list(df.columns)
    parts = buckets or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, bs = _with_buckets(df, spec, parts)
    rows, ks = _plain_keys(rows, list(keys))
    rows = rows.select(*cols, *ks, *bs)
    lead = [c for c, _ in spec[:dense_on]]
    if dr:
        values = rows.groupBy(*ks, *bs, *lead).agg(F.count(F.lit(1)).alias("c"))
        sizes = values.groupBy(*ks, *bs).agg(F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_d"))
    else:
        sizes = rows.groupBy(*ks, *bs).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*ks) if ks else Window.partitionBy(F.lit(0))
    up = group.orderBy(*bs)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_row_off"), F.sum("_c").over(group).alias("_total")]
    if dr:
        # a tied value that is split over several buckets is one value
        again = F.lit(True)
        for b in bs[:dense_on]:
            again = again & (F.lag(b).over(up) == F.col(b))
        sizes = sizes.withColumn("_again", F.coalesce(again, F.lit(False)).cast("int"))
        offsets.append((F.coalesce(F.sum("_d").over(before), F.lit(0)) - F.sum("_again").over(
            up.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("_dense_off"))
    side = sizes.select(*ks, *bs, *offsets)
    own = Window.partitionBy(*ks, *bs)
    numbered = rows.withColumn("_rn", F.row_number().over(own.orderBy(*_sorted_by(spec))))
    if dr:
        numbered = numbered.withColumn("_dr", F.dense_rank().over(own.orderBy(*_sorted_by(spec[:dense_on]))))
    out = numbered.join(side, [*ks, *bs])
    added = [(F.col("_rn") + F.col("_row_off")).cast("bigint").alias(rn), F.col("_total").cast("bigint").alias(n)]
    if dr:
        added.append((F.col("_dr") + F.col("_dense_off")).cast("bigint").alias(dr))
    if bucket:
        added.append(F.struct(*ks, *bs).alias(bucket))
    return out.select(*cols, *added)


def rows_between(df: DataFrame, order: Sequence[Order], first: int, last: int, *, buckets: int | None = None,
                 rn: str = "rn") -> DataFrame:
    """The rows at places ``first`` to ``last`` (from 1) of ``df`` in
    ``order``, with their place as ``rn``.

    Rows are counted by bucket, and only the buckets that hold the wanted
    places are sorted, so a place deep in a large table costs no more than one
    near its beginning and no task sorts more than a bucket."""
    spec, cols = _parsed(order), list(df.columns)
    parts = buckets or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, bs = _with_buckets(df, spec, parts)
    sizes = rows.groupBy(*bs).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(F.lit(0)).orderBy(*bs).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = sizes.withColumn("_upto", F.sum("_c").over(upto)).where((F.col("_upto") >= first) & (F.col("_upto") - F.col("_c") < last))
    near = rows.join(held.select(*bs, (F.col("_upto") - F.col("_c")).alias("_before")), bs)
    place = F.row_number().over(Window.partitionBy(*bs).orderBy(*_sorted_by(spec))) + F.col("_before")
    return near.withColumn("_rn", place).where(F.col("_rn").between(first, last)).select(*cols, F.col("_rn").cast("bigint").alias(rn))
