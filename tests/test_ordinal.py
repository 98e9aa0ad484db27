"""The skew-safe numbering operator equals Spark's window functions."""

import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotvalue.operators import slots
from slotvalue.operators.ordinal import number_within, rows_between
from slotvalue.operators.slots import exact_median


def _data(spark, n=2000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one key holds about half the rows; NULL keys and values included
        g = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None, f"c{rnd.randint(0, 150)}"])
        v = rnd.choice([None, 1.0, 2.0, 2.0]) if rnd.random() < 0.4 else float(rnd.randint(0, 30))
        rows.append((i, g, rnd.randint(0, 2), v))
    return spark.createDataFrame(rows, "id long, g string, h int, v double")


def check(df, keys, order, dense, **more):
    """number_within against Spark's windows, row by row."""
    got = number_within(df, keys, order, dense_on=dense, dr="dr", **more).select("id", "rn", "n", "dr")
    by = [F.col(o).asc_nulls_last() if isinstance(o, str) else F.col(o[0]).desc_nulls_last() for o in order]
    ws = W.partitionBy(*keys)
    exp = df.select("id", F.row_number().over(ws.orderBy(*by)).cast("long").alias("rn"),
                    F.count("*").over(ws).alias("n"),
                    F.dense_rank().over(ws.orderBy(*by[:dense])).cast("long").alias("dr"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


@pytest.mark.parametrize("buckets", [1, 2, 16, 200])
def test_matches_windows(spark, buckets):
    check(_data(spark), ["g", "h"], [("v", "desc"), "id"], 1, buckets=buckets)
    check(_data(spark), ["g"], ["v", ("h", "desc"), "id"], 2, buckets=buckets)


def test_large_integers_nan_and_ties(spark):
    """Bigints beyond 2**53 with NULLs, NaN (largest), all values tied."""
    big = 9007199254740993
    rows = [(i, "k" if i % 10 else "z", big + i % 7 if i % 5 else None, float("nan") if i % 6 == 0 else float(i % 4), 1.0,
             f"name{i % 3}", -0.0 if i % 2 else 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, b long, f double, one double, s string, zero double")
    for order, dense in ([["b", "id"], 1], [[("b", "desc"), "id"], 1], [["f", "id"], 1], [[("f", "desc"), ("id", "desc")], 1],
                         [["one", "f", "id"], 2], [["s", "id"], 1], [[("s", "desc"), "b", "id"], 2], [["zero", "id"], 1]):
        check(df, ["g"], order, dense, buckets=8)
    kept = number_within(df, ["g"], ["b", "id"], buckets=8).select("id", "b", "f").collect()
    assert {r.id: r.b for r in kept} == {r[0]: r[2] for r in rows}
    assert sum(r.f != r.f for r in kept) == sum(r[3] != r[3] for r in rows)


def test_other_types_of_order_and_key(spark):
    df = spark.range(200).select(
        "id", (F.col("id") % 2 == 0).alias("flag"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("day"),
        (F.col("id") % 5).cast("decimal(9,2)").alias("dec"), F.timestamp_seconds(F.col("id") % 11).alias("ts"),
        F.array(F.col("id") % 3).alias("arr"))
    for order in (["flag", "id"], [("day", "desc"), "id"], ["dec", "id"], [("ts", "desc"), "id"], ["arr", "id"]):
        check(df, ["day"], order, 1, buckets=4)
    check(df, ["ts", "flag"], ["id"], 1, buckets=4)
    check(df, [], ["id"], 1, buckets=4)


def test_a_hot_key_is_split(spark):
    """One key with 90 % of the rows, most of them tied in the first order
    column: no (group, bucket) holds more than a small part."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"),
                                    F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(0).alias("v"))
    out = number_within(df, ["g"], ["v", "id"], buckets=32, bucket="bucket")
    assert out.groupBy("bucket").count().agg(F.max("count")).first()[0] < 20_000 / 10
    check(df, ["g"], ["v", "id"], 1, buckets=32)


def test_nothing_runs_at_build_time_and_no_python(spark):
    df = spark.range(100).withColumn("g", F.lit("k")).withColumn("v", F.raise_error(F.lit("ran")).cast("long"))
    out = number_within(df, ["g"], ["v", "id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, g string")
    assert number_within(df, ["g"], ["id"]).count() == 0


def test_single_group_spans_partitions(spark):
    df = spark.range(0, 500).withColumn("g", F.lit("k"))
    got = number_within(df, ["g"], ["id"], buckets=7)
    row = got.agg(F.min("rn"), F.max("rn"), F.min("n"), F.max("n"),
                  F.sum((F.col("rn") == F.col("id") + 1).cast("int"))).first()
    assert tuple(row) == (1, 500, 500, 500, 500)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 4))),
                     min_size=1, max_size=60), buckets=st.integers(1, 5))
def test_property_matches_windows(spark, rows, buckets):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v int")
    check(df, ["g"], ["v", "id"], 1, buckets=buckets)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.integers(-3, 3), st.floats(-5, 5))), min_size=1, max_size=80))
def test_exact_median_of_any_rows(spark, rows):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k int, v double")
    got = {r.k: r.med for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(float(v) for j, v in rows if j == k) for k in {k for k, _ in rows}}


def test_exact_median_of_many_rows(spark):
    """More rows than the sketch keeps, with a value that half of them share."""
    df = spark.range(60_000).select((F.col("id") % 3 == 0).alias("k"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(
        F.pmod(F.xxhash64("id"), 1_000_003).cast("double")).alias("v"))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.expr("median(v)").alias("m")).collect()}
    assert {r.k: r.med for r in exact_median(df, ["k"], "v").collect()} == want


def test_places_deep_in_a_table(spark):
    df = _data(spark).drop("g", "h")
    order = [("v", "desc"), "id"]
    all_rows = number_within(df, [], order).select("id", "rn").collect()
    for first, last in ((1, 10), (995, 1004), (1990, 2050), (2001, 2010), (5, 4)):
        got = rows_between(df, order, first, last, buckets=32).select("id", "rn").collect()
        assert sorted(got) == sorted(r for r in all_rows if first <= r.rn <= last)


def test_bounds_that_miss_the_middle_are_noticed(spark, monkeypatch):
    df = spark.range(5_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert exact_median(df, ["k"], "v").first().med == 2499.5
    monkeypatch.setattr(slots, "_NEAR", [0.2 + i / 1000 for i in range(10)])
    with pytest.raises(Exception, match="outside the sketch"):
        exact_median(df, ["k"], "v").collect()
