"""Invariants of the registered queries on the driver tables (sf0.01)."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E  # noqa: E402
from slotvalue.operators import report

SF = "/root/testdata/sf0.01"
Q = E.queries()


def test_player_ids_unique(spark):
    df = Q["entity_key"](spark, SF)
    assert df.count() == df.select("player_id").distinct().count()


def test_shares_sum_to_one_and_stack_ends_at_one(spark):
    shares = Q["band_share"](spark, SF)
    for r in shares.groupBy("slot").agg(F.sum("prop").alias("s")).collect():
        assert abs(r["s"] - 1.0) < 1e-5
    stack = Q["band_stack"](spark, SF)
    for r in stack.groupBy("slot").agg(F.max("ymax").alias("m")).collect():
        assert abs(r["m"] - 1.0) < 1e-5


def test_rank_one_in_every_class(spark):
    ranked = Q["class_rank"](spark, SF)
    classes = ranked.select("class_year").distinct().count()
    assert ranked.where("class_rank = 1").select("class_year").distinct().count() == classes


def test_exemplar_counts(spark):
    ex = Q["exemplars"](spark, SF)
    for r in ex.groupBy("slot").agg(F.count("*").alias("c"), F.max("n").alias("n")).collect():
        assert r["c"] == 3 * min(3, r["n"])


def test_chart_inputs_written(spark):
    out = tempfile.mkdtemp(prefix="charts-", dir="/tmp")
    for key in ("slot_value", "slot_rank", "band_share"):
        report.write_table(Q[key](spark, SF), os.path.join(out, key))
        assert spark.read.parquet(os.path.join(out, key)).count() > 0
