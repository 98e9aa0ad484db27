"""Physical-plan properties the design relies on."""

from slotvalue.operators import bands, exemplars, slots
from slotvalue.plans.catalog import QUERIES
from slotvalue.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entrants_scans_are_pruned(spark):
    p = plan(tables.entrants(spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double" in p
    assert "o_orderpriority" not in p and "c_acctbal" not in p and "l_quantity" not in p
    assert "ReadSchema: struct<l_orderkey:bigint>" in p
    # line items are counted map-side before the shuffle
    assert "partial_count" in p


def test_band_stats_are_a_scalar_subquery_not_a_window(spark):
    p = plan(bands.band_assign(tables.entrants(spark, SF), as_of="2001-12-31"))
    assert "Subquery" in p
    assert "Window" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_numbered_queries_run_no_python(spark):
    for key in ("slot_value", "slot_rank", "class_rank", "entity_key", "exemplars", "slot_report"):
        p = plan(QUERIES[key](spark, SF))
        assert "Python" not in p and "Pandas" not in p and "Arrow" not in p, key


def test_building_a_plan_starts_no_job(spark):
    """Planning the entrants' queries reads nothing but file footers."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans only")
    ents = tables.entrants(spark, SF)
    spark.sparkContext.setJobGroup("build", "build only")
    for out in (slots.slot_value(ents), slots.slot_rank(slots.class_rank(ents)), exemplars.exemplars(ents, as_of="2001-12-31")):
        plan(out)
    assert list(tracker.getJobIdsForGroup("build")) == []


def test_zero_fill_is_one_aggregate(spark):
    p = plan(bands.band_zero_fill(bands.band_assign(tables.entrants(spark, SF), as_of="2001-12-31")))
    assert p.count("Generate explode") == 1 and "Join" in p and p.count("keys=[slot") == 2  # partial and final


def test_pages_are_read_once(spark):
    for key in ("header_promote", "class_union", "page_cells"):
        p = plan(QUERIES[key](spark, SF))
        assert p.count("Scan parquet") == 1 and "Join" not in p and "Exchange" not in p, key


def test_no_registered_query_uses_a_cross_join(spark):
    for key, fn in QUERIES.items():
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p, key
        assert "BroadcastNestedLoopJoin" not in p, key
