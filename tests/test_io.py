"""Sources and sinks: JSON index, file listing, partitioned report writes."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from slotvalue.operators import exemplars, report, searchindex
from slotvalue.sources import docindex, files, tables

SF = "/root/testdata/sf0.001"


def test_json_index_search(spark):
    d = tempfile.mkdtemp(prefix="idx-", dir="/tmp")
    entries = [
        {"objectID": "a.html", "href": "a.html", "title": "Second pick", "section": "", "text": "value of a pick"},
        {"objectID": "a.html#s", "href": "a.html#s", "title": "Second pick", "section": "Median",
         "text": "median value"},
    ]
    with open(os.path.join(d, "index.json"), "w") as fh:
        json.dump(entries, fh)
    idx = docindex.read_doc_index(spark, d)
    q = spark.createDataFrame([(1, "second pick"), (2, "median")], "query_id long, query string")
    got = sorted((r["query_id"], r["entry_id"], r["score"]) for r in searchindex.search(idx, q).collect())
    assert got == [(1, "a.html", 20), (1, "a.html#s", 20), (2, "a.html#s", 30)]


def test_array_files_are_shared_out(spark):
    """One array in one file, cut by several tasks; texts that look like JSON."""
    entries = [{"objectID": f"p{i}.html", "href": "objectID", "title": ["objectID", 'a "objectID": b', None][i % 3], "section": '},{"objectID":',
                "text": f'[{{"objectID":{i}}}] \\ }} ] ü\n' * (i % 5)} for i in range(3000)]
    want = sorted((e["objectID"], e["title"] or "", e["section"], e["text"]) for e in entries)
    for form in ({"indent": 2}, {"separators": (",", ":")}, {}):
        d = tempfile.mkdtemp(prefix="arr-", dir="/tmp")
        with open(os.path.join(d, "index.json"), "w") as fh:
            json.dump(entries, fh, **form)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        try:
            idx = docindex.read_doc_arrays(spark, d)
            assert idx.rdd.getNumPartitions() > 3
            assert sorted((r.entry_id, r.title, r.section, r.text) for r in idx.collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_arrays_written_and_read_back(spark):
    d = tempfile.mkdtemp(prefix="arr-", dir="/tmp") + "/out"
    rows = [(str(i), f"h{i}", "t", None if i % 2 else "s", "x\n\"y\"" * (i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "entry_id string, href string, title string, section string, text string")
    docindex.write_doc_arrays(df.repartition(3), d)
    for name in os.listdir(d):
        if name.endswith(".txt"):
            with open(os.path.join(d, name)) as fh:
                assert isinstance(json.load(fh), list)
    want = sorted(tuple(x or "" for x in r) for r in rows)
    assert sorted(map(tuple, docindex.read_doc_arrays(spark, d).collect())) == want
    docindex.write_doc_arrays(df.where("false"), d + "-none")
    assert docindex.read_doc_arrays(spark, d + "-none").count() == 0


def test_file_listing_reads_paths_only(spark):
    df = files.file_listing(spark, SF, "*.parquet")
    assert "ReadSchema: struct<path:string>" in df._jdf.queryExecution().executedPlan().toString()
    assert {r["player_id"] for r in df.collect()} >= {"orders", "lineitem"}


def test_partitioned_report_write(spark):
    ex = exemplars.exemplars(tables.entrants(spark, SF), as_of="2001-12-31") \
        .withColumn("player_id", F.col("id").cast("string"))
    images = files.image_paths(tables.read_table(spark, SF, "labels"), "doc_id")
    rep = report.slot_report(ex, images)
    out = tempfile.mkdtemp(prefix="report-", dir="/tmp")
    report.write_slot_reports(rep, out)
    back = spark.read.parquet(out)
    assert back.count() == rep.count()
    slots = {int(p.split("=")[1]) for p in os.listdir(out) if p.startswith("slot=")}
    assert slots == {r["slot"] for r in rep.select("slot").distinct().collect()}
    labelled = report.display_labels(rep)
    assert "Value per Year" in labelled.columns
