"""The pipeline against a brute-force version of each stage on its input."""

import corpus_pipeline
from odd import documents, empty
from pyspark.sql import functions as F
from test_decontam import brute
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, SF).cache()
    assert one.columns == docs.columns and one.count() >= 0.98 * docs.count()

    two = stage["simhash_dedup"](spark, one, SF).cache()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in one.collect()]
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(brute_components(rows).values()))

    three = stage["decontamination"](spark, two, SF).cache()
    assert sorted(r.doc_id for r in three.collect()) == sorted(r.doc_id for r in two.collect() if not brute(r.text, bench)[-1])

    four = stage["mixing"](spark, three, SF).cache()
    assert four.columns == docs.columns and set(four.collect()) <= set(three.collect())
    tokens = sum(len(r.text.split()) for r in three.collect())
    assert 0 < sum(len(r.text.split()) for r in four.collect()) <= 0.6 * tokens

    five = stage["sharding"](spark, four, SF)
    assert five.columns == [*docs.columns, "shard"]
    assert sorted(map(str, five.drop("shard").collect())) == sorted(map(str, four.collect()))


def test_run_is_the_stages_in_turn(spark):
    got = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert got == sorted(map(str, docs.collect()))


def test_odd_and_empty_documents(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty(spark), SF).columns == empty(spark).columns
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    ids = [r.doc_id for r in docs.collect()]
    assert ids and not {4, 5, 6} & set(ids)  # no letters: rejected


def test_no_labelled_row_drops_only_texts_without_letters(spark):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = stage(spark, docs, SF)
    want = [r for r in docs.collect() if r.text is not None and any(c.isalpha() for c in r.text)]
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, want))
