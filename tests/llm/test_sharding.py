import duckdb
from odd import documents, empty
from pyspark.sql import functions as F

from slotvalue.llm import oracle, sharding

SF = "/root/testdata/sf0.01"


def sizes(df, column="shard"):
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return {r[column]: (r.b, r.n) for r in df.groupBy(column).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()}


def test_small_limits_match_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for limit in (30_000, 300_000):
        got = {(r.doc_id, r["shard"]) for r in sharding.shard(docs, limit).select("doc_id", "shard").collect()}
        sql = oracle.SHARDING.replace(str(sharding.LIMIT), str(limit))
        assert got == {(r[0], r[2]) for r in con.sql(sql).fetchall()} and len({s for _, s in got}) > 5


def test_shards_are_prefixes_that_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sizes(sharding.shard(docs, 50_000))
    names = sorted(found)
    assert all(b <= 50_000 or n == 1 for b, n in found.values())
    assert not any(z.startswith(a) for a, z in zip(names, names[1:]))  # no shard lies in another
    for a in names:  # only oversized buckets split: a shard and its sibling's rows do not fit together
        if a:
            assert sum(b for s, (b, _) in found.items() if s.startswith(a[:-1])) > 50_000


def test_odd_documents(spark):
    docs = documents(spark)
    got = sharding.shard(docs, 100)
    assert got.columns == [*docs.columns, "_shard"]
    assert got.drop("_shard").exceptAll(docs).count() == 0 and got.count() == docs.count()
    assert all(b <= 100 or n == 1 for b, n in sizes(got, "_shard").values())
    assert sharding.shard(empty(spark)).count() == 0


def test_one_id_and_equal_rows_are_paged(spark):
    """A third of all rows are equal, another third share their id."""
    rows = [(1, "x" * 10)] * 400 + [(2, "y" * 9 + str(i)) for i in range(400)] + [(i, "z" * 10) for i in range(3, 403)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 200)
    assert got.drop("shard").exceptAll(docs).count() == 0 and got.count() == len(rows)
    assert all(b <= 200 for b, _ in sizes(got).values())
    assert sum("/" in s for s in sizes(got)) >= 20


def test_native_plan(spark):
    plan = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(sharding.shard(docs, 500_000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
