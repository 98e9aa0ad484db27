import numpy as np
from pyspark.sql import functions as F

from slotvalue.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def exact(rows, is_query, k):
    """Brute force over usable rows (id, vector); equal rows count once."""
    rows = sorted(set((i, tuple(v)) for i, v in rows))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = []
    for q, (i, _) in enumerate(rows):
        if is_query(i):
            s = np.sqrt(((x - x[q]) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, s)) if ids[j] != i][:k]
            out += [(i, n + 1, int(ids[j]), round(float(s[j]), 9)) for n, j in enumerate(order)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = result(ann.nearest(df, F.col("vec_id") % 100 == 0))
    want = exact(rows, lambda i: i % 100 == 0, 10)
    assert len(got) == len(want) and len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.9 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(0, 60)]
    rows = good + [good[0], good[20]] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, inf, 0.0]),
                                         (104, [1.0, None, 2.0]), (105, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (110, [])]
    df = spark.createDataFrame([(*r, 0, 0.0, 1) for r in rows], SCHEMA)
    for block in (1024, 2):
        assert result(ann.nearest(df, F.col("vec_id") % 10 == 0, k=5, block_size=block)) == exact(good, lambda i: i % 10 == 0, 5)


def test_one_vector_shared_by_most_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)] + [(500 + i, [1.0, 2.0, 3.0, 4.0 + i]) for i in range(20)]
    df = spark.createDataFrame([(*r, 0, 0.0, 1) for r in rows], SCHEMA)
    assert result(ann.nearest(df, F.col("vec_id") % 100 == 0)) == exact(rows, lambda i: i % 100 == 0, 10)


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(2)
    # ids 1, 2 and 3 share a vector; rows of id 1 fill more than k + 1 places, and the query's own row is repeated
    rows = [(0, [1.0, 2.0, 3.0])] * 4 + [(1, [1.0, 2.0, 4.0])] * 20 + [(2, [1.0, 2.0, 4.0]), (3, [1.0, 2.0, 4.0])]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(4, 40)] * 3
    df = spark.createDataFrame([(*r, 0, 0.0, 1) for r in rows], SCHEMA)
    for k in (1, 5, 10):
        assert result(ann.nearest(df, F.col("vec_id") % 10 == 0, k=k)) == exact(rows, lambda i: i % 10 == 0, k)


def test_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-99, 99, 8).astype(float).tolist()) for i in range(60)]
    want = [(*r[:3], round(r[3], 6)) for r in exact(rows, lambda i: i % 10 == 0, 5)]
    for power in (120, 600, -600):  # beyond float32; squares beyond double; squares that vanish
        df = spark.createDataFrame([(i, [x * 2.0 ** power for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
        got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score * 2.0 ** -power, 6)) for r in got) == want, power


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, 0.0, 1), (1, [1.0, 3.0], 0, 0.0, 1)], SCHEMA)
    assert result(ann.nearest(df, F.col("vec_id") % 100 == 0)) == [(0, 1, 1, 1.0)]
    assert ann.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0
    assert ann.nearest(df, F.lit(False)).count() == 0
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 48)) + 0.3
    turn = ann.rotation(x[:200].mean(0))
    codes, length, factor = turn.encode(x)
    turned, qlen = turn.turn(x[:40])
    low, high = ann.bounds(codes, length, factor, ann.Queries(np.arange(40), x[:40], turned, qlen))
    true = ((x[:, None] - x[None, :40]) ** 2).sum(2)
    assert codes.shape[1] == 48 * ann.EXPAND // 8 and ((low <= true) & (true <= high)).mean() > 0.995
