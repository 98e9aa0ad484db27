import hashlib
import random

from odd import documents, empty
from pyspark.sql import functions as F

from slotvalue.llm import mixing


def brute_budgets(tree, budget, weights, path=()):
    """Budgets of a nested {name: subtree or capacity}, by filling step by step."""
    def cap(t):
        return t if isinstance(t, int) else sum(map(cap, t.values()))

    share, left = {}, dict(tree)
    rest = budget
    while left:
        w = {k: weights.get(path + (k,), 1) for k in left}
        total = sum(w.values())
        full = [k for k in left if cap(left[k]) * total <= rest * w[k] or not w[k]]
        if not full:
            share |= {k: rest * w[k] // total for k in left}
            break
        k = min(full, key=lambda k: (cap(left[k]) / w[k] if w[k] else 0, k))
        share[k] = cap(left[k]) if w[k] else 0
        rest -= share[k]
        left.pop(k)
    out = {}
    for k, b in share.items():
        out |= {path + (k,): b} if isinstance(tree[k], int) else brute_budgets(tree[k], b, weights, path + (k,))
    return out


def test_budgets_match_step_by_step_filling(spark):
    rng = random.Random(2)
    for _ in range(4):
        tree = {d: {g: {s: rng.choice([0, rng.randrange(1000)]) for s in "xyz"[:rng.randint(1, 3)]} for g in "pq"} for d in "abc"}
        leaves = [(d, g, s, c) for d in tree for g in tree[d] for s, c in tree[d][g].items()]
        weights = {("a",): 5, ("b", "p"): 3, ("c", "q", "x"): 0, ("a", "p", "y"): 7}
        budget = sum(x[3] for x in leaves) * rng.choice([20, 60, 90]) // 100
        df = spark.createDataFrame(leaves, "p0 string, p1 string, p2 string, cap long")
        got = {(r.p0, r.p1, r.p2): r.budget for r in mixing.leaf_budgets(df, ["p0", "p1", "p2"], budget, weights).collect()}
        assert got == brute_budgets(tree, budget, weights)


def mixed(docs, **more):
    levels = {"domain": mixing.domain_of(F.col("source")), "language": F.col("lang"), "origin": F.col("source")}
    return mixing.mix(docs, levels, mixing.word_tokens(F.col("text")), **more)


def test_prefixes_of_seeded_epochs(spark):
    """Every leaf holds the longest prefix of its epochs that fits its budget."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    percent, epochs, seed = 80, 2, 5
    got = {(r.doc_id, r.epoch, r.order_key) for r in mixed(docs, percent=percent, epochs=epochs, seed=seed).collect()}
    leaves, tree = {}, {}
    for r in docs.collect():
        domain = next((d for d, s in mixing.DOMAINS.items() if r.source in s), "other")
        leaves.setdefault((domain, r.lang, r.source), []).append((r.doc_id, len(r.text.split())))
    for (d, g, s), rows in leaves.items():
        tree.setdefault(d, {}).setdefault(g, {})[s] = epochs * sum(n for _, n in rows)
    total = sum(n for rows in leaves.values() for _, n in rows)
    want = set()
    for leaf, left in brute_budgets(tree, total * percent // 100, mixing.WEIGHTS).items():
        for e in range(epochs):
            order = sorted((int(hashlib.md5(f"{seed}:{e}:{i}".encode()).hexdigest()[:15], 16), i, n) for i, n in leaves[leaf])
            for key, i, n in order:
                left -= n
                if left >= 0:
                    want.add((i, e, key))
    assert got == want


def test_a_hot_id_is_cut(spark, monkeypatch):
    """Half the rows share no id, or one id, or are all equal: the mix still
    meets its budget within a row of each leaf."""
    monkeypatch.setattr(mixing, "PAGE", 7)
    for case in ("null ids", "one id", "equal rows", "two kinds"):
        rows = []
        for i in range(400):
            text = {"equal rows": "w w w w", "two kinds": "a b c d" if i % 3 else "x y"}.get(case, f"w{i} b c d")
            rows.append((None if case != "one id" else 7, text, "en", "src0"))
            rows.append((1000 + i, f"v{i} b c d", "en", "src1"))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
        total = sum(len(r[1].split()) for r in rows)
        for percent, epochs in ((60, 1), (90, 2)) if case == "two kinds" else ((60, 1),):
            got = mixed(docs, percent=percent, epochs=epochs)
            tokens = {r.origin: r.t for r in got.groupBy("origin").agg(F.sum("n_tokens").alias("t")).collect()}
            target = total * percent // 100
            assert target - 8 <= sum(tokens.values()) <= target, (case, percent, tokens)
            # nothing is taken more often in an epoch than it is there
            there = {(r[0], r[1]): 0 for r in rows}
            for r in rows:
                there[r[0], r[1]] += 1
            for r in got.groupBy("doc_id", "text", "epoch").count().collect():
                assert r["count"] <= there[r.doc_id, r.text]


def test_odd_documents(spark):
    docs = documents(spark)
    got = mixed(docs, percent=100, epochs=1)
    assert got.columns == [*docs.columns, "domain", "language", "origin", "n_tokens", "_epoch", "order_key"]
    assert got.count() == docs.count()  # everything fits
    few = mixed(docs, percent=1)
    assert few.agg(F.sum("n_tokens")).first()[0] in (None, *range(int(docs.agg(
        F.sum(mixing.word_tokens(F.col("text")))).first()[0] // 100) + 1))
    assert mixed(empty(spark)).count() == 0
    assert "(none)" in {r.origin for r in got.collect()}


def test_native_plan(spark):
    plan = mixed(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
