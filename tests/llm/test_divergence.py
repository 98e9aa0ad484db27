import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import LONG, documents, empty
from pyspark.sql import Row

from slotvalue.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=10, top=10):
    """Plain Python integers over every term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    cut = [(lang, source, TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
           for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in cut}:
        mine = [r for r in cut if r[0] == lang]
        seen = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)

        def shares(ts):
            n = Counter(t for t in ts if t in set(kept))
            return n, {t: 1 + 10 ** 9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        groups = {s: shares([t for _, x, ts in mine if x == s for t in ts]) for s in {r[1] for r in mine}}
        _, q = shares([t for _, _, ts in mine for t in ts])
        for s, (n, p) in groups.items():
            for part, values in (("pair", [(sum(f(p[t], o[t]) for t in kept), x) for x, (_, o) in groups.items() if x != s]),
                                 ("term", [(f(p[t], q[t]), t) for t in kept if n[t] and p[t] > q[t]])):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def check(df, **kw):
    rows = [tuple(r) for r in df.select("lang", "source", "text").collect()]
    limits = {k: v for k, v in kw.items() if k in ("min_docs", "top")}
    assert sorted(tuple(r) for r in D.audit(df, **kw).collect()) == brute(rows, **limits)


def corpus(spark, seed, n=400, langs=("en", "de", None), sources=7):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcÄéß中") for _ in range(rng.randrange(1, 4))) for _ in range(120)]

    def text():
        return rng.choice([" ", "-", "7", "\x00"]).join(rng.choice(vocabulary[:rng.choice([4, 30, 120])]) for _ in range(rng.randrange(0, 30)))

    rows = [(rng.choice(langs), f"s{rng.randrange(sources)}", text().upper() if i % 9 == 0 else text()) for i in range(n)]
    return spark.createDataFrame(rows, "lang string, source string, text string")


@pytest.mark.parametrize("kw", [{}, {"min_docs": 1, "shard_terms": 5, "pass_terms": 40}, {"min_docs": 3, "top": 2, "shard_terms": 16}])
def test_random_corpus(spark, monkeypatch, kw):
    monkeypatch.setattr(D, "TILE", 3)
    check(corpus(spark, len(kw)).repartition(5), **kw)


def test_a_task_that_writes_early(spark, monkeypatch):
    monkeypatch.setattr(D, "_HELD", 7)
    monkeypatch.setattr(D, "_PIECE", 16)
    check(corpus(spark, 9).repartition(3), min_docs=2, shard_terms=10, pass_terms=60)


def test_odd_documents(spark):
    docs = documents(spark)
    check(docs, min_docs=1)
    check(docs, min_docs=2, shard_terms=4)
    check(docs)  # no term is in ten documents: pairs of value 0 only


def test_keys_stay_whole_behind_a_join_that_is_evened_out(spark):
    """Without broadcasts, a shard's counts of many sources are a skewed side."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.files.maxPartitionBytes": "16k",
            "spark.sql.files.openCostInBytes": "16k", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        check(corpus(spark, 4, n=1500, langs=("en",), sources=90).repartition(16), min_docs=2)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ties_go_by_the_terms_bytes(spark):
    rows = [("en", f"s{i % 2}", " ".join(f"w{c}" for c in ("abcdefghijklmnopq" if i % 2 else "zyx"))) for i in range(30)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    check(df)
    check(df, shard_terms=2)


def test_empty_table_and_blank_texts(spark):
    assert D.audit(empty(spark)).count() == 0
    rows = [("en", "a", ""), ("en", "b", None), ("de", None, " 1 2 "), (None, None, None)]
    check(spark.createDataFrame(rows, "lang string, source string, text string"))


def test_long_text_is_read_whole(spark):
    rows = [("en", "a", LONG), ("en", "b", LONG.upper())] * 5
    check(spark.createDataFrame(rows, "lang string, source string, text string"))


def test_perfect_hash_is_minimal_and_verified():
    rng = random.Random(1)
    rows, all_words = [], {}
    for lang, shards in (("en", 4), ("de", 1)):
        words = list({f"{lang}{rng.randrange(10 ** 6)}".encode() for _ in range(5000)})
        all_words[lang] = words
        for s in range(shards):
            mine = [w for w in words if (D.xxhash.xxh64_intdigest(w, 42) >> 32) * shards >> 32 == s]
            sizes, bits, slot = D.perfect(mine)
            assert sorted(slot) == list(range(len(mine)))
            rows.append(Row(lang=lang, shard=s, shards=shards, sizes=sizes, bits=bits.tobytes(),
                            terms=[mine[i] for i in np.argsort(slot)]))
    hashes = D.Hashes(rows)
    for lang, words in all_words.items():
        begin, end = hashes.span(lang)
        assert sorted(hashes.look_up(lang, words)) == list(range(begin, end))
        others = [f"x{i}".encode() for i in range(20_000)]
        assert (hashes.look_up(lang, others) == -1).all()


def test_share_is_exact_for_large_counts():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10 ** 15)
        n, v = rng.randrange(0, total + 1), rng.randrange(1, 10 ** 6)
        assert D.share(np.array([n]), total, v)[0] == 1 + 10 ** 9 * (n + 2) // (total + 2 * v)
