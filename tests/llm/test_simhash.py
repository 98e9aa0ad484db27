"""SimHash groups against brute force over all pairs of fingerprints."""

import random

import pytest
import xxhash
from odd import documents, empty
from pyspark.sql import functions as F

from slotvalue.llm import simhash


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{position: smallest id reachable} for (id, fingerprint) rows."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[i] = min(ids, default=None)
    return out


def test_odd_documents(spark):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in documents(spark).collect()]
    want = brute_components(rows)
    got = simhash.simhash_groups(documents(spark)).collect()
    assert sorted(map(str, ((r.id, r.fp % (1 << 64), r.component_id) for r in got))) == \
        sorted(map(str, ((i, fp, want[n]) for n, (i, fp) in enumerate(rows))))


@pytest.mark.parametrize("dense", [1024, 1])
def test_links_of_crowded_fingerprints(spark, dense):
    """Chains and clusters of fingerprints, searched by pairs and without."""
    rng = random.Random(dense)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            centre ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 4])))
            fps.add(centre % (1 << 64))
            fps.add(centre & ~0xFFFFFFFF | rng.getrandbits(4))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from slotvalue.llm.common import components
    roots = {r.node: r.root for r in components(simhash.links(df, dense)).collect()}
    got = [roots.get(f, f) for f in signed]
    want = brute_components([(f, f % (1 << 64)) for f in signed])
    assert got == [want[i] for i in range(len(signed))]


def test_components_of_long_chains_and_stars(spark):
    from slotvalue.llm.common import components
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert components(df.where("a < 0")).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = simhash.simhash_groups(docs).select("component_id").distinct().collect()
    assert sorted(ids) == sorted(r.component_id for r in groups)
    assert simhash.drop_near_copies(docs.where("doc_id is null")).count() == 2  # the text and the empty text


def test_only_rows_of_repeated_keys_are_numbered(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, "p q r s t u v", "x"), (3, "p q r s t u v", "x"),
            (3, "k l m n o", "x"), (None, "", "x"), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == \
        sorted([(1, rows[0][1]), (3, rows[2][1]), (3, rows[4][1]), (None, "")], key=str)
    alone = simhash.drop_near_copies(docs.where("doc_id in (1, 2)"))
    assert [r.doc_id for r in alone.collect()] == [1]
    assert "Window" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_empty_table(spark):
    assert simhash.simhash_groups(empty(spark)).count() == 0
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_fingerprint_is_sparks_hash(spark):
    """One shingle: the fingerprint is XXH64 with seed 42, as Spark's own."""
    df = spark.createDataFrame([("a b c",)], "text string").select("text", F.xxhash64("text").alias("h"))
    assert simhash.fingerprint(b"A  b\tC") == df.first().h % (1 << 64)
