"""Forgiving search against the plain edit table."""

import random

import numpy as np
import pytest

from slotvalue.operators import fuzzy
from slotvalue.plans.catalog import QUERIES
from slotvalue.sources.tables import read_table


def table_edits(query: str, text: str) -> int:
    """Least edits between the query and any substring: the whole table, a row
    per character of the query, a vector over the text."""
    codes = np.array([ord(c) for c in text], np.int64)
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for i, c in enumerate(query, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))))
        row = np.minimum.accumulate(new - place) + place  # insertions run along the row
    return int(row.min())


def brute(entries, queries, weights, tolerance=0.1, limit=50):
    out = []
    for qid, query in queries:
        if query is None or len(query) < 2:
            continue
        low, found = query.lower(), []
        for entry, *values in entries:
            hits = []
            for weight, text in zip(weights, values):
                d = table_edits(low, (text or "").lower())
                if d <= int(len(low) * tolerance + 1e-9):
                    hits.append((d, weight))
            if hits:
                found.append((min(d for d, _ in hits), -sum(w for _, w in hits), entry))
        out += [(qid, e, d, -s, i + 1) for i, (d, s, e) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def run(spark, entries, queries, **kw):
    index = spark.createDataFrame([(e, f"doc/{e}", *v) for e, *v in entries],
                                  "entry_id long, href string, title string, section string, text string")
    asked = spark.createDataFrame(queries, "query_id long, query string")
    rows = fuzzy.fuzzy_search(index.repartition(3), asked, **kw).collect()
    return sorted((r.query_id, r.entry_id, r.distance, r.score, r["rank"]) for r in rows)


def edited(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice(letters))
        elif out:
            at = min(at, len(out) - 1)
            if kind == 1:
                del out[at]
            else:
                out[at] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_least_edits_is_the_tables(seed):
    rng = random.Random(seed)
    for _ in range(400):
        letters = rng.choice(["ab", "abcdef ", "aéß中"])
        query = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) + edited(rng, query, rng.randrange(0, 12), letters)
        assert fuzzy.least_edits(query, text) == table_edits(query, text)


def test_many_at_once():
    rng = random.Random(5)
    pairs = []
    for _ in range(500):
        letters = rng.choice(["ab", "abcd ", "aé中"])
        query = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 33)))
        pairs.append((query, edited(rng, query, rng.randrange(0, 9), letters)[:40]))
    patterns, texts = np.full((500, 32), 0xFFFFFFFE, np.uint32), np.full((500, 40), 0xFFFFFFFF, np.uint32)
    for i, (q, t) in enumerate(pairs):
        patterns[i, :len(q)], texts[i, :len(t)] = fuzzy.characters(q), fuzzy.characters(t)
    got = fuzzy.node_edits(patterns, np.array([len(q) for q, _ in pairs]), texts)
    assert got.tolist() == [table_edits(q, t) for q, t in pairs]


@pytest.mark.parametrize("kw", [{}, {"block_chars": 60}, {"tolerance": 0.25}, {"tolerance": 0.02}])
def test_every_match_is_found(spark, kw):
    rng = random.Random(7)
    letters = "abcde  "
    queries = [(n, "".join(rng.choice(letters) for _ in range(rng.choice([2, 5, 9, 10, 11, 19, 20, 33, 64, 120])))) for n in range(40)]
    queries += [(100, queries[3][1]), (101, None), (102, "a"), (103, "Straße und Maß am Fluß"), (104, "          "), (105, "")]
    entries = []
    for n in range(70):
        parts = []
        for _ in range(3):
            q = rng.choice([x for _, x in queries if x])
            parts.append("".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))) + edited(rng, q, rng.randrange(0, len(q) // 8 + 2), letters)
                         + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))))
        entries.append((n, None if n % 11 == 0 else parts[0].upper(), "" if n % 7 == 0 else parts[1], parts[2]))
    assert run(spark, entries, queries, **kw) == brute(entries, queries, (20, 20, 10), kw.get("tolerance", 0.1))


def test_edges_of_text_and_repeats(spark):
    q = "the quick brown fox jumps over it"
    entries = [(1, q, "", q * 300), (2, "", "", q[3:]), (3, "", "", q[:-3]), (4, "", "", q[4:]), (5, "", "", "x" * 5000 + q[:15] + "??" + q[16:]),
               (6, None, None, None), (7, "", "", q[:16] + "￿" + q[17:]), (8, q[:17], q[17:], "")]
    assert run(spark, entries, [(1, q)]) == brute(entries, [(1, q)], (20, 20, 10))


def test_nothing_to_search(spark):
    assert run(spark, [], [(1, "some query text")]) == [] and run(spark, [(1, "a", "b", "c")], []) == []


def test_registered_query_finds_all_that_the_table_finds(spark):
    """Benchmark passages, all that hit anything among them, against every document of sf0.001."""
    sf = "/root/testdata/sf0.001"
    got = [(r.query_id, r.entry_id, r.distance, r.score, r["rank"]) for r in QUERIES["doc_fuzzy"](spark, sf).collect()]
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect() if r.item_id % 4 == 0 or r.item_id in {g[0] for g in got}]
    assert sorted(got) == brute(docs, items, (10,)) and got


def test_exact_hits_are_the_exact_search(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.entry_id) for r in QUERIES["doc_search"](spark, sf).collect()}
    near = {(r.query_id, r.entry_id): r.distance for r in QUERIES["doc_fuzzy"](spark, sf).collect()}
    assert exact <= set(near) and {k for k, d in near.items() if d == 0} == exact
