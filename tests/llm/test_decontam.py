import gc
import hashlib
import pickle
import random
import re
import weakref

import pytest
from odd import documents, empty

from slotvalue.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window=13, share=20):
    def cut(t):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    seq, hit, found = cut(text), set(), set()
    for name, item in items:
        w = cut(item)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for at in range(len(seq) - m + 1):
                if seq[at:at + m] == w[i:i + m]:
                    hit.update(range(at, at + m))
                    if name is not None:
                        found.add(str(name))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(seq), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(seq)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion"), (2, "One"),
         (10, "STRASSE"), (3, ""), (4, None), (None, "près du lac"), (1, "la maison"), (5, "a a a a"),
         (6, "word12 Ünïcode12 word13 Ünïcode13 word14"), (7, "straße straße straße")]


@pytest.mark.parametrize("part_bytes", [1_000_000, 10])
def test_odd_documents(spark, part_bytes):
    docs = documents(spark).where("doc_id is null or doc_id <> 7")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.mark(docs, bench, part_bytes=part_bytes)
    assert got.columns[:len(docs.columns)] == docs.columns and got.columns[len(docs.columns)] == "_n_words"
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[len(docs.columns):] == brute(r.text, ITEMS), r.text


def held(table):
    arrays = (table.offsets, table.keys, table.places, table.owned, table.owners)
    return len(table.shifts) + len(table.text) + sum(a.nbytes for a in arrays) + sum(len(n or "") for n in table.names)


def test_parts_are_bounded_and_held_one_at_a_time(spark, monkeypatch):
    docs = documents(spark).where("doc_id in (1, 8, 9)")
    made, sizes, real = [], [], decontam.build

    def build(items, window):
        gc.collect()
        assert not any(t() for t in made)  # those of the parts before
        tables = real(items, window)
        made.extend(map(weakref.ref, tables))
        sizes.append(sum(map(held, tables)))
        return tables

    monkeypatch.setattr(decontam, "build", build)
    bench = spark.createDataFrame(ITEMS[:5], "item_id long, text string")
    rows = decontam.mark(docs, bench, part_bytes=500).collect()
    assert len(sizes) > 2 and max(sizes) <= 500  # the first item alone needs more
    for r in rows:
        assert tuple(r)[len(docs.columns):] == brute(r.text, ITEMS[:5]), r.text


def test_size_of_a_full_part():
    """300,000 items: a part's tables, as they are sent, take what the bound says."""
    rng = random.Random(5)
    vocabulary = [f"w{rng.randrange(1 << 40):x}".encode() for _ in range(200_000)]
    items = [(str(n), rng.choices(vocabulary, k=rng.choice([13, 13, 13, 5, 20]))) for n in range(300_000)]

    class Rows:
        select = lambda self, *_: self
        toLocalIterator = lambda self: ((n, b" ".join(w).decode()) for n, w in items)

    windows, parts = 0, 0
    for part, _ in decontam._parts(Rows(), "id", "text", 13, decontam.PART_BYTES):
        tables = decontam.build(part)
        windows += sum(len(t.owners) for t in tables)
        parts += 1
        assert len(pickle.dumps(tables)) <= decontam.PART_BYTES
    assert parts > 1 and windows == sum(max(1, len(w) - 12) for _, w in items)


def test_windows_of_many_items_and_equal_blocks():
    """Windows with the same first and last words; one that every item has."""
    common = [b"w%d" % i for i in range(13)]
    items = [(n, [b"a", b"b", b"%d" % n, *common[:8], b"y", b"z"]) for n in range(50)] + [(n, common) for n in range(70)]
    tables = decontam.build(items)
    for n in (0, 49):
        assert decontam.search([b"q"] + items[n][1] + [b"q"], tables) == ([(1, 14)], {n})
    assert decontam.search(common + [b"q"] + common, tables) == ([(0, 13), (14, 27)], set(range(70)))
    assert decontam.search([b"a", b"b", b"50", *common[:8], b"y", b"z"], tables) == ([], set())


def test_long_text(spark):
    docs = documents(spark).where("doc_id = 7").select("doc_id", "text")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert tuple(decontam.mark(docs, bench).first())[2:4] == (120_000, 5 * len(range(12, 60_000, 997 * 89)))


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.mark(empty(spark), bench).count() == 0
    assert {r.n_hit for r in decontam.mark(documents(spark), bench.where("false")).collect()} == {0}


def test_search_finds_what_brute_force_finds():
    """Few distinct words, so blocks and windows overlap and repeat."""
    rng = random.Random(3)
    for _ in range(300):
        items = [(n, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 9))]) for n in range(6)]
        seq = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 60))]
        spans, found = decontam.search(seq, decontam.build(items, window=5))
        hit = {i for a, z in spans for i in range(a, z)}
        want_hit, want = set(), set()
        for n, w in items:
            m = min(5, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for at in range(len(seq) - m + 1):
                    if seq[at:at + m] == w[i:i + m]:
                        want_hit.update(range(at, at + m))
                        want.add(n)
        assert hit == want_hit and found == want
