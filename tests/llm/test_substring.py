import random
from collections import Counter

import numpy as np
import pytest
from odd import documents, empty
from pyspark.sql import functions as F

from slotvalue.llm import substring


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window,pack_bytes", [(35, 2 << 20), (4, 300), (5, 1)])
def test_odd_documents(spark, window, pack_bytes):
    docs = documents(spark).where("doc_id is null or doc_id <> 7")
    rows = docs.collect()
    got = substring.remove_repeats(docs, window=window, pack_bytes=pack_bytes).collect()
    want = [(r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], window))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_repeats_within_and_across_texts(spark):
    """Few words, so windows overlap, nest and repeat inside one text."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        t = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))]
        a = rng.randrange(0, 40)
        t[len(t) // 2:len(t) // 2] = passage[a:a + rng.randrange(0, 30)]
        texts.append(" ".join(t))
    texts += ["und " * 500, "und " * 500, "x " + "und " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, window=7, pack_bytes=700).collect()}
    assert got == dict(enumerate(brute(texts, 7)))


def test_long_text_and_empty_table(spark):
    docs = documents(spark).where("doc_id = 7")
    row = substring.remove_repeats(docs).first()
    assert (row.n_words, row.n_removed) == tuple(brute([docs.first().text], 35)[0][:2])
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_every_repeated_window_holds_a_block_that_is_hit():
    for window in range(1, 40):
        block = (window + 1) // 2
        assert all(any((at + i) % block == 0 and i + block <= window for i in range(window)) for at in range(block))


def test_rolling_hashes_depend_on_the_words_alone():
    rng = np.random.default_rng(0)
    run = [bytes([65 + i]) for i in rng.integers(0, 5, 300)]
    pack = substring.Pack.of([run[:120], [], run[120:]])
    for which in (0, 1):
        seen = {}
        for at in pack.starts(6):
            seen.setdefault(tuple(run[at:at + 6]), set()).add(int(pack.rolling(6, which)[at]))
        assert all(len(h) == 1 for h in seen.values()) and len({min(h) for h in seen.values()}) == len(seen)
