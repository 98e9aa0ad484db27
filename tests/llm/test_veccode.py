import hashlib

import numpy as np
import pytest

from slotvalue.llm import veccode as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, id long, vec string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, 2, "v", 3) for i, v, lab in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain Python integers, every entry tried."""
    import math
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    if not kept:
        return {}, ""
    d = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    kept = [r for r in kept if len(r[1]) == d]
    cuts = [len(p) for p in np.array_split(range(d), parts)]
    cuts = [sum(cuts[:k]) for k in range(parts + 1)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    first = [first[i] for i in sorted(first)[:entries]]
    books = [[v[a:b] for v in first] for a, b in zip(cuts, cuts[1:])]

    def near(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            given = {}
            for _, v, _ in kept:
                given.setdefault(near(v[a:b], books[k])[1], []).append(v[a:b])
            books[k] = [[sum(c) // len(given[n]) for c in zip(*given[n])] if n in given else e for n, e in enumerate(books[k])]
    out = []
    for i, v, lab in kept:
        found = [near(v[a:b], books[k]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        out.append((i, lab, "".join(f"{n:02x}" for _, n in found), sum(x for x, _ in found)))
    totals = {lab: sum(r[3] for r in out if r[1] == lab) for _, lab, _, _ in out}
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted([(*r, totals[r[1]]) for r in out], key=repr), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **kw):
    coded, books = V.compress(frame(spark, rows), **kw)
    got = sorted([(r.id, r.label, r.code, r.error, r.label_error) for r in coded.collect()], key=repr)
    want, digest = brute(rows, **kw)
    assert got == want and books.digest() == digest


def vectors(seed, n, d, size=0.3, whole=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, d)) / 1024 if whole else rng.normal(size=(n, d)) * size
    return [(int(i), v.tolist(), int(i) % 5 if i % 7 else None) for i, v in zip(rng.permutation(n * 3)[:n], x)]


def test_random_vectors(spark):
    check(spark, vectors(1, 400, 8), entries=40)


def test_ties_everywhere(spark):
    check(spark, vectors(2, 500, 8, whole=True), entries=100, rounds=2)


def test_fewer_rows_than_entries_and_uneven_parts(spark):
    check(spark, vectors(3, 20, 7))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = vectors(4, 60, 8) + [(1, None, 1), (2, [], 1), (3, [0.1] * 7, 1), (4, [None] + [0.1] * 7, 1), (5, [inf] * 8, 1),
                                (6, [nan] * 8, None), (None, [0.25] * 8, None), (None, [0.5] * 8, 2), (-5, [0.0] * 8, 0),
                                (-5, [-0.1] * 8, 0), (-5, [0.0] * 8, 0), (-6, [5000.25] * 8, 1), (-7, [-1e-9] * 8, 1)]
    rows += [rows[0]] * 30
    check(spark, rows, entries=16)


def test_out_of_range_components_take_no_part(spark):
    rows = vectors(5, 30, 4)
    coded, _ = V.compress(frame(spark, rows + [(900, [1e300, 0.0, 0.0, 0.0], 1), (901, [0.0, -1e12, 0.0, 0.0], 1)]))
    assert sorted(r.id for r in coded.collect()) == sorted(r[0] for r in rows)


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 1)], [(None, [0.5] * 4, 1)]):
        assert V.compress(frame(spark, rows)) == (None, None)


@pytest.mark.parametrize("scale", [1, 1 << 25])
def test_tree_finds_the_nearest_with_ties(scale):
    rng = np.random.default_rng(scale)
    for _ in range(40):
        width, n = rng.integers(1, 4), rng.integers(1, 300)
        entries = rng.integers(-9, 10, (n, width)) * scale + rng.integers(-2, 3, (n, width))
        q = rng.integers(-12, 13, (200, width)) * scale
        d2 = ((q[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        who, dist = V.nearest(V.build(entries, degree=5), entries, q)
        assert (d2.argmin(1) == who).all() and (d2.min(1) == dist).all()


def test_subtrees_are_left_out(monkeypatch):
    """On clustered entries most distances are never computed."""
    rng = np.random.default_rng(1)
    entries = (rng.integers(0, 1 << 20, (16, 1, 4)) + rng.integers(0, 50, (16, 16, 4))).reshape(-1, 4)
    q = entries[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 4))
    tree, seen, real = V.build(entries), [0], V.squared

    def squared(a, b):
        seen[0] += len(a) * len(b)
        return real(a, b)

    monkeypatch.setattr(V, "squared", squared)
    V.nearest(tree, entries, q)
    assert seen[0] < 0.2 * len(q) * len(entries)


def test_decode_gives_the_reported_error(spark):
    rows = V.scaled(frame(spark, vectors(6, 100, 8)), "vec_id", "embedding", "label")
    books = V.train(rows, entries=16)
    given = np.array([r.vec for r in rows.collect()])
    numbers, errors = books.encode(given)
    assert (((books.decode(numbers) - given) ** 2).sum(1) == errors.sum(1)).all()
