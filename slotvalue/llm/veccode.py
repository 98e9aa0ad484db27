"""Vector code compression: product codes whose entries are found in a GNAT.

Every component x becomes the integer floor(1024 * x) and every vector is cut
into ``parts`` consecutive pieces.  A codebook per part starts as that part of
the vectors with the smallest ids; each round gives every piece to its nearest
entry (squared Euclidean distance, ties to the lower number) and replaces every
entry by the floored mean of its pieces.  A vector's code is the numbers of its
pieces' entries.

Nearest entries are found in a geometric near-neighbour access tree over each
codebook: a node keeps some entries as split points, files the others under the
nearest of them, and stores for every split point and every child the range of
distances between the two.  A query measures its distance to the split points;
by the triangle inequality a child whose range lies outside the distance plus or
minus the best one so far holds nothing nearer, and its whole subtree is left
out.  That test is strict and its numbers are rounded outwards, so an entry that
ties is never lost; distances are compared as exact integers.  Queries walk the
tree in batches: first into the child of their nearest split point, then into
those that remain.

The scaled vectors are written once; each round is one pass over them that
returns one row of sums a task and entry.  The driver holds the codebooks (parts x
entries x part length) and their trees, which is also what is broadcast.

Defined cases: rows whose vector is null, empty, holds null or non-finite
components or has another length than most (ties: the shorter) take no part, nor
do those whose scaled components are so large that a squared distance could
leave a long; a length that ``parts`` does not divide gives first parts that are
one longer or shorter.  Repeated rows count each; an id with several vectors
gives the codebook its least one, and null ids give it none.  Fewer ids than
entries make smaller codebooks; a table without ids leaves nothing to code with
and gives an empty result, and so does an empty table.  Extra columns are
ignored.  A label's error that leaves a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.common import Shared, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
DEGREE = 16          # split points of a node
_OUT = 1e-12         # share by which rounded distances are moved outwards
_CELLS = 1 << 20     # components searched together


def exact_in_doubles(*arrays: np.ndarray) -> bool:
    """Whether all sums of squared distances between these rows are."""
    top = max(int(np.abs(a).max(initial=0)) for a in arrays)
    return 4 * top * top * max(arrays[0].shape[1], 1) < 1 << 52


def squared(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of one type, queries x points: longs, or
    doubles that hold whole numbers."""
    if q.dtype == np.float64:
        d2 = q @ (-2 * points.T)
        d2 += np.einsum("ij,ij->i", q, q)[:, None]
        d2 += np.einsum("ij,ij->i", points, points)
        return d2
    return np.stack([((q - p) ** 2).sum(1) for p in points], 1)


@dataclass
class Node:
    splits: np.ndarray           # entry numbers, ascending
    children: list               # a node for every split point, or None
    middle: np.ndarray           # [i, j]: of the range of distances of split i to the entries below split j
    half: np.ndarray             # half that range's width, rounded up


def build(entries: np.ndarray, members: np.ndarray | None = None, degree: int = DEGREE) -> Node:
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= 2 * degree:
        return Node(members, [], np.empty(0), np.empty(0))
    chosen = [0]  # split points far from each other
    far = squared(entries[members], entries[members[:1]])[:, 0]
    while len(chosen) < degree:
        far[chosen] = -1
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(entries[members], entries[members[chosen[-1:]]])[:, 0])
    splits = np.sort(members[chosen])
    rest = np.setdiff1d(members, splits)
    d2 = squared(entries[rest], entries[splits])
    own, dist = d2.argmin(1), np.sqrt(d2.astype(np.float64, copy=False))
    middle, half, children = np.zeros((degree, degree)), np.zeros((degree, degree)), []
    for j in range(degree):
        below = np.flatnonzero(own == j)
        children.append(build(entries, rest[below], degree) if len(below) else None)
        if len(below):
            low, high = dist[below].min(0), dist[below].max(0)
            middle[:, j], half[:, j] = (low + high) / 2, (high - low) / 2 + _OUT * high
    return Node(splits, children, middle, half)


def nearest(tree: Node, entries: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the nearest entries, squared distances) of query rows."""
    if exact_in_doubles(q, entries):
        q, entries = q.astype(np.float64), entries.astype(np.float64)
    best = np.full(len(q), np.iinfo(np.int64).max, q.dtype)
    who = np.full(len(q), len(entries))

    def visit(node: Node, rows: np.ndarray) -> None:
        d2 = squared(q[rows], entries[node.splits])
        near = d2.argmin(1)  # split points ascend: the first is the lowest that ties
        found, number = d2[np.arange(len(rows)), near], node.splits[near]
        better = (found < best[rows]) | ((found == best[rows]) & (number < who[rows]))
        best[rows[better]], who[rows[better]] = found[better], number[better]
        if not node.children:
            return
        dist = np.sqrt(d2.T.astype(np.float64))  # split points x rows
        for first in (True, False):
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                part = np.flatnonzero((near == j) == first)
                reach = np.sqrt(best[rows[part]].astype(np.float64, copy=False))
                away = np.abs(dist[:, part] - node.middle[:, j, None])
                part = part[~(away > (node.half[:, j, None] + reach) * (1 + _OUT)).any(0)]
                if len(part):
                    visit(child, rows[part])

    if len(q):
        visit(tree, np.arange(len(q)))
    return who, best.astype(np.int64)


@dataclass
class Codebooks:
    """Per part, its entries (entries x length) and their tree."""
    parts: list[np.ndarray]

    def __post_init__(self):
        self.trees = [build(p) for p in self.parts]

    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *(p.shape[1] for p in self.parts)])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry numbers, squared distances), both vectors x parts."""
        cuts, step = self.cuts(), max(1, _CELLS // vectors.shape[1])
        out = np.empty((2, len(vectors), len(self.parts)), np.int64)
        for at in range(0, len(vectors), step):
            for i, (tree, entries) in enumerate(zip(self.trees, self.parts)):
                out[:, at:at + step, i] = nearest(tree, entries, vectors[at:at + step, cuts[i]:cuts[i + 1]])
        return out[0], out[1]

    def decode(self, numbers: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.hstack([p[numbers[:, i]] for i, p in enumerate(self.parts)])

    def digest(self) -> str:
        text = ",".join(str(x) for p in self.parts for x in p.reshape(-1).tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.int64).reshape(len(col), -1)


def scaled(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame | None:
    """(id, label, vec: integers) of the rows that take part, stored."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("vec")).where(
        F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    limit = min(math.isqrt((1 << 62) // size["d"]) // 2, (1 << 31) - 1) / scale
    whole = F.transform("vec", lambda x: F.floor(x * scale).cast("int"))
    fit = F.forall("vec", lambda x: F.abs(x) < limit)
    return stored(rows.where((F.size("vec") == size["d"]) & fit).select("id", "label", whole.alias("vec")), "code-vectors")


def first_entries(rows: DataFrame, entries: int, parts: int) -> Codebooks | None:
    """The vectors with the smallest ids; every task offers its own smallest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list[int]] = {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            low = np.flatnonzero(ids <= max(least)) if len(least) == entries else np.arange(len(ids))
            low = low[np.argsort(ids[low], kind="stable")]
            _, at = np.unique(ids[low], return_index=True)
            if len(at) > entries:  # the vectors of all other ids come too late
                low = low[:at[entries]]
            for i, vec in zip(ids[low].tolist(), b.column(1).take(pa.array(low)).to_pylist()):
                least[i] = min(least.get(i, vec), vec)
            for i in sorted(least)[entries:]:
                del least[i]
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(least.values(), pa.list_(pa.int32()))],
                                         names=["id", "vec"])

    offered = rows.where("id is not null").select("id", "vec").mapInArrow(run, "id long, vec array<int>")
    chosen = offered.groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").limit(entries).collect()
    if not chosen:
        return None
    return Codebooks([np.ascontiguousarray(p) for p in
                      np.array_split(np.array([r["vec"] for r in chosen], np.int64), parts, axis=1)])


def next_entries(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign every piece, and move every entry to the floored mean."""
    shared, cuts = Shared(rows.sparkSession, books), books.cuts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Codebooks = shared.value
        sums = [np.zeros((len(p), p.shape[1] + 1), np.int64) for p in held.parts]  # the count comes first
        for b in batches:
            if not b.num_rows:
                continue
            vectors = _matrix(b.column(0))
            numbers, _ = held.encode(vectors)
            for i, total in enumerate(sums):
                order = np.argsort(numbers[:, i], kind="stable")
                used, at = np.unique(numbers[order, i], return_index=True)
                total[used, 1:] += np.add.reduceat(vectors[order, cuts[i]:cuts[i + 1]], at, axis=0)
                total[used, 0] += np.diff(np.append(at, len(order)))
        rows_ = [(i, j, t[j].tolist()) for i, t in enumerate(sums) for j in np.flatnonzero(t[:, 0]).tolist()]
        cols = list(zip(*rows_)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                          pa.array(cols[2], pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    found = rows.select("vec").mapInArrow(run, "part int, entry int, sums array<long>")
    each = found.select("part", "entry", F.posexplode("sums").alias("pos", "x"))
    total = each.groupBy("part", "entry", "pos").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    moved = total.groupBy("part", "entry").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("sums")).collect()
    parts = [p.copy() for p in books.parts]
    for r in moved:
        count, *sums = [int(x["x"]) for x in r["sums"]]
        parts[r["part"]][r["entry"]] = [s // count for s in sums]
    shared.release()
    return Codebooks(parts)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    books = first_entries(rows, entries, parts)
    for _ in range(rounds if books else 0):
        books = next_entries(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code: two hex digits a part, error) for every row."""
    shared = Shared(rows.sparkSession, books)
    digits = max(2, math.ceil(math.log(max(len(books.parts[0]), 2), 16) - 1e-9))
    label = rows.schema["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            numbers, errors = shared.value.encode(_matrix(b.column(2)))
            code = ["".join(f"{x:0{digits}x}" for x in row) for row in numbers.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(errors.sum(1))],
                                             names=["id", "label", "code", "error"])

    return rows.select("id", "label", "vec").mapInArrow(
        run, f"id long, label {label.dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, Codebooks | None]:
    """((id, label, code, error, label_error), codebooks); None where no row
    can be coded."""
    rows = scaled(vectors, id_col, vec_col, label_col)
    books = train(rows, parts, entries, rounds) if rows is not None else None
    if books is None:
        return None, None
    coded = stored(encode(rows, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = stored(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "code-labels")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books
