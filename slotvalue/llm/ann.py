"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: every distinct vector x, less a centre c, is padded to ``EXPAND`` times
its length and rotated by a seeded random orthogonal matrix.  The signs of the
rotated unit vector o are its code, packed into bytes; with it are kept two
correction scalars, the length of x - c and f, the inner product of o with its
own code (as a unit vector).

Search: the inner product of a code with a rotated query, divided by f,
estimates that of o with the query, with an error of at most
``EPSILON * sqrt(1 - f*f) / (f * sqrt(bits - 1))`` of the query's length, with
high probability.  So every code gives a lower and an upper bound of its
distance.  A first pass over the codes finds each query's bound: the k-th
smallest upper bound.  A second pass reranks, by exact distance, the vectors
whose lower bound does not exceed it.

Queries are taken in blocks of ``BLOCK``; a block is what is broadcast.  Equal
vectors are one entry with the k + 1 smallest of their ids, which are all that
can be among k nearest, so a vector that many rows share costs no more than
another.  The centre comes from at most about ``SAMPLE`` rows; every row is
indexed.

Defined cases: vectors that are null, zero, hold null or non-finite components
or have another length than most take no part, and so do null ids; equal rows
count once per id; a candidate with the query's own id is left out; ties go to
the smaller id; distances beyond the range of a double are infinite and tie; an
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from slotvalue.llm.common import Shared, stored
from slotvalue.session import scratch_path

EXPAND = 4
EPSILON = 3.0
BLOCK = 1024
SAMPLE = 4096
SEED = 29
_ROWS = 1024  # codes compared with a block of queries at a time
_TINY = 1e-290  # more than what squares below the range of a double lose
_RESULT = "query_no int, query_id long, vec_id long, score double"


def lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths of the rows; powers of two keep the squares within a double."""
    power = np.frexp(np.abs(rows).max(1))[1]
    scaled = np.ldexp(rows, -power[:, None])
    return np.ldexp(np.sqrt((scaled * scaled).sum(1)), power)


@dataclass
class Rotation:
    centre: np.ndarray
    matrix: np.ndarray   # length of a vector x bits

    def turn(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rotated vectors less the centre, their lengths)."""
        rest = vectors - self.centre
        return rest @ self.matrix, lengths(rest)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed signs, lengths, inner products with the own code)."""
        turned, length = self.turn(vectors)
        bits = turned.shape[1]
        own = np.abs(turned).sum(1) / np.sqrt(bits)
        factor = np.where(length > 0, own / np.where(length > 0, length, 1), 1.0)
        return np.packbits(turned > 0, axis=1), length, factor


def rotation(centre: np.ndarray, expand: int = EXPAND, seed: int = SEED) -> Rotation:
    d = len(centre)
    bits = -(-d * expand // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return Rotation(centre, (q * np.sign(np.diag(r)))[:d])


@dataclass
class Queries:
    ids: np.ndarray
    vectors: np.ndarray
    turned: np.ndarray
    length: np.ndarray


def bounds(codes: np.ndarray, length: np.ndarray, factor: np.ndarray, q: Queries,
           epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the squared distances, codes x queries; infinite
    where the numbers leave the range of a double, so such pairs are reranked."""
    bits = q.turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    with np.errstate(over="ignore", invalid="ignore"):
        # unit queries: their float32 components neither overflow nor vanish
        unit = (q.turned / np.where(q.length > 0, q.length, 1)[:, None]).astype(np.float32)
        inner = (signs @ unit.T).astype(np.float64) * q.length[None] / (np.sqrt(bits) * factor)[:, None]
        near = length[:, None] ** 2 + q.length[None] ** 2 - 2 * length[:, None] * inner
        loss = np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor * epsilon / np.sqrt(max(bits - 1, 1))
        slack = 2 * (length * loss)[:, None] * q.length[None] + 1e-5 * (length[:, None] + q.length[None]) ** 2 + _TINY
        lower, upper = near - slack, near + slack
    return np.where(np.isfinite(lower), lower, -np.inf), np.where(np.isfinite(upper), upper, np.inf)


def _usable(vector: str, d: Column | int | None = None) -> Column:
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return ok if d is None else ok & (F.size(v) == d)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1)


def build_index(rows: DataFrame, k: int, expand: int = EXPAND) -> tuple[DataFrame, Rotation]:
    """(index of the distinct vectors of ``rows`` (id, vec), its rotation)."""
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    sample = np.array([r["vec"] for r in rows.select("vec").sample(share, SEED).limit(2 * SAMPLE).collect()])
    d = len(rows.first()["vec"])
    turn = rotation(sample.mean(0) if len(sample) else np.zeros(d), expand)
    shared = Shared(rows.sparkSession, turn)  # d x bits numbers

    # each id counts once among the k + 1; their limit holds before the shuffle by vector, so no vector
    # gathers all its rows
    least = Window.partitionBy("vec").orderBy("id")
    own = rows.distinct().withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1) \
        .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, length, factor = shared.value.encode(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()),
                                              pa.array(length), pa.array(factor)],
                                             names=["vec", "ids", "code", "length", "factor"])

    index = own.select("vec", "ids").mapInArrow(
        run, "vec array<double>, ids array<long>, code binary, length double, factor double")
    return stored(index, "ann-index"), turn


def _codes(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch whose columns from ``at`` on are code, length, factor."""
    packed = np.frombuffer(b"".join(b.column(at).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    length, factor = np.asarray(b.column(at + 1)), np.asarray(b.column(at + 2))
    for i in range(0, b.num_rows, _ROWS):
        yield i, packed[i:i + _ROWS], length[i:i + _ROWS], factor[i:i + _ROWS]


def _limits(index: DataFrame, block, k: int, epsilon: float) -> np.ndarray:
    """Per query of the block, the k-th smallest upper bound over the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = block.value
        best = np.full((0, len(q.ids)), np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            only = np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(1))
            for i, codes, length, factor in _codes(b, 2):
                _, upper = bounds(codes, length, factor, q, epsilon)
                # an entry with no id but the query's own does not count
                own = (only[1][i:i + _ROWS, None] == 1) & (only[0][i:i + _ROWS, None] == q.ids[None])
                upper[own] = np.inf
                best = np.concatenate([best, upper])
                if len(best) > k:
                    best = np.partition(best, k - 1, axis=0)[:k]
        n, m = best.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(best.reshape(-1))],
                                         names=["query_no", "upper"])

    slim = index.select(F.col("ids")[0].alias("id"), F.size("ids").alias("n"), "code", "length", "factor")
    least = Window.partitionBy("query_no").orderBy("upper")
    kth = slim.mapInArrow(run, "query_no int, upper double").withColumn("nth", F.row_number().over(least)) \
        .where(F.col("nth") <= k).where(F.col("nth") == k).select("query_no", "upper")
    out = np.full(len(block.value.ids), np.inf)
    for r in kth.collect():  # one row per query of the block
        out[r["query_no"]] = r["upper"]
    return out


def _rerank(index: DataFrame, block, limits, k: int, epsilon: float) -> DataFrame:
    """Exact distances of the vectors within the limits, each task's k best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = block.value
        best: list[list[tuple[float, int]]] = [[] for _ in q.ids]
        for b in batches:
            if not b.num_rows:
                continue
            vectors, ids = _matrix(b.column(0)), b.column(1).to_pylist()
            for i, codes, length, factor in _codes(b, 2):
                lower, _ = bounds(codes, length, factor, q, epsilon)
                for no in np.flatnonzero((lower <= limits.value).any(0)):
                    near = np.flatnonzero(lower[:, no] <= limits.value[no]) + i
                    score = lengths(vectors[near] - q.vectors[no])
                    if len(best[no]) >= k:
                        close = score <= best[no][k - 1][0]
                        near, score = near[close], score[close]
                    own = int(q.ids[no])
                    found = [(s, x) for s, j in zip(score.tolist(), near.tolist()) for x in ids[j] if x != own]
                    best[no] = sorted(best[no] + found)[:k]
        rows = [(no, int(q.ids[no]), x, s) for no, found in enumerate(best) for s, x in found]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                                         names=["query_no", "query_id", "vec_id", "score"])

    return index.select("vec", "ids", "code", "length", "factor").mapInArrow(run, _RESULT)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            expand: int = EXPAND, epsilon: float = EPSILON, block_size: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                          is_query.alias("asks")).where(F.col("id").isNotNull() & _usable("vec"))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    path = scratch_path(spark, "ann-result")
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == sizes["d"])
    index, turn = build_index(rows.select("id", "vec"), k, expand)
    queries = stored(rows.where("asks").select("id", "vec").distinct(), "ann-queries")
    written = False
    for part in _blocks(queries, block_size):
        given = np.array([r["vec"] for r in part])
        turned, length = turn.turn(given)
        block = Shared(spark, 
            Queries(np.array([r["id"] for r in part], np.int64), given, turned, length))
        limits = Shared(spark, _limits(index, block, k, epsilon))
        order = Window.partitionBy("query_no").orderBy("score", "vec_id")
        top = _rerank(index, block, limits, k, epsilon).withColumn("rank", F.row_number().over(order)) \
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        top.write.mode("append").parquet(path)
        written = True
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)


def _blocks(queries: DataFrame, size: int) -> Iterator[list[Row]]:
    """The queries, ``size`` at a time; the driver holds one block."""
    part: list[Row] = []
    for row in queries.toLocalIterator():
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
