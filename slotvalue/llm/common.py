"""Helpers shared by the corpus operators: scratch tables on the cluster's
shared folder, code shipping, text buffers and connected components."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotvalue.session import scratch_path

# The functions that run in tasks are pickled with their code, so executors
# do not need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A-Z to a-z on UTF-8 bytes; every other byte is left as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Shared:
    """A broadcast of any object of these modules: it is sent with the code of
    its class, so executors need no package to read it."""

    def __init__(self, spark: SparkSession, value):
        self.sent, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), value

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = cloudpickle.loads(self.sent.value)
        return self.held

    def release(self) -> None:
        """Drop the object and its broadcast; no later job may use it."""
        self.held = None
        self.sent.destroy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    a lost executor costs no recomputation, and Spark knows the size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs started meanwhile send Python at most ``size`` bytes (or one row)
    at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def column_bytes(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string (or binary) column, nulls kept."""
    return col.cast(pa.large_binary()).to_pylist()


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, n + 1 offsets); null is empty."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    base = int(offs[0]) if len(offs) else 0
    size = int(offs[-1]) - base if len(offs) else 0
    raw = np.frombuffer(data, np.uint8, size, base) if size else np.empty(0, np.uint8)
    return raw, offs - base


def cuts(offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts that have at most ``size`` bytes, or of one text."""
    first = 0
    while first < len(offs) - 1:
        end = max(int(np.searchsorted(offs, offs[first] + size, "right")) - 1, first + 1)
        yield first, end
        first = end


#: Bytes of text whose n-grams are looked up together.
CHUNK = 1 << 18


_BLANK = re.compile(rb"[ \t-\r]")


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of some ``CHUNK`` bytes at a time."""
    at = 0
    while len(text) - at > CHUNK:
        blank = _BLANK.search(text, at + CHUNK)
        if not blank:
            break
        yield text[at:blank.start()].split()
        at = blank.end()
    yield text[at:].split()


def characters(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 texts as numbers (a character's bytes, the first
    one lowest), and the offsets of the texts among them.  ASCII comes back as
    it is.  Damaged UTF-8 is cut before each byte that may start a character."""
    if not len(raw) or raw.max() < 0x80:
        return raw, offs
    filled = np.flatnonzero(np.diff(offs))
    lead = (raw & 0xC0) != 0x80
    lead[offs[filled]] = True
    before = np.zeros(len(offs), np.int64)  # characters before each offset
    chars, done = np.empty(np.count_nonzero(lead), np.uint32), 0
    for a in range(0, len(raw), CHUNK):
        at = np.flatnonzero(lead[a:a + CHUNK])
        first, last = np.searchsorted(offs, (a, a + CHUNK), "right")
        before[first:last] = done + np.searchsorted(at, offs[first:last] - a)
        at += a
        code, inside = raw[at].astype(np.uint32), np.ones(len(at), bool)
        for j in (1, 2, 3):
            near = np.minimum(at + j, len(raw) - 1)
            inside &= (at + j < len(raw)) & ~lead[near]
            code |= np.where(inside, raw[near].astype(np.uint32) << np.uint32(8 * j), np.uint32(0))
        chars[done:done + len(at)] = code
        done += len(at)
    return chars, before


def sampled(rows: DataFrame, key: str, label: str, rates: dict) -> DataFrame:
    """The rows whose ``key``, a 64-bit hash of what makes them differ, falls
    under their label's rate, in any layout of the files the same; rows of one
    key count once."""
    limit = F.lit(None).cast("long")
    for value, rate in rates.items():
        limit = F.when(F.col(label) == value, int(rate * (1 << 40))).otherwise(limit)
    return rows.where(F.col(key).bitwiseAND(F.lit((1 << 40) - 1)) < limit).dropDuplicates([label, key])


def gram_buckets(raw: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket, of 2**bits, of the n-gram at every position that has ``order``
    bytes."""
    n = len(raw) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h *= np.uint32(0x01000193)
        h ^= raw[i:i + n]
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


def gram_chunks(raw: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first position, order, buckets from there on) for all n-grams of
    ``raw``, chunk by chunk, so a very long text needs no more memory."""
    for at in range(0, len(raw), CHUNK):
        for order in orders:
            yield at, order, gram_buckets(raw[at:at + CHUNK + order - 1], order, bits)


def gram_means(raw: np.ndarray, offs: np.ndarray, weights: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Per text, the mean of the weights (numbers or rows) of its n-grams."""
    sums = np.zeros((len(offs) - 1, *weights.shape[1:]))
    size = np.diff(offs)
    counts = sum(np.maximum(size - order + 1, 0) for order in orders)
    filled = np.flatnonzero(size)
    starts, ends = offs[:-1][filled], offs[1:][filled]
    for at, order, idx in gram_chunks(raw, orders, bits):
        if not len(idx):
            continue
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(idx))
        part = weights[idx]
        for back in range(1, order):  # n-grams must not run into the next text
            over = ends[first:last] - back - at
            part[over[(over >= 0) & (over < len(idx))]] = 0
        cuts = np.maximum(starts[first:last] - at, 0)
        sums[filled[first:last]] += np.add.reduceat(part, cuts, axis=0)
    return sums / np.maximum(counts, 1).reshape(-1, *[1] * (weights.ndim - 1))


def gram_counts(raw: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Number of n-grams of one text in each bucket."""
    total = np.zeros(1 << bits, np.int64)
    for _, _, idx in gram_chunks(raw, orders, bits):
        total += np.bincount(idx, minlength=1 << bits)
    return total


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def map_columns(df: DataFrame, inputs: list[Column | str], fn: Callable[..., list], added: list[tuple[str, str]]) -> DataFrame:
    """All columns of ``df`` and the ``added`` (name, type) ones, which
    ``fn(*arrays)`` computes from the Arrow arrays of ``inputs``, batch by
    batch; the name of a column of ``df`` as an input is not sent twice.  A name
    that is taken gets underscores in front."""
    kept, names = len(df.columns), list(df.columns)
    fields = list(df.schema.fields)
    for name, kind in added:
        names.append(free_name(names, name))
        fields.append(T.StructField(names[-1], T._parse_datatype_string(kind)))
    sent = [c for c in inputs if not isinstance(c, str)]
    src = df.select("*", *[c.alias(free_name(names, f"in{i}")) for i, c in enumerate(sent)])
    extra = iter(range(kept, kept + len(sent)))
    places = [df.columns.index(c) if isinstance(c, str) else next(extra) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *fn(*[b.column(i) for i in places])], names=names)

    return src.mapInArrow(run, T.StructType(fields))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long, no nulls) as
    (node, root), root being the smallest node; one row per node of an edge.

    Alternating large-star and small-star steps.  The smallest neighbour of a
    node comes from a partial aggregate and is joined back, so a node with a
    large share of all links is never collected in one place; AQE splits the
    join's skewed side.  Each step is written to the shared folder.
    """
    one = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, last = stored(one, name), None
    while True:
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), name)  # every edge points down
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        state = stored(small.where("a <> b").distinct(), name)
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
