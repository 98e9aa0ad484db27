"""Forgiving search: every query over all entries, up to one edit for every
ten characters.

A query of n characters matches a field that holds a substring within
k = floor(n * tolerance) insertions, deletions and replacements of it, anywhere
in the text, letters compared in lower case.  Cut into k + 1 pieces, the query
must have one piece that occurs unchanged (pigeonhole rule), so:

1. a text is scanned once for the first characters of all pieces of a block of
   queries: a rolling hash at every position, a bit table, a sorted list;
2. pieces are the leaves of a binary tree whose nodes join their neighbours.  Of
   a match, some piece occurs unchanged and all its ancestors of j pieces with
   fewer than j edits.  So the largest ancestor of at most 32 characters is
   compared first, for many places at once, which few of them survive;
3. where it survives, the stretch that a match could cover is compared with the
   whole query, bit-parallel, giving the least number of edits.  Overlapping
   stretches are compared once.

Queries go out in blocks of at most ``block_chars`` characters (or one query);
a block is what is broadcast, and each block is one pass over the entries.
Entries are never shuffled, only hits are.  Queries too short for an edit go to
the exact search.

Defined cases: null queries and those below the minimum length match nothing; a
null field is empty; a query of white space is searched like any other; equal
queries under two ids give both; no entry and no query give no hits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from slotvalue.operators.searchindex import LIMIT, MIN_QUERY, WEIGHTS, SearchIndex, search
from slotvalue.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: edits allowed per character.
TOLERANCE = 0.1
#: Characters of a piece that are looked up: the longest that fits.
_HEADS = (8, 5, 3, 2, 1)
#: Characters of the part of a query around a piece that is compared first.
_NODE = 32
_TABLE_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20     # characters hashed together
_PLACES = 1 << 16    # places compared together


def edits_allowed(n: int, tolerance: float = TOLERANCE) -> int:
    return int(n * tolerance + 1e-9)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _head_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters from every position that has them."""
    n = max(len(codes) - size + 1, 0)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h *= _BASE
        h += codes[i:i + n]
        h ^= h >> np.uint64(29)
    return h * _BASE


def least_edits(query: str, text: str) -> int:
    """Edits between ``query`` and the substring of ``text`` nearest to it.

    One column of the edit table per character of the text, its vertical steps
    kept as two bit sets (Myers' method; a match may start anywhere)."""
    m = len(query)
    where: dict[str, int] = {}
    for i, c in enumerate(query):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    for c in text:
        same = where.get(c, 0)
        flat = ((same & up) + up ^ up) | same | down
        rise, fall = down | full & ~(flat | up), up & flat
        score += bool(rise & last) - bool(fall & last)
        if score < best:
            best = score
            if not best:
                break
        rise, fall = rise << 1 & full, fall << 1 & full
        across = same | down
        up, down = fall | full & ~(across | rise), rise & across
    return best


def node_edits(patterns: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """``least_edits`` for rows of up to 32 characters and as many texts, filled
    up with characters that are equal to none."""
    one = np.uint64(1)
    last = one << (sizes - 1).astype(np.uint64)
    full = last << one
    full -= one
    up, down = full.copy(), np.zeros_like(full)
    score, best = sizes.astype(np.int32), sizes.astype(np.int32)
    for column in texts.T:
        same = np.packbits(patterns == column[:, None], axis=1, bitorder="little").view("<u4")[:, 0].astype(np.uint64)
        flat = ((same & up) + up ^ up) | same | down
        rise, fall = down | full & ~(flat | up), up & flat
        score += (rise & last) > 0
        score -= (fall & last) > 0
        np.minimum(best, score, out=best)
        rise, fall = rise << one & full, fall << one & full
        across = same | down
        up, down = fall | full & ~(across | rise), rise & across
    return best


def _node(cuts: list[int], leaf: int) -> tuple[int, int, int]:
    """(start, end, edits) of the largest part of the query above a piece that
    is short enough; of the piece's beginning, if it is too long itself."""
    lo, hi = 0, len(cuts) - 1
    while hi - lo > 1 and cuts[hi] - cuts[lo] > _NODE:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if leaf < mid else (mid, hi)
    return cuts[lo], min(cuts[hi], cuts[lo] + _NODE), hi - lo - 1


@dataclass
class Block:
    """Queries, and the heads of their pieces by length: a bit table, sorted
    hashes, and for each the rows that share it: (query, place of the piece,
    start, end and edits of the part above it)."""
    ids: list[int]
    texts: list[str]
    tolerance: float = TOLERANCE
    heads: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self):
        found: dict[int, list[tuple]] = {}
        for no, text in enumerate(self.texts):
            k = edits_allowed(len(text), self.tolerance)
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            codes = characters(text)
            for leaf, (a, b) in enumerate(zip(cuts, cuts[1:])):
                size = next(s for s in _HEADS if s <= b - a)
                found.setdefault(size, []).append((int(_head_hashes(codes[a:a + size], size)[0]), no, a, *_node(cuts, leaf)))
        self.codes = characters("".join(self.texts))
        self.starts = np.cumsum([0, *map(len, self.texts)])
        self.sizes = np.diff(self.starts)
        for size, rows in found.items():
            rows.sort()
            hashes, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[hashes >> np.uint64(64 - _TABLE_BITS)] = True
            self.heads[size] = (np.packbits(table), hashes, np.append(first, len(rows)),
                                np.array([r[1:] for r in rows], np.int32))

    def places(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, rows) of the piece heads found."""
        for size, (table, hashes, first, rows) in self.heads.items():
            for at in range(0, len(codes), _CHUNK):
                h = _head_hashes(codes[at:at + _CHUNK + size - 1], size)
                slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
                near = np.flatnonzero(table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                i = np.searchsorted(hashes, h[near])
                hit = hashes[np.minimum(i, len(hashes) - 1)] == h[near]
                near, i = near[hit], i[hit]
                many = first[i + 1] - first[i]
                owner = np.repeat(np.arange(len(near)), many)
                row = np.repeat(first[i], many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                yield near[owner] + at, rows[row]

    def survivors(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, position, query, place of the piece) where the part above
        the piece is near enough."""
        for all_pos, all_rows in self.places(codes):
            for at in range(0, len(all_pos), _PLACES):
                pos, (query, place, begin, end, most) = all_pos[at:at + _PLACES], all_rows[at:at + _PLACES].T
                text = np.searchsorted(ends, pos, "right")
                low, high = pos - place + begin - most, pos - place + end + most
                low, high = np.maximum(low, starts[text]), np.minimum(high, ends[text] - 1)
                wide = np.arange((high - low).max(initial=0))
                window = low[:, None] + wide
                window = np.where(window < high[:, None], codes[np.minimum(window, len(codes) - 1)], np.uint32(0xFFFFFFFF))
                size = end - begin
                part = self.starts[query][:, None] + begin[:, None] + np.arange(_NODE)
                part = np.where(np.arange(_NODE) < size[:, None], self.codes[np.minimum(part, len(self.codes) - 1)],
                                np.uint32(0xFFFFFFFE))
                near = node_edits(part, size, window) <= most
                yield text[near], pos[near], query[near], place[near]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, query, edits) of the texts that match."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = ends - [len(t) + 1 for t in texts]
        found = list(self.survivors(characters("\uffff".join(texts) + "\uffff"), starts, ends))
        if not found:
            return
        text, pos, query, place = (np.concatenate(x) for x in zip(*found))
        size = self.sizes[query]
        k = np.array([edits_allowed(n, self.tolerance) for n in self.sizes.tolist()])[query]
        low, high = np.maximum(pos - place - k, starts[text]), np.minimum(pos - place + size + k, ends[text] - 1)
        order = np.lexsort((low, query, text))
        group: tuple[int, int] | None = None
        stretches: list[list[int]] = []
        for t, q, a, b in zip(*(x[order].tolist() for x in (text, query, low, high))):
            if (t, q) != group:
                yield from self._compared(group, stretches, texts, starts)
                group, stretches = (t, q), []
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], b)
            else:
                stretches.append([a, b])
        yield from self._compared(group, stretches, texts, starts)

    def _compared(self, group, stretches, texts, starts) -> Iterator[tuple[int, int, int]]:
        if group is None:
            return
        t, q = group
        wanted, best = self.texts[q], edits_allowed(len(self.texts[q]), self.tolerance) + 1
        most = best - 1
        for a, b in stretches:
            best = min(best, least_edits(wanted, texts[t][a - starts[t]:b - starts[t]]))
            if not best:
                break
        if best <= most:
            yield t, q, best


def _blocks(queries: DataFrame, block_chars: int) -> Iterator[list[Row]]:
    """The queries, a block at a time; the driver holds one block."""
    part, size = [], 0
    for row in queries.toLocalIterator():
        if part and size + len(row["lq"]) > block_chars:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row["lq"])
    if part:
        yield part


def fuzzy_search(index: DataFrame | SearchIndex, queries: DataFrame, *, weights: Mapping[str, int] = WEIGHTS, tolerance: float = TOLERANCE,
                 limit: int | None = LIMIT, min_len: int = MIN_QUERY, block_chars: int = 1 << 20) -> DataFrame:
    """(query_id, query, entry_id, href, distance, score, rank): ``distance`` is
    the least number of edits over the fields, ``score`` the sum of the weights
    of the fields that match; ranked by distance, score, entry."""
    given = index.entries if isinstance(index, SearchIndex) else index
    spark, fields = given.sparkSession, list(weights)
    asked = queries.where(F.length("query") >= min_len).select("query_id", "query", F.lower("query").alias("lq"))
    plain = F.floor(F.length("lq") * tolerance + 1e-9) < 1
    entries = given.select("entry_id", "href", *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    kind = given.schema["entry_id"].dataType.simpleString()
    path = scratch_path(spark, "fuzzy-hits")
    schema = f"query_id long, entry_id {kind}, href string, distance int, score long"

    written = False
    for part in _blocks(asked.where(~plain), block_chars):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(
            Block([r["query_id"] for r in part], [r["lq"] for r in part], tolerance)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block: Block = cloudpickle.loads(shared.value)
            for b in batches:
                hits: dict[tuple[int, int], list[int]] = {}   # (entry, query) -> least edits, weights
                for f, col in zip(fields, b.columns[2:]):
                    for t, q, edits in block.matches(col.to_pylist()):
                        old = hits.get((t, q), [edits, 0])
                        hits[t, q] = [min(old[0], edits), old[1] + weights[f]]
                at = pa.array([t for t, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.ids[q] for _, q in hits], pa.int64()), b.column(0).take(at), b.column(1).take(at),
                     pa.array([d for d, _ in hits.values()], pa.int32()), pa.array([w for _, w in hits.values()], pa.int64())],
                    names=["query_id", "entry_id", "href", "distance", "score"])

        entries.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()
        written = True
    hits = spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)
    if not asked.where(plain).isEmpty():
        short = search(index, asked.where(plain).select("query_id", "query"), weights=weights, limit=None, min_len=min_len)
        hits = hits.unionByName(short.select("query_id", "entry_id", "href", F.lit(0).alias("distance"), "score"))
    best = Window.partitionBy("query_id").orderBy("distance", F.desc("score"), "entry_id")
    ranked = hits.withColumn("rank", F.row_number().over(best).cast("bigint"))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.join(queries.select("query_id", "query"), "query_id").select(
        "query_id", "query", "entry_id", "href", F.col("distance").cast("bigint").alias("distance"), "score", "rank")
