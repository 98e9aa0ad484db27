"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A-Z are lower-cased and words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
(digits, letters and everything outside ASCII).  A benchmark item's windows
are its runs of ``window`` consecutive words; an item of fewer words, but not
none, is one window.  Every document word inside an occurrence of a window is
hit.  A document is contaminated if it has hit words and they are at least
``1 / share`` of its words.

The search treats words as symbols.  Windows of one length m are searched
together: for each position the block of words that ends there is hashed into a
shift table.  A block that occurs in no window lets the search skip all
positions up to m - block + 1 further on; blocks that share a slot have the
smaller shift, so none is skipped.  A block that ends a window leads, with the
hash of the first block, to the windows with these two, and their words are
compared directly.  Documents without benchmark text are read at about one
lookup for every dozen words.

The benchmark is read item by item and cut into parts whose tables take at most
``part_bytes`` (or one window); long items are cut between windows.  A table
holds the items' words once, in one run of bytes, and windows as places in it,
so its size follows from the words' bytes and not from Python objects.  A part
is one broadcast and one pass over the documents, and is released before the
next is built, so the driver holds one part's tables at a time.  With several
parts the passes give spans, which are stored, joined by text hash and merged.

Defined cases: a null, empty or word-less text has no words and is clean; an
item without words has no windows; an item whose id is null marks words but is
not counted as an item; repeated items count once per id; an empty benchmark
hits nothing; repeated documents get equal results.  Extra columns are kept by
``mark``; a clashing name of theirs stays and the new column gets an underscore
in front.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.common import Shared, column_bytes, free_name, map_columns, stored
from slotvalue.session import scratch_path

WINDOW = 13
SHARE = 20
PART_BYTES = 64 << 20
BLOCK = 2
#: Bytes that a table needs besides the words' own: a word's offset, blank and
#: share of the shift table; a window's key, place and owner; an item's name.
_PER_WORD, _PER_WINDOW, _PER_ITEM = 21, 24, 100
#: Word bytes, A-Z lower-cased; every other byte becomes a blank.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
               for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


@dataclass
class Table:
    """Shift table and windows of one length."""
    length: int
    block: int
    shifts: bytes            # by hash of a block: positions to skip, 0 at the end of a window; _BEGINS: it begins one
    text: bytes              # the items' words, each with a blank after it
    offsets: np.ndarray      # first byte of every word, and the end
    keys: np.ndarray         # of the distinct windows, sorted: halves of the hashes of their last and first blocks
    places: np.ndarray       # their first words
    owned: np.ndarray        # owners of window i are owners[owned[i]:owned[i + 1]]
    owners: np.ndarray
    names: list              # of the items

    def matches(self, last: int, first: int, seq: list[bytes]) -> Iterator[int]:
        """Numbers of the windows that are ``seq``, whose last and first block have these hashes."""
        key = np.uint64((last & ~_HALF) | (first >> 32))
        whole, i = b" ".join(seq), int(np.searchsorted(self.keys, key))
        while i < len(self.keys) and self.keys[i] == key:
            at = self.places[i]
            if self.text[self.offsets[at]:self.offsets[at + self.length] - 1] == whole:
                yield i
            i += 1


_hash = xxhash.xxh3_64_intdigest
_HALF = (1 << 32) - 1
_BEGINS = 128


def build(items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> list[Table]:
    """One table per window length."""
    by_length: dict[int, list] = defaultdict(list)
    for name, seq in items:
        if seq:
            by_length[min(window, len(seq))].append((name, seq))
    return [_table(m, own) for m, own in sorted(by_length.items())]


def _table(m: int, items: list[tuple[object, list[bytes]]]) -> Table:
    block = min(BLOCK, m)
    flat = [w for _, seq in items for w in seq]
    text = b" ".join(flat) + b" "
    offsets = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1, out=offsets[1:])
    del flat

    def hashed(starts: np.ndarray, size: int) -> np.ndarray:
        ends = offsets[starts + size] - 1
        return np.fromiter((_hash(text[a:z]) for a, z in zip(offsets[starts].tolist(), ends.tolist())),
                           np.uint64, len(starts))

    sizes = np.array([len(seq) for _, seq in items])
    counts, first = sizes - m + 1, np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(items), dtype=np.int32), counts)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    blocks = hashed(np.arange(len(offsets) - block), block)
    slots = 1 << len(blocks).bit_length() + 3  # so sparse that few blocks share a slot
    slot = (blocks & np.uint64(slots - 1)).astype(np.int64)
    shifts = np.full(slots, min(m - block + 1, _BEGINS - 1), np.uint8)
    for at in range(m - block + 1):  # nearer the end, so the smaller shift stays
        shifts[slot[starts + at]] = min(m - block - at, _BEGINS - 1)
    shifts[slot[starts]] |= _BEGINS

    keys = (blocks[starts + m - block] & ~np.uint64(_HALF)) | (blocks[starts] >> np.uint64(32))
    whole = hashed(starts, m)
    order = np.lexsort((owner, whole, keys))
    keys, whole, owner, starts = keys[order], whole[order], owner[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
    for i in np.flatnonzero(~new):  # equal hashes: the words decide
        a, b = starts[i - 1], starts[i]
        new[i] = text[offsets[a]:offsets[a + m]] != text[offsets[b]:offsets[b + m]]
    kept = new.copy()
    kept[1:] |= owner[1:] != owner[:-1]
    small = np.int32 if len(text) < 1 << 31 else np.int64
    return Table(m, block, shifts.tobytes(), text, offsets.astype(small), keys[new], starts[new].astype(np.int32),
                 np.append(np.flatnonzero(new[kept]), kept.sum()).astype(np.int32), owner[kept], [n for n, _ in items])


def search(seq: list[bytes], tables: list[Table]) -> tuple[list[tuple[int, int]], set]:
    """(merged spans of hit words as [start, end), names of items found)."""
    spans: list[tuple[int, int]] = []
    found: set = set()
    n = len(seq)
    for t in tables:
        m, block, shifts, at = t.length, t.block, t.shifts, t.length
        mask, seen = len(shifts) - 1, set()
        while at <= n:
            last = _hash(b" ".join(seq[at - block:at]))
            step = shifts[last & mask] & ~_BEGINS
            if not step:
                first = _hash(b" ".join(seq[at - m:at - m + block]))
                if shifts[first & mask] & _BEGINS:
                    for i in t.matches(last, first, seq[at - m:at]):
                        spans.append((at - m, at))
                        if i not in seen:
                            seen.add(i)
                            found.update(t.names[o] for o in t.owners[t.owned[i]:t.owned[i + 1]])
                step = 1
            at += step
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, part_bytes: int):
    """(list of (id, words), whether it is the last) whose tables take at most
    ``part_bytes``, or a single window; read item by item."""
    part, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()
    for name, text in rows:
        seq = words((text or "").encode("utf-8"))
        if not seq:
            continue
        m, begin = min(window, len(seq)), 0
        named = _PER_ITEM + len(name or "")
        for i in range(len(seq) - m + 1):
            need = _PER_WINDOW + _PER_WORD + len(seq[i + m - 1])  # one more window of the piece
            alone = named + _PER_WINDOW + sum(map(len, seq[i:i + m])) + _PER_WORD * m if i == begin else 0
            if size + max(need, alone) > part_bytes and (part or i > begin):
                if i > begin:
                    part.append((name, seq[begin:i - 1 + m]))
                yield part, False
                part, size, begin = [], 0, i
                alone = named + _PER_WINDOW + sum(map(len, seq[i:i + m])) + _PER_WORD * m
            size += max(need, alone)
        part.append((name, seq[begin:]))
    if part:
        yield part, True


def _digest(names: set) -> str:
    return hashlib.sha256(",".join(sorted(n for n in names if n is not None)).encode()).hexdigest()


_ADDED = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"),
          ("contaminated", "boolean")]


def _columns(rows: list[tuple[int, int, set]], share: int) -> list[pa.Array]:
    n_words = [r[0] for r in rows]
    n_hit = [r[1] for r in rows]
    names = [{n for n in r[2] if n is not None} for r in rows]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, names), pa.int64()),
            pa.array([_digest(n) for n in names], pa.string()),
            pa.array([h > 0 and share * h >= w for w, h in zip(n_words, n_hit)], pa.bool_())]


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, share: int = SHARE,
         part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    parts = _parts(benchmark, item_id, item_text, window, part_bytes)
    part, last = next(parts, ([], True))
    if last:
        shared = Shared(spark, build(part, window))

        def run(texts: pa.Array) -> list[pa.Array]:
            found = []
            for t in column_bytes(texts):
                seq = words(t)
                spans, names = search(seq, shared.value)
                found.append((len(seq), sum(b - a for a, b in spans), names))
            return _columns(found, share)

        return map_columns(docs, [text], run, _ADDED)
    return _mark_in_parts(docs, text, chain([(part, last)], parts), window, share)


def _mark_in_parts(docs: DataFrame, text: F.Column, parts: Iterator[tuple[list, bool]], window: int,
                   share: int) -> DataFrame:
    """One pass per part; the spans of a text meet by its hash."""
    spark = docs.sparkSession
    key = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    path = scratch_path(spark, "decontam-spans")
    schema = "key string, spans array<long>, names array<string>"
    for items, _ in parts:
        shared = Shared(spark, build(items, window))

        def run(texts: pa.Array, shared=shared) -> list[pa.Array]:
            got = [search(words(t), shared.value) for t in column_bytes(texts)]
            return [pa.array([np.array(s, np.int64).reshape(-1).tolist() for s, _ in got], pa.list_(pa.int64())),
                    pa.array([sorted(n for n in names if n is not None) for _, names in got], pa.list_(pa.string()))]

        part = map_columns(docs.select(key.alias("key"), text.alias("text")), [F.col("text")], run,
                           [("spans", "array<long>"), ("names", "array<string>")]).select("key", "spans", "names")
        part.where(F.size("spans") > 0).distinct().write.mode("append").parquet(path)
        shared.release()
    found = spark.read.schema(schema).parquet(path)
    hits = stored(found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                           F.flatten(F.collect_list("names")).alias("names")), "decontam-hits")
    names = [free_name(docs.columns, c) for c in ("key", "spans", "names")]
    joined = docs.withColumn(names[0], key).join(hits.toDF(*names), names[0], "left")

    def run_all(texts: pa.Array, spans: pa.Array, items: pa.Array) -> list[pa.Array]:
        rows = []
        for t, s, n in zip(column_bytes(texts), spans.to_pylist(), items.to_pylist()):
            s = s or []
            rows.append((len(words(t)), sum(b - a for a, b in merged(list(zip(s[::2], s[1::2])))), set(n or ())))
        return _columns(rows, share)

    wide = joined.select(*[joined[c] for c in docs.columns], *[joined[c] for c in names[1:]])
    return map_columns(wide, [text, F.col(names[1]), F.col(names[2])], run_all, _ADDED).drop(*names[1:])
