"""Exact substring deduplication with fixed-block anchors.

Texts are cut into words at ASCII white space, unchanged.  A window is
``window`` consecutive words of one document; every word covered by a window
whose words also start anywhere else (same document included) is removed.

Anchors: every document's non-overlapping blocks of ``(window + 1) // 2`` words
are the reference; every rolling window of that many words probes them.  Any
repeated window holds one whole block of each of its occurrences, so the other
occurrences hit that block.  Hits are extended: all windows around a hit are
compared by a 96-bit hash, and the union of the repeated ones is the maximal
exact repeat.

Documents are written once, in packs of about ``pack_bytes``, to a table
bucketed by pack.  Three passes read it:

1. every pack sends, to each of P ranges of the hash, the sorted distinct probe
   hashes that fall into it (30 bits of hash, "a block starts here", "more than
   once in this pack"); a range's task answers each pack with one bit per
   hash: does it meet a block and another occurrence?
2. around the hits, every pack sends the hashes of its windows in the same way
   and learns which occur more than once;
3. the covered words are removed.

A hash is sent at most once per pack, however often it occurs, and ranges are
even, so neither copies nor common passages load one task.  Answers are joined
to the packs bucket by bucket; the texts are never shuffled.

Defined cases: a null or blank text has no words and gives an empty text; texts
of fewer than ``window`` words lose nothing; repeated rows remove each other's
words like any copies; null ids are kept as they are; an empty table gives an
empty result.  Extra columns are ignored.  A single text larger than a pack is a
pack of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.common import column_bytes, stored
from slotvalue.session import scratch_path

WINDOW = 35
PACK_BYTES = 2 << 20
RANGE_BYTES = 8 << 20     # of text per range of the hash
BUCKET_BYTES = 64 << 20
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_SALTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


@dataclass
class Pack:
    """The words of several documents as hashes, one after another."""
    hashes: np.ndarray
    offsets: np.ndarray   # first word of every document, and the end

    @staticmethod
    def of(words: list[list[bytes]]) -> Pack:
        flat = [w for doc in words for w in doc]
        offsets = np.concatenate(([0], np.cumsum([len(doc) for doc in words]))).astype(np.int64)
        return Pack(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)), offsets)

    def starts(self, size: int) -> np.ndarray:
        """Positions where ``size`` words of one document start."""
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        place = np.arange(len(self.hashes))
        return place[place + size <= ends]

    def rolling(self, size: int, which: int) -> np.ndarray:
        """Hash of the ``size`` words from every position on (only those of
        ``starts`` mean anything)."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.uint64)
        x = (self.hashes ^ (self.hashes >> np.uint64(29))) * _SALTS[which]
        base = _BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        down = np.full(n + 1, inverse, np.uint64)
        down[0] = 1
        np.multiply.accumulate(down, out=down)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * down[:n])))
        up = np.full(n, base, np.uint64)
        up[0] = pow(int(base), size - 1, 1 << 64)
        np.multiply.accumulate(up, out=up)
        h = (total[size:] - total[:n - size + 1]) * up[:n - size + 1]
        h ^= h >> np.uint64(32)
        h *= _SALTS[1 - which]
        return h ^ (h >> np.uint64(29))


@dataclass
class Sent:
    """What a pack sends: sorted distinct hashes, and how they map back."""
    starts: np.ndarray    # word position of every window, in hash order
    group: np.ndarray     # number of its distinct hash
    cuts: np.ndarray      # distinct hashes of range r are cuts[r]:cuts[r + 1]
    payload: np.ndarray   # one record per distinct hash

    def messages(self, pack: int) -> Iterator[tuple[int, int, bytes]]:
        for r in np.flatnonzero(np.diff(self.cuts)):
            yield int(r), pack, self.payload[self.cuts[r]:self.cuts[r + 1]].tobytes()

    def chosen(self, answers: list[dict] | None) -> np.ndarray:
        """Positions of the windows whose bit is set in the ranges' answers."""
        hit = np.zeros(len(self.payload), bool)
        for a in answers or ():
            lo, hi = self.cuts[a["range"]], self.cuts[a["range"] + 1]
            hit[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo)
        return self.starts[hit[self.group]]


_WINDOW_RECORD = np.dtype([("high", "<u8"), ("low", "<u4")])


def _ranges(first: np.ndarray, ranges: int) -> np.ndarray:
    part = ((first >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(ranges + 1))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of every run of equal keys, number of each one's run)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def probes(pack: Pack, block: int, ranges: int) -> Sent:
    """Rolling windows of ``block`` words, those at a multiple of ``block`` in
    their document marked as reference blocks."""
    starts = pack.starts(block)
    h = pack.rolling(block, 0)[starts] if len(starts) else np.empty(0, np.uint64)
    doc_start = np.repeat(pack.offsets[:-1], np.diff(pack.offsets))
    fixed = (starts - doc_start[starts]) % block == 0
    order, first, group = _groups(h)
    if not len(order):
        return Sent(starts, group, np.zeros(ranges + 1, np.int64), np.empty(0, np.uint32))
    distinct = h[order][first]
    is_block = np.logical_or.reduceat(fixed[order], first)
    many = np.diff(np.append(first, len(order))) > 1
    payload = (distinct & np.uint64((1 << 30) - 1)).astype(np.uint32) << np.uint32(2)
    payload |= is_block.astype(np.uint32) << np.uint32(1) | many.astype(np.uint32)
    return Sent(starts[order], group, _ranges(distinct, ranges), payload)


def candidates(pack: Pack, hits: np.ndarray, window: int, block: int, ranges: int) -> Sent:
    """Windows that hold a hit."""
    n = len(pack.hashes)
    mark = np.zeros(n + 1, np.int64)
    mark[hits + 1] = 1
    upto = np.cumsum(mark)
    starts = pack.starts(window)
    starts = starts[upto[starts + window - block + 1] > upto[starts]]
    if not len(starts):
        return Sent(starts, starts, np.zeros(ranges + 1, np.int64), np.empty(0, _WINDOW_RECORD))
    high = pack.rolling(window, 0)[starts]
    low = (pack.rolling(window, 1)[starts] >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
    order, first, group = _groups(high, low)
    payload = np.empty(len(first), _WINDOW_RECORD)
    payload["high"], payload["low"] = high[order][first], low[order][first]
    payload["low"] |= (np.diff(np.append(first, len(order))) > 1).astype(np.uint32)
    return Sent(starts[order], group, _ranges(payload["high"], ranges), payload)


def meets_block(sent: np.ndarray) -> np.ndarray:
    """Of one range's probes: those whose hash is a block's and occurs twice."""
    order, first, group = _groups(sent >> np.uint32(2))
    flags = np.bitwise_or.reduceat(sent[order] & np.uint32(3), first)
    twice = (np.diff(np.append(first, len(order))) > 1) | (flags & 1 == 1)
    out = np.zeros(len(sent), bool)
    out[order] = (twice & (flags >> 1 == 1))[group]
    return out


def repeated(sent: np.ndarray) -> np.ndarray:
    """Of one range's windows: those that occur more than once."""
    order, first, group = _groups(sent["high"], sent["low"] >> np.uint32(1))
    many = np.bitwise_or.reduceat(sent["low"][order] & np.uint32(1), first) == 1
    out = np.zeros(len(sent), bool)
    out[order] = ((np.diff(np.append(first, len(order))) > 1) | many)[group]
    return out


def _write_packs(docs: DataFrame, id_col: str, text_col: str, pack_bytes: int, buckets: int) -> DataFrame:
    """(pack, ids, texts), bucketed by pack in a table of the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([texts], pa.list_(pa.binary()))], names=["pack", "ids", "texts"])

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), column_bytes(b.column(1))):
                if ids and size + len(text or b"") > pack_bytes:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(row)
                texts.append(text or b"")
                size += len(texts[-1]) + 16
        if ids:
            yield flush()

    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    name = f"llm_packs_{uuid.uuid4().hex}"
    src.mapInArrow(run, "pack long, ids array<long>, texts array<binary>").write.bucketBy(buckets, "pack") \
        .option("path", scratch_path(spark, "substring-packs")).option("compression", "zstd").saveAsTable(name)
    packs = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay for as long as the shared folder keeps them
    return packs


def _answers(sent: DataFrame, kind: np.dtype, judge, name: str) -> DataFrame:
    """(pack, answers: [(range, bits)]) from messages (range, pack, payload)."""
    def run(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), kind) for x in table.column("payload")]
        verdict = judge(np.concatenate(blobs))
        ends = np.cumsum([len(x) for x in blobs])
        rows = [(p, r, np.packbits(v).tobytes()) for p, r, v in
                zip(table.column("pack").to_pylist(), table.column("range").to_pylist(), np.split(verdict, ends[:-1]))
                if v.any()]
        return pa.table({"pack": pa.array([x[0] for x in rows], pa.int64()),
                         "range": pa.array([x[1] for x in rows], pa.int32()),
                         "bits": pa.array([x[2] for x in rows], pa.binary())})

    bits = sent.groupBy("range").applyInArrow(run, "pack long, range int, bits binary")
    return stored(bits.groupBy("pack").agg(F.collect_list(F.struct("range", "bits")).alias(name)), f"substring-{name}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept: the words that stay, joined by one space),
    one row per row."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(16, -(-total // RANGE_BYTES))
    packs = _write_packs(docs, id_col, text_col, pack_bytes, max(shuffles, -(-total // BUCKET_BYTES)))

    def words_of(texts) -> list[list[bytes]]:
        return [t.as_py().split() for t in texts.values]

    def send(which: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    pack = Pack.of(words_of(b.column("texts")[i]))
                    sent = probes(pack, block, ranges)
                    if which:
                        hits = sent.chosen(b.column("hits")[i].as_py())
                        sent = candidates(pack, hits, window, block, ranges)
                    rows = list(sent.messages(b.column("pack")[i].as_py()))
                    if rows:
                        cols = zip(*rows)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(next(cols), pa.int32()), pa.array(next(cols), pa.int64()),
                            pa.array(next(cols), pa.binary())], names=["range", "pack", "payload"])
        return run

    message = "range int, pack long, payload binary"
    hits = _answers(packs.select("pack", "texts").mapInArrow(send(0), message), np.dtype("<u4"), meets_block, "hits")
    found = packs.select("pack", "texts").join(hits, "pack").mapInArrow(send(1), message)
    repeats = _answers(found, _WINDOW_RECORD, repeated, "repeats")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = words_of(b.column("texts")[i])
                covered = np.zeros(sum(map(len, words)) + 1, np.int64)
                offsets = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
                answers = b.column("repeats")[i].as_py()
                if answers:
                    pack = Pack.of(words)
                    around = probes(pack, block, ranges).chosen(b.column("hits")[i].as_py())
                    starts = candidates(pack, around, window, block, ranges).chosen(answers)
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + window, -1)
                gone = np.cumsum(covered)[:-1] > 0
                kept = [b" ".join([w for w, g in zip(doc, gone[lo:hi].tolist()) if not g])
                        for doc, lo, hi in zip(words, offsets[:-1], offsets[1:])]
                upto = np.concatenate(([0], np.cumsum(gone)))
                yield pa.RecordBatch.from_arrays([
                    b.column("ids")[i].values, pa.array(np.diff(offsets)),
                    pa.array(np.diff(upto[offsets]).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "n_removed", "kept"])

    joined = packs.join(hits, "pack", "left").join(repeats, "pack", "left")
    return joined.select("ids", "texts", "hits", "repeats").mapInArrow(
        remove, "id long, n_words long, n_removed long, kept string")
