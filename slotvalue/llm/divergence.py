r"""Source divergence audit by a recount over minimal perfect hashes.

Terms are runs of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]`` with A-Z lower-cased; null
text, lang and source count as ''.  A language keeps the V terms that occur in
at least ``min_docs`` of its documents.  A group, a (lang, source) that occurs,
and the language itself give each kept term with n occurrences the share
p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N being the sum of n over kept terms.
Two shares diverge by floor((p - q)^2 / (p + q)).  All arithmetic is exact.

1. Exact frequency filter: every task counts the documents of each term, and one
   aggregate adds the counts up.
2. Kept terms are cut into shards of about ``SHARD`` terms of one language by
   their hash.  A shard is one row: a minimal perfect hash (levels of bits at
   which a term stands alone, numbered by rank) and its terms in slot order.
3. Recount: the shards are broadcast, at most about ``pass_terms`` terms at a
   time; a term read in a text is hashed to its slot and compared with the term
   stored there.  Documents are sorted by group within their task, which holds
   one dense array of slots and writes its counts, packed, when the group ends.
   If the kept terms need several passes, tasks first write their counts by
   term, parted by pass, so that each pass reads its own part and no text is
   read again.
4. Counts of a (group, shard) are added up in a sorted stream, one dense array
   at a time.  Pairs of sources are compared in tiles of ``TILE`` sources by one
   shard.  Terms are compared with their language in a stream over the shards,
   which offers ten terms a source and shard.

No task holds more than a few shards, whatever the number of documents, sources
or terms; a hot language or source is spread over its shards.

Defined cases: a group without terms gives every kept term a count of 0; V = 0
gives pairs of value 0 and no terms; a language of one source has no pairs;
repeated rows count as often as they come; an empty table gives an empty result;
texts of any length are read a piece at a time, cut between terms.  A language
may have up to 9 * 10^15 occurrences.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from slotvalue.llm.common import Shared, column_bytes, stored
from slotvalue.session import scratch_path

MIN_DOCS = 10
TOP = 10
UNIT = 10 ** 9
SHARD = 8192             # terms
PASS_TERMS = 2_000_000   # terms broadcast together
TILE = 64                # sources
_HELD = 400_000          # different terms that a task counts before it writes or looks them up
_PIECE = 1 << 20         # bytes of a text cut into terms together
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAMMA = 2
_STEP, _MIX = 0x9E3779B97F4A7C15, [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    text = (text or b"").translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


# ---------------------------------------------------- minimal perfect hashes

def _level_hash(h: np.ndarray, level: int) -> np.ndarray:
    x = (h + np.uint64(level * _STEP % (1 << 64))) * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(29))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def perfect(words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits in 64-bit words, slot of each of
    the distinct ``words``)."""
    h, left, sizes, levels, place, base = _hashes(words), np.arange(len(words)), [], [], np.empty(len(words), np.int64), 0
    while len(left):
        if len(sizes) == 64:
            raise ValueError("two terms share a 64-bit hash")
        size = -(-_GAMMA * len(left) // 64) * 64
        at = (_level_hash(h[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        place[left[alone]] = base + at[alone]
        levels.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        left, base = left[~alone], base + size
    slot = np.empty(len(words), np.int64)
    slot[np.argsort(place)] = np.arange(len(words))
    return sizes, np.concatenate(levels), slot


class Hashes:
    """The perfect hashes of several shards, looked up together."""

    def __init__(self, shards: list[Row]):
        shards = sorted(shards, key=lambda r: (r["lang"], r["shard"]))
        depth = max(len(r["sizes"]) for r in shards)
        self.sizes = np.array([r["sizes"] + [0] * (depth - len(r["sizes"])) for r in shards], np.int64)
        total = self.sizes.sum(1)
        self.starts = (np.cumsum(total) - total)[:, None] + np.cumsum(self.sizes, 1) - self.sizes
        self.words = np.frombuffer(b"".join(r["bits"] for r in shards), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.first = np.cumsum([0, *(len(r["terms"]) for r in shards)])
        self.terms = pa.array([t for r in shards for t in r["terms"]], pa.large_binary())
        self.number = [r["shard"] for r in shards]
        self.langs: dict[str, np.ndarray] = {}   # shard -> its place here, or -1
        for i, r in enumerate(shards):
            self.langs.setdefault(r["lang"], np.full(r["shards"], -1))[r["shard"]] = i

    def span(self, lang: str) -> tuple[int, int]:
        """Range of the slots of a language (its shards lie side by side)."""
        here = self.langs[lang]
        here = here[here >= 0]
        return int(self.first[here.min()]), int(self.first[here.max() + 1])

    def look_up(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Slot of every word over all shards, -1 where it is no kept term of
        these shards."""
        places = self.langs[lang]
        part = np.fromiter((xxhash.xxh64_intdigest(w, 42) >> 32 for w in words), np.int64, len(words))
        shard = places[part * len(places) >> 32]
        out = np.full(len(words), -1)
        left = np.flatnonzero(shard >= 0)
        h = _hashes(words)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = (_level_hash(h[left], level) % size.astype(np.uint64)).astype(np.int64) + self.starts[shard[left], level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.rank[at >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
        some = np.flatnonzero(out >= 0)
        same = pc.equal(self.terms.take(pa.array(out[some])), pa.array([words[i] for i in some.tolist()], pa.large_binary()))
        out[some[~np.asarray(same)]] = -1
        return out


# ------------------------------------------------------------ packed counts

def pack(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned integers that hold them."""
    top = int(counts.max(initial=0))
    return counts.astype(next(f"<u{b}" for b in (1, 2, 4, 8) if top < 1 << 8 * b)).tobytes()


def unpack(slots: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(slots, "<u4").astype(np.int64)
    return at, np.frombuffer(counts, f"<u{len(counts) // max(len(at), 1) or 1}").astype(np.int64)


def share(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of the counts; three digits at a time, so no product leaves a long."""
    whole, rest = np.divmod(counts + 2, total + 2 * kept)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total + 2 * kept)
        whole = whole * 1000 + digits
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _streamed(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(rows)`` over the rows of every task, those of a key side by side
    and in order; memory does not grow with a key's rows.  They are dealt by a
    hash of the key: dealt by the key itself, Spark would leave that out behind a
    join on the same key, and may then cut a key's rows to even out the join."""
    cols = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(cols, row)) for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from fn(rows)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 256) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield _batch(part, fields)
            part = []
    if part:
        yield _batch(part, fields)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


# ------------------------------------------------------------------- passes

@dataclass
class Audit:
    docs: DataFrame           # lang, source, text without nulls
    shards: DataFrame         # lang, shard, shards, kept, size, pass, sizes, bits, terms
    langs: DataFrame          # lang, kept, shards
    passes: int


def _plain(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in
                         ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs) of every term, exact."""
    fields = [("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def written() -> Iterator[pa.RecordBatch]:
            yield from _batches(((g, t, n) for g, c in seen.items() for t, n in c.items()), fields, 1 << 16)
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), column_bytes(b.column(1))):
                seen[lang].update(set().union(*terms(text)))
                if sum(map(len, seen.values())) > _HELD:
                    yield from written()
        yield from written()

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long")
    return parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def prepare(docs: DataFrame, min_docs: int = MIN_DOCS, pass_terms: int = PASS_TERMS, shard_terms: int = SHARD) -> Audit:
    """The kept terms of every language as perfect hashes."""
    kept = stored(document_counts(docs).where(F.col("docs") >= min_docs).select("lang", "term"), "audit-terms")
    langs = stored(kept.groupBy("lang").agg(F.count("*").alias("kept")).withColumn(
        "shards", F.ceil(F.col("kept") / shard_terms).cast("int")), "audit-langs")
    total = langs.agg(F.sum("kept")).first()[0] or 0
    passes = max(1, -(-total // pass_terms))
    number = F.expr("cast(shiftright(shiftrightunsigned(xxhash64(term), 32) * shards, 32) as int)")
    fields = [("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("terms", pa.list_(pa.binary()))]

    def build(group: pa.Table) -> pa.Table:
        words = group.column("term").to_pylist()
        sizes, bits, slot = perfect(words)
        row = [[sizes], [bits.tobytes()], [[words[i] for i in np.argsort(slot).tolist()]]]
        first = group.slice(0, 1)
        return pa.table([*(first.column(c) for c in ("lang", "shard", "shards", "kept")), pa.array([len(words)], pa.int64()),
                         *(pa.array(v, t) for v, (_, t) in zip(row, fields))],
                        names=["lang", "shard", "shards", "kept", "size", *(n for n, _ in fields)])

    rows = kept.join(langs, "lang").withColumn("shard", number).select("lang", "shard", "shards", "kept", "term")
    shards = rows.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard int, shards int, kept long, size long, sizes array<long>, bits binary, terms array<binary>")
    placed = shards.withColumn("pass", F.pmod(F.xxhash64("lang", "shard"), F.lit(passes)).cast("int"))
    return Audit(docs, stored(placed, "audit-shards"), langs, passes)


def _grouped(rows: Iterator[tuple[str, str, object]], add: Callable[[Counter, object], Iterator]) -> Iterator:
    """(lang, source, counter, whether the group ends) for rows sorted by
    group; counters are handed on before they grow beyond ``_HELD`` terms."""
    group, seen = None, Counter()
    for lang, source, item in rows:
        if group not in (None, (lang, source)):
            yield *group, seen, True
            seen = Counter()
        group = lang, source
        for _ in add(seen, item):
            if len(seen) > _HELD:
                yield *group, seen, False
                seen.clear()
    if group:
        yield *group, seen, True


def _add_text(seen: Counter, text: bytes) -> Iterator[None]:
    for piece in terms(text):
        seen.update(piece)
        yield


def _add_count(seen: Counter, item: tuple[bytes, int]) -> Iterator[None]:
    seen[item[0]] += item[1]
    yield


_COUNTS = [("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())]
_COUNTS_DDL = "lang string, source string, shard int, slots binary, counts binary"


def _slot_counts(grouped: Iterator, hashes: Hashes) -> Iterator[tuple]:
    """Rows of packed counts per (group, shard), from one dense array."""
    dense, begin = None, 0
    for lang, source, seen, ends in grouped:
        if lang not in hashes.langs:
            continue
        if dense is None:
            begin, end = hashes.span(lang)
            dense = np.zeros(end - begin, np.int64)
        slots = hashes.look_up(lang, list(seen))
        found = slots >= 0
        dense[slots[found] - begin] += np.fromiter(seen.values(), np.int64, len(seen))[found]
        if ends:
            used = np.flatnonzero(dense)
            cuts = hashes.first[hashes.langs[lang][hashes.langs[lang] >= 0]] - begin
            owner = np.searchsorted(cuts, used, "right") - 1
            here = np.flatnonzero(hashes.langs[lang] >= 0)
            for k in np.unique(owner).tolist():
                at = used[owner == k]
                yield lang, source, int(here[k]), (at - cuts[k]).astype("<u4").tobytes(), pack(dense[at])
            dense = None


def count_slots(audit: Audit) -> DataFrame:
    """(lang, source, shard, slots, counts, n): the counts of every group, added
    up; no row where a group has none of a shard's terms."""
    spark = audit.docs.sparkSession
    path = scratch_path(spark, "audit-counts")
    sorted_docs = audit.docs.sortWithinPartitions("lang", "source")
    parted = None
    if audit.passes > 1:
        parted = scratch_path(spark, "audit-partial")
        _partial_counts(sorted_docs, audit).write.partitionBy("pass").parquet(parted)
    for i in range(audit.passes):
        rows = audit.shards.where(F.col("pass") == i).select("lang", "shard", "shards", "sizes", "bits", "terms").collect()
        if not rows:
            continue
        shared = Shared(spark, Hashes(rows))  # about pass_terms terms
        del rows

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            read = ((lang, source, text) for b in batches for lang, source, text in
                    zip(b.column(0).to_pylist(), b.column(1).to_pylist(), column_bytes(b.column(2))))
            yield from _batches(_slot_counts(_grouped(read, _add_text), shared.value), _COUNTS)

        def run_part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            read = ((lang, source, (term, n)) for b in batches for lang, source, term, n in
                    zip(*(c.to_pylist() for c in b.columns)))
            yield from _batches(_slot_counts(_grouped(read, _add_count), shared.value), _COUNTS)

        if parted is None:
            found = sorted_docs.mapInArrow(run, _COUNTS_DDL)
        else:
            part = spark.read.schema("lang string, source string, term binary, n long, pass int").parquet(parted)
            found = part.where(F.col("pass") == i).select("lang", "source", "term", "n") \
                .sortWithinPartitions("lang", "source").mapInArrow(run_part, _COUNTS_DDL)
        found.write.mode("append").parquet(path)
        shared.release()
    if audit.shards.isEmpty():
        return spark.createDataFrame([], _COUNTS_DDL + ", n long")
    return stored(merged(spark.read.schema(_COUNTS_DDL).parquet(path), ["lang", "source", "shard"], audit), "audit-groups")


def _partial_counts(docs: DataFrame, audit: Audit) -> DataFrame:
    """(lang, source, term, n, pass): every task's counts of the terms it read,
    kept or not, parted by the pass that looks them up."""
    fields = [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ((lang, source, text) for b in batches for lang, source, text in
                zip(b.column(0).to_pylist(), b.column(1).to_pylist(), column_bytes(b.column(2))))
        for lang, source, seen, _ in _grouped(read, _add_text):
            yield from _batches(((lang, source, t, n) for t, n in seen.items()), fields, 1 << 16)

    counted = docs.mapInArrow(run, "lang string, source string, term binary, n long").join(audit.langs, "lang")
    number = F.expr("cast(shiftright(shiftrightunsigned(xxhash64(term), 32) * shards, 32) as int)")
    return counted.withColumn("shard", number).select(
        "lang", "source", "term", "n", F.pmod(F.xxhash64("lang", "shard"), F.lit(audit.passes)).cast("int").alias("pass"))


def merged(counts: DataFrame, keys: list[str], audit: Audit) -> DataFrame:
    """Counts of one key added up slot by slot, with their sum ``n``."""
    sizes = audit.shards.select("lang", "shard", "size")
    rows = counts.join(sizes, ["lang", "shard"]).select(*keys, "size", "slots", "counts")
    fields = [(k, pa.int32() if k == "shard" else pa.string()) for k in keys] + [
        ("slots", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())]

    def add(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            key, dense = None, None
            for r in rows:
                this = tuple(r[k] for k in keys)
                if this != key:
                    if key is not None:
                        yield packed(key, dense)
                    key, dense = this, np.zeros(r["size"], np.int64)
                at, n = unpack(r["slots"], r["counts"])
                dense[at] += n
            if key is not None:
                yield packed(key, dense)

        def packed(key: tuple, dense: np.ndarray) -> tuple:
            used = np.flatnonzero(dense)
            return *key, used.astype("<u4").tobytes(), pack(dense[used]), int(dense.sum())

        yield from _batches(groups(), fields)

    ddl = ", ".join(f"{k} {'int' if k == 'shard' else 'string'}" for k in keys)
    return _streamed(rows, keys, [], add, ddl + ", slots binary, counts binary, n long")


# ------------------------------------------------------------------ reports

def _groups(audit: Audit, counts: DataFrame) -> DataFrame:
    """(lang, source, place, tile, tiles, n, kept, shards) of every group."""
    found = audit.docs.select("lang", "source").distinct()
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang")  # a row a source
    rows = found.join(n, ["lang", "source"], "left").join(audit.langs, "lang", "left") \
        .withColumn("place", F.row_number().over(by_lang.orderBy("source")) - 1) \
        .withColumn("tiles", F.ceil(F.count("*").over(by_lang) / TILE).cast("int"))
    return stored(rows.select("lang", "source", "place", F.floor(F.col("place") / TILE).cast("int").alias("tile"), "tiles",
                              *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "kept", "shards")]), "audit-sources")


def pairs(audit: Audit, counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's
    sources."""
    cells = groups.join(audit.shards.select("lang", "shard", "size"), "lang") \
        .join(counts.select("lang", "source", "shard", "slots", "counts"), ["lang", "source", "shard"], "left")
    tiled = cells.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "lang", "shard", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
        "tile", "place", "n", "kept", "size", "slots", "counts")

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["place"])
        p = np.empty((len(rows), rows[0]["size"]), np.int64)
        for r, out in zip(rows, p):
            out[:] = share(np.zeros(1, np.int64), r["n"], r["kept"])
            if r["slots"] is not None:
                at, n = unpack(r["slots"], r["counts"])
                out[at] = share(n, r["n"], r["kept"])
        first, last = rows[0]["a"], rows[0]["b"]
        place = np.array([r["place"] for r in rows])
        left = [i for i, r in enumerate(rows) if r["tile"] == first]
        right = np.array([i for i, r in enumerate(rows) if r["tile"] == last])
        found = [(i, right[right > i]) for i in left]
        one = np.concatenate([np.full(len(js), place[i]) for i, js in found])
        two = np.concatenate([place[js] for _, js in found])
        value = np.concatenate([divergence(p[i], p[js]).sum(1) for i, js in found])
        return pa.table({"lang": pa.array([rows[0]["lang"]] * len(one), pa.string()), "one": pa.array(one, pa.int32()),
                         "two": pa.array(two, pa.int32()), "value": pa.array(value, pa.int64())})

    sums = tiled.groupBy("lang", "shard", "a", "b").applyInArrow(compare, "lang string, one int, two int, value long") \
        .groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", "two", "one", "value"))
    names = groups.select("lang", "place", "source")
    named = both.join(names.withColumnRenamed("place", "one"), ["lang", "one"]).join(
        names.select("lang", F.col("place").alias("two"), F.col("source").alias("item")), ["lang", "two"])
    bare = groups.where("kept = 0").select("lang", "source")
    blank = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item")
    return named.select("lang", "source", "item", "value").union(
        blank.select("lang", "source", "item", F.lit(0).cast("long")))


def top_terms(audit: Audit, counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value): the terms a source uses more than its
    language, ``top`` a source and shard; the best of all are among them."""
    totals = merged(counts.select("lang", "shard", "slots", "counts"), ["lang", "shard"], audit)
    n_lang = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    none = F.lit(None)
    kinds = [
        audit.shards.select("lang", "shard", F.lit(0).alias("kind"), none.cast("string").alias("source"), none.cast("long").alias("n"),
                            none.cast("long").alias("n_lang"), none.cast("binary").alias("slots"),
                            none.cast("binary").alias("counts"), "kept", "size", "terms"),
        totals.select("lang", "shard", F.lit(1), none.cast("string"), none.cast("long"), none.cast("long"), "slots", "counts",
                      none.cast("long"), none.cast("long"), none.cast("array<binary>")),
        counts.drop("n").join(groups.select("lang", "source", "n"), ["lang", "source"]).join(n_lang, "lang").select(
            "lang", "shard", F.lit(2), "source", "n", "n_lang", "slots", "counts", none.cast("long"), none.cast("long"),
            none.cast("array<binary>"))]
    rows = kinds[0].union(kinds[1]).union(kinds[2])
    fields = [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]

    def best(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for r in rows:
                if r["kind"] == 0:
                    words, kept, total = r["terms"], r["kept"], np.zeros(r["size"], np.int64)
                    continue
                at, n = unpack(r["slots"], r["counts"])
                if r["kind"] == 1:
                    total[at] = n
                    continue
                p, q = share(n, r["n"], kept), share(total[at], r["n_lang"], kept)
                more = np.flatnonzero(p > q)
                value = divergence(p[more], q[more])
                if len(more) > top:  # those that tie with the last place stay until their texts are compared
                    stay = value >= np.partition(value, -top)[-top]
                    more, value = more[stay], value[stay]
                ranked = sorted((-v, words[i]) for v, i in zip(value.tolist(), at[more].tolist()))
                for v, word in ranked[:top]:
                    yield r["lang"], r["source"], word.decode(), -v

        yield from _batches(found(), fields, 4096)

    return _streamed(rows, ["lang", "shard"], ["kind"], best, "lang string, source string, item string, value long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP, pass_terms: int = PASS_TERMS, shard_terms: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" compares a source
    with every other of its language, part "term" names the ``top`` terms it
    uses more than its language."""
    plan = prepare(_plain(docs, lang_col, source_col, text_col), min_docs, pass_terms, shard_terms)
    counts = count_slots(plan)
    groups = _groups(plan, counts)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = pairs(plan, counts, groups).withColumn("part", F.lit("pair")).withColumn("rank", rank)
    named = top_terms(plan, counts, groups, top).withColumn("part", F.lit("term")).withColumn("rank", rank) \
        .where(F.col("rank") <= top)
    return found.unionByName(named).select("lang", "source", "part", "item", "value", "rank")
