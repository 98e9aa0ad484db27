"""SimHash near-duplicate detection by multi-index hashing.

Texts are lower-cased (A-Z only) and cut into words at ASCII white space.
Every shingle of ``shingle`` consecutive words (repeats included, words joined
by one space; the whole sequence if there are fewer) is hashed with XXH64,
seed 42.  A fingerprint bit is 1 if it is set in more than half of the hashes.
Fingerprints link when they differ in at most three bits.

Search: a fingerprint has two 32-bit segments.  If two fingerprints differ in
three bits or fewer, they differ in at most one bit in one of the segments.  So
each fingerprint is stored in one table row per segment, and each enumerates
the Hamming ball of radius one around its segments, fetches the rows with those
segments and verifies the whole distance.  A pair whose segments differ in one
bit is fetched once: the side with the 0 sets it.

Only distinct fingerprints are searched, so exact copies never pair up.
Segments that more than ``dense`` distinct fingerprints share are linked
without pairs (see ``_dense_links``): the work per fingerprint stays bounded.

Defined cases: null, empty and white-space texts have fingerprint zero and
link like any other; repeated rows and repeated ids each get their row; a null
id does not name a component, and a component of null ids only has a null
component_id; an empty table gives an empty result.  Extra columns are
ignored by ``fingerprints`` and ``simhash_groups`` and kept by
``drop_near_copies``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotvalue.llm.common import LOWER, column_bytes, components, free_name, map_columns, stored

SHINGLE = 3
MAX_BITS = 3
DENSE = 1024
HALF = 32
_PART = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text as an unsigned 64-bit number."""
    words = (text or b"").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n - shingle + 1]
    ends = ends[shingle - 1:]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, _PART):  # bounded memory for very long texts
        spans = zip(starts[at:at + _PART].tolist(), ends[at:at + _PART].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def _marked(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``df`` with fp, the fingerprint's 64 bits as a long, for its text."""
    def fps(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in column_bytes(texts)], np.uint64).view(np.int64))]

    return map_columns(df, [F.col(text_col).cast("string")], fps, [("fp", "long")])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, fp), one row per row."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _marked(src, "text", shingle).select("id", "fp")


def _segments() -> F.Column:
    """One struct (seg, key) for each segment of column ``fp``."""
    mask = F.lit((1 << HALF) - 1).cast("long")
    return F.array(F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(mask).alias("key")),
                   F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", HALF).alias("key")))


def _dense_links(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Links inside crowded segments, without pairs.

    ``rows`` hold exactly the segment, ``probes`` one bit more or less.  Around
    every value z of the other segment let S1 be the rows within one bit of z,
    S2 the rows two bits from z and Q1 the probes within one bit.  All of S1 lie
    within 2 bits of each other, S1 and S2 within 3, S1 and Q1 within 1 + 2, so
    they all link to the smallest of S1.  Every link of the segment is among
    these or follows from them: rows at distance 3 or less have a z at distance
    1 or less from one and 2 or less from the other, a row and a probe that
    differ in 2 or fewer other bits have a z within one bit of both.
    """
    flips = [1 << i for i in range(HALF)]
    near = [0, *flips]
    far = [a | b for a, b in combinations(flips, 2)]
    other = F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", HALF)).otherwise(
        F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1).cast("long")))

    def around(df: DataFrame, masks: list[int], kind: int) -> DataFrame:
        mask = F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
        return df.select("seg", "key", "fp", other.alias("rest"), mask).select(
            "seg", "key", F.col("rest").bitwiseXOR(F.col("mask")).alias("z"), "fp", F.lit(kind).alias("kind"))

    at = around(rows, near, 1).union(around(rows, far, 2)).union(around(probes, near, 3))
    keys = ["seg", "key", "z"]
    centre = at.where("kind = 1").groupBy(*keys).agg(F.min("fp").alias("b"))
    return at.join(centre, keys).select(F.col("fp").alias("a"), "b")


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at
    most three bits; enough of them to give the right components."""
    rows = fps.select("fp", F.explode(_segments()).alias("s")).select("fp", "s.seg", "s.key")
    crowded = stored(rows.groupBy("seg", "key").count().where(F.col("count") > dense).select("seg", "key"),
                     "simhash-crowded")
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(HALF)])
    unset = F.filter(bits, lambda m: F.col("key").bitwiseAND(m) == 0)
    probes = rows.select("fp", "seg", F.explode(F.concat(F.array(F.lit(0).cast("long")), unset)).alias("mask"), "key") \
        .select("fp", "seg", "mask", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    open_rows = rows.join(crowded, ["seg", "key"], "left_anti")
    met = probes.select(F.col("fp").alias("a"), "seg", "mask", "key").join(
        open_rows.select(F.col("fp").alias("b"), "seg", "key"), ["seg", "key"])
    found = met.where((F.col("mask") != 0) | (F.col("a") < F.col("b"))) \
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    if crowded.isEmpty():
        return found
    return found.union(_dense_links(rows.join(crowded, ["seg", "key"], "left_semi"),
                                    probes.where("mask <> 0").join(crowded, ["seg", "key"], "left_semi")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """(id, fp, component_id): one row per document; component_id is the
    smallest id that links reach from it, itself included."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    joined = components(links(distinct.select("fp"), dense), "simhash-components")
    roots = distinct.join(joined, distinct.fp == joined.node, "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(roots.join(least, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, all
    columns kept.  Of several rows with that id the one with the smallest text
    hash stays, of repeated rows one; a group without ids keeps one row."""
    row_id, row_hash = free_name(docs.columns, "row_id"), free_name(docs.columns, "row_hash")
    keyed = docs.withColumns({row_id: F.col(id_col).cast("long"),
                              row_hash: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    narrow = keyed.select(F.col(row_id).alias("id"), F.col(row_hash).alias("hash"), F.col(text_col).alias("text"))
    marked = stored(_marked(narrow, "text", shingle).select("id", "hash", "fp"), "simhash-fp")
    distinct = stored(marked.select("fp").distinct(), "simhash-distinct")
    joined = components(links(distinct, dense), "simhash-components")
    roots = marked.join(joined, marked.fp == joined.node, "left").select(
        "id", "hash", F.coalesce("root", "fp").alias("root"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("m")
    keep = stored(roots.groupBy("root").agg(best).select(F.col("m.id").alias("id"), F.col("m.hash").alias("hash"))
                  .distinct(), "simhash-keep")
    # rows are counted without their texts; only the rows of a repeated key are numbered
    counted = marked.groupBy("id", "hash").agg(F.count("*").alias("n"))
    same = F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.hash") == F.col("k.hash"))
    kept = counted.alias("r").join(keep.withColumn("kept", F.lit(True)).alias("k"), same, "left")
    fate = stored(kept.where("kept is null or n > 1").select("r.id", "r.hash", F.col("kept").isNotNull().alias("kept")),
                  "simhash-fate")
    # always dealt by key, whatever the size: the keys to drop grow with the rows.  Both joins use one exchange
    known = fate.select(F.col("id").alias("f_id"), F.col("hash").alias("f_hash"), "kept").hint("shuffle_hash")
    at = keyed[row_id].eqNullSafe(known.f_id) & (keyed[row_hash] == known.f_hash)
    out = keyed.join(known, at, "left_anti").select(*docs.columns)
    if fate.where("kept").isEmpty():
        return out
    first = Window.partitionBy(row_id, row_hash).orderBy(F.lit(1))
    rank = free_name([*docs.columns, row_id, row_hash], "row_rank")
    again = keyed.join(known.where("kept"), at, "left_semi")
    once = again.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= 1)
    return out.union(once.select(*docs.columns))
