"""Sharding by extendible hashing, with DataFrame functions only.

A row's hash is the first 60 bits of the MD5 of its id as text.  The directory
is indexed by hash-prefix bits: a bucket is a prefix, and only a bucket whose
bytes exceed ``limit`` splits on its next bit, until every bucket fits or holds
a single hash.  A shard is named by its prefix bits ("" when nothing splits).

One aggregate gives the bytes of every cell of the finest prefix that an even
spread would need (and four bits more); the bytes of all shorter prefixes
follow from the cells, and the bucket of a cell is its shortest prefix that
fits.  Cells that still do not fit are counted again with ten bits more.  The
directory is written to the shared folder and read back, so Spark knows its
size: it is broadcast only below the session's threshold and shuffled beyond.

Rows of one id that together exceed the limit split on the hash of the whole
row, named "<bits>/<bits>"; equal rows are numbered and laid out in pages that
fit, named "<bits>/<bits>/<page>".  Only a single row larger than the limit
stays in an oversized shard, alone.

Defined cases: size is the text's UTF-8 bytes, null counting 0; a null id
hashes as ''; an empty table gives an empty result; ties in the hash stay
together until they exceed the limit; all columns are kept, and a clashing
"shard" column of the input stays while the new one gets an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.common import free_name, stored

HASH_BITS = 60
LIMIT = 32 << 20
SPARE_BITS = 4
MORE_BITS = 10


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: int) -> Column:
    return F.shiftright(F.col(h), HASH_BITS - depth) if depth else F.lit(0).cast("long")


def _resolve(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """(root, cell, depth): the shortest prefix of each cell that fits or holds
    one hash; depth is null where none does."""
    by_depth = cells.select("root", "cell", "b", "low", "high",
                            F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")) \
        .withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    node = ["root", "depth", "prefix"]
    fits = by_depth.groupBy(*node).agg(F.sum("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high")) \
        .where((F.col("b") <= limit) | (F.col("low") == F.col("high"))).select(*node, F.lit(True).alias("fits"))
    return by_depth.select("cell", *node).join(fits, node, "left").groupBy("root", "cell").agg(
        F.min(F.when(F.col("fits"), F.col("depth"))).alias("depth"))


def _directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, (root, cell, depth))]: rounds of finer and finer cells for rows
    (root, h, bytes); each round covers the cells its predecessor left open."""
    most = rows.groupBy("root").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(most, 1) / limit))) + SPARE_BITS)
    rounds = []
    while True:
        cells = stored(rows.groupBy("root", _prefix("h", bits).alias("cell")).agg(
            F.sum("bytes").alias("b"), F.min("h").alias("low"), F.max("h").alias("high")), "shard-cells")
        found = stored(_resolve(cells, bits, limit), "shard-directory")
        rounds.append((bits, found))
        left = found.where("depth is null").select("root", "cell")
        if left.isEmpty():
            return rounds
        rows = rows.withColumn("cell", _prefix("h", bits)).join(left, ["root", "cell"], "left_semi").drop("cell")
        bits = min(HASH_BITS, bits + MORE_BITS)


def _assign(df: DataFrame, root: str, h: str, rounds: list[tuple[int, DataFrame]], out: str) -> DataFrame:
    """``df`` with the prefix bits of its bucket as string ``out``."""
    cols, depth = df.columns, F.lit(None).cast("int")
    for k, (bits, found) in enumerate(rounds):
        names = [free_name(df.columns, f"{c}{k}") for c in ("root", "cell", "depth")]
        side = found.where("depth is not null").toDF(*names)
        df = df.join(side, (F.col(root) == side[names[0]]) & (_prefix(h, bits) == side[names[1]]), "left")
        depth = F.coalesce(depth, F.col(names[2]))
    df = df.withColumn(out, depth)
    bits = F.substring(F.lpad(F.conv(F.col(h).cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), F.col(out))
    return df.select(*cols, bits.alias(out))


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the name of each row's shard as ``shard``."""
    cols = docs.columns
    taken = list(cols)

    def name(x: str) -> str:
        taken.append(free_name(taken, x))
        return taken[-1]

    out, root, h, size, sub = map(name, ("shard", "root", "h", "bytes", "sub"))
    text = F.col(text_col).cast("string")
    rows = docs.withColumns({root: F.lit(0).cast("long"), h: hash60(F.col(id_col).cast("string")),
                             size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})

    def narrow(df: DataFrame, r: str, k: str) -> DataFrame:
        return df.select(F.col(r).alias("root"), F.col(k).alias("h"), F.col(size).alias("bytes"))

    rounds = _directory(narrow(rows, root, h), limit)
    placed = _assign(rows, root, h, rounds, out)
    full = _full(narrow(rows, root, h), limit)
    if full.isEmpty():
        return placed.select(*cols, out)

    def member(side: DataFrame, key: list[str], how: str, df: DataFrame) -> DataFrame:
        other = side.toDF(*[free_name(df.columns, f"k{i}") for i in range(len(key))])
        on = [df[a] == other[b] for a, b in zip(key, other.columns)]
        return df.join(other, on, how)

    crowd = member(full.select("h"), [h], "left_semi", placed).withColumn(
        sub, hash60(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})))
    rest = member(full.select("h"), [h], "left_anti", placed)
    within = _directory(narrow(crowd, h, sub), limit)
    bits = name("bits")
    crowd = _assign(crowd, h, sub, within, bits).withColumn(out, F.concat_ws("/", out, bits))
    equal = _full(narrow(crowd, h, sub), limit)
    single = member(equal, [h, sub], "left_anti", crowd)
    copies, page = name("copies"), name("page")
    per = F.greatest(F.lit(1).cast("long"), F.expr(f"{limit} div greatest(`{size}`, 1)"))
    many = member(equal, [h, sub], "left_semi", crowd).groupBy(*cols, out, size).agg(F.count("*").alias(copies))
    pages = many.withColumn(page, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(copies) / per) - 1)))
    # a page is at most one shard, so its rows are laid out by a task of its own
    pages = pages.repartition(*cols, page).withColumn(copies, F.explode(F.sequence(
        F.lit(1).cast("long"), F.least(per, F.col(copies) - F.col(page) * per))))
    paged = pages.withColumn(out, F.concat_ws("/", out, F.col(page)))
    return rest.select(*cols, out).union(single.select(*cols, out)).union(paged.select(*cols, out))


def _full(rows: DataFrame, limit: int) -> DataFrame:
    """(root, h) of several rows with one hash that exceed the limit."""
    over = rows.groupBy("root", "h").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    return stored(over.where((F.col("b") > limit) & (F.col("n") > 1)).select("root", "h"), "shard-full")


def write_shards(sharded: DataFrame, path: str, column: str = "shard") -> None:
    """One folder per shard.  A shard is at most the byte limit (or one row),
    so no task receives more than a few of them."""
    sharded.repartition(column).write.partitionBy(column).parquet(path)
