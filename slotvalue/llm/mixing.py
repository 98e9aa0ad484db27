"""Mixing sources to target weights by hierarchical budgeting.

The leaves of the tree are (domain, language, source).  A token budget flows
down from the root: every node shares its budget among its children in
proportion to their weights, but a child takes at most its capacity, its tokens
times ``epochs``.  What a child cannot take goes to its siblings, again by
weight; only when a whole subtree is exhausted does the rest go to the siblings
of an ancestor, because a node never gets more than its subtree can hold.
Amounts are whole tokens, rounded down.

A leaf's rows are ordered anew in every epoch by a seeded hash of the id.  The
leaf's selection is the longest prefix of epoch 0, epoch 1, ... whose tokens do
not exceed its budget.  Rows whose ids are equal, or null, follow each other by a
hash of the whole row, and equal rows are taken one by one, so an id with many
rows is cut inside like any other part of its leaf.

The prefix needs no sort of a leaf: tokens per (leaf, top 8 hash bits) and a
running sum over those bins find the bin where the budget ends; its rows are
cut by the next 8 bits, and so on, before the last few are summed one by one.
So a leaf with a third of all rows is counted by partial aggregates like any
other.

Defined cases: null text has no tokens; a null tree value is the node
"(none)"; a null id hashes as ''; weights that are not given are 1, and nodes of
weight 0 get no tokens; rows without tokens cost nothing and follow the order;
an empty table gives an empty result.  All columns are kept; a clashing column
of the input stays and the new column gets an underscore in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotvalue.llm.common import free_name, stored
from slotvalue.llm.sharding import HASH_BITS, hash60

#: Share of the corpus' tokens to select, in percent, and the most epochs.
PERCENT = 60
EPOCHS = 3
SEED = 17
BIN_BITS = 8
LEVELS = 3
PAGE = 1000            # equal rows laid out together
NONE = "(none)"
SEP = "\u001f"
#: Domain of each source; others are in the domain "other".
DOMAINS = {"web": [f"src{i}" for i in range(0, 8)], "books": [f"src{i}" for i in range(8, 14)],
           "forums": [f"src{i}" for i in range(14, 18)]}
#: Weights by path; all others are 1.
WEIGHTS = {("web",): 5, ("books",): 3, ("forums",): 2, ("other",): 1,
           ("web", "en"): 4, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 2,
           ("books", "en"): 2, ("web", "en", "src0"): 3}
_BIG = "decimal(38,0)"


def domain_of(source: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    out = F.lit("other")
    for name, sources in domains.items():
        out = F.when(source.isin(sources), F.lit(name)).otherwise(out)
    return out


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(path: list[str], weights: dict[tuple, int]) -> Column:
    given = [x for k, v in weights.items() if len(k) == len(path)
             for x in (F.lit(SEP.join(k)), F.lit(v).cast("long"))]
    one = F.lit(1).cast("long")
    return F.coalesce(F.element_at(F.create_map(*given), F.concat_ws(SEP, *path)), one) if given else one


def leaf_budgets(leaves: DataFrame, path: Sequence[str], budget: int, weights: dict[tuple, int]) -> DataFrame:
    """(path..., budget) for ``leaves`` (path..., cap): water-filling at every
    level, from the root down."""
    path = list(path)
    parents = None
    for level in range(1, len(path) + 1):
        keys, above = path[:level], path[:level - 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(keys, weights))
        nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
        nodes = nodes.join(parents, above) if parents is not None else nodes.withColumn("b", F.lit(budget))
        nodes = nodes.select(*keys, *[F.col(c).cast(_BIG).alias(c) for c in ("cap", "w", "b")])
        # children that fill up first come first: those before are full when a child is looked at
        ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(0.0))
        group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        before = group.orderBy(ratio, keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        nil = F.lit(0).cast(_BIG)
        nodes = nodes.select("*", F.coalesce(F.sum("cap").over(before), nil).cast(_BIG).alias("cap_before"),
                             (F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), nil)).cast(_BIG).alias("w_left"))
        nodes = nodes.withColumn("full", F.expr("cap * w_left <= (b - cap_before) * w"))
        nodes = nodes.select(
            "*", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), nil).cast(_BIG).alias("used"),
            F.sum(F.when(~F.col("full"), F.col("w"))).over(group).cast(_BIG).alias("w_open"))
        parents = nodes.select(*keys, F.expr("case when full then cast(cap as bigint) "
                                             "else ((b - used) * w) div w_open end").alias("b"))
    return parents.withColumnRenamed("b", "budget")


def mix(docs: DataFrame, levels: dict[str, Column], tokens: Column, percent: int = PERCENT, epochs: int = EPOCHS,
        weights: dict[tuple, int] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The selected rows of ``docs``, once per epoch in which they are selected,
    with epoch (from 0), order_key (their place in it), n_tokens and the tree
    values."""
    cols, taken = docs.columns, list(docs.columns)

    def name(x: str) -> str:
        taken.append(free_name(taken, x))
        return taken[-1]

    path = [name(x) for x in levels]
    n_tokens, epoch, key = name("n_tokens"), name("epoch"), name("order_key")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.withColumns({p: F.coalesce(e.cast("string"), F.lit(NONE)) for p, e in zip(path, levels.values())}
                            | {n_tokens: tokens})
    # ids and counts only: the texts are read once for all that follows
    slim = stored(rows.select(ident.alias("id"), F.col(n_tokens).alias("tokens"),
                              *[F.col(p).alias(f"p{i}") for i, p in enumerate(path)]), "mix-rows")
    slim_path = [f"p{i}" for i in range(len(path))]
    leaves = stored(slim.groupBy(*slim_path).agg(F.sum("tokens").alias("tokens")), "mix-leaves") \
        .withColumn("cap", F.col("tokens") * epochs)
    total, room = leaves.agg(F.sum("tokens"), F.sum("cap")).first()
    budget = min((total or 0) * percent // 100, room or 0)
    renamed = {tuple(k): v for k, v in weights.items()}
    plan = leaves.join(leaf_budgets(leaves, slim_path, budget, renamed), slim_path).select(
        *slim_path, F.expr("case when tokens > 0 then budget div tokens else 0 end").cast("int").alias("full"),
        F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("rest"))
    plan = stored(plan, "mix-plan")
    place = hash60(F.concat_ws(":", F.lit(seed).cast("string"), F.col("full").cast("string"), F.col("id")))
    keyed = slim.join(plan.select(*slim_path, "full"), slim_path).select(*slim_path, "tokens", place.alias("key"))
    edge = _ends(keyed, plan.select(*slim_path, "rest"), slim_path)
    stop, full, sub, sub_stop, copies = map(name, ("stop", "full", "sub", "sub_stop", "copies"))
    met = keyed.join(edge, slim_path).where("key = prefix").groupBy(*slim_path).agg(
        F.count("*").alias("n"), F.first("rest").alias("rest"))
    crowd = stored(met.where("n > 1").select(*slim_path, "rest"), "mix-crowds")
    cut = stored(plan.select(*slim_path, "full").join(edge.select(*slim_path, F.col("prefix").alias("stop")), slim_path, "left"),
                 "mix-cuts").select(*[F.col(a).alias(b) for a, b in zip(slim_path, path)], F.col("full").alias(full),
                                    F.col("stop").alias(stop))
    chosen = rows.join(cut, path)

    def at(n: Column) -> Column:
        return hash60(F.concat_ws(":", F.lit(seed).cast("string"), n.cast("string"), ident))

    def written(df: DataFrame) -> DataFrame:
        return df.select(*cols, *path, n_tokens, epoch, at(F.col(epoch)).alias(key))

    # no row stops the last epoch where all its tokens fit
    key_last = at(F.col(full))
    in_last = F.col(stop).isNull() | (key_last < F.col(stop))
    several = not crowd.isEmpty()
    if several:  # the budget ends among rows of one id
        chosen = chosen.withColumn(sub, _row_hash(docs))
        inside = chosen.where(key_last == F.col(stop)).select(
            *[F.col(b).alias(a) for a, b in zip(slim_path, path)], F.col(n_tokens).alias("tokens"), F.col(sub).alias("key"))
        ends = _ends(inside.join(crowd.select(*slim_path), slim_path), crowd, slim_path)
        equal = inside.join(ends, slim_path).where("key = prefix").groupBy(*slim_path).agg(
            F.first("prefix").alias("prefix"), F.expr("first(rest) div max(tokens)").alias("copies"))
        equal = stored(equal, "mix-equal").select(*[F.col(a).alias(b) for a, b in zip(slim_path, path)],
                                                  F.col("prefix").alias(sub_stop), F.col("copies").alias(copies))
        chosen = chosen.join(equal, path, "left")
        in_last = in_last | F.coalesce((key_last == F.col(stop)) & (F.col(sub) < F.col(sub_stop)), F.lit(False))
    times = F.col(full) + F.when((F.col(full) < epochs) & in_last, 1).otherwise(0)
    taken_rows = written(chosen.withColumn(epoch, F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)))))
    if not several:
        return taken_rows
    # equal rows: one stands for all, and is laid out as often as the budget has room, a page at a time
    same = chosen.where((F.col(full) < epochs) & (key_last == F.col(stop)) & (F.col(sub) == F.col(sub_stop)) & (F.col(copies) > 0))
    pages = same.dropDuplicates(path).withColumn(sub_stop, F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {PAGE})")))
    pages = pages.repartition(*path, sub_stop).withColumn(sub, F.explode(F.sequence(
        F.lit(1).cast("long"), F.least(F.lit(PAGE).cast("long"), F.col(copies) - F.col(sub_stop) * PAGE))))
    return taken_rows.union(written(pages.withColumn(epoch, F.col(full))))


def _row_hash(docs: DataFrame) -> Column:
    """60 bits of a hash of all columns that can be hashed."""
    given = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()
             and "variant" not in f.dataType.simpleString()]
    return F.shiftrightunsigned(F.xxhash64(*given), 64 - HASH_BITS)


def _ends(keyed: DataFrame, rest: DataFrame, leaf: list[str]) -> DataFrame:
    """(leaf..., prefix, rest): the key at which the tokens of a leaf's rows,
    in order of ``key``, exceed its ``rest``, and what is left of that before it.

    It is found BIN_BITS of the hash at a time: each step looks only at the rows
    of the bin that its predecessor found, and orders at most 2**BIN_BITS sums."""
    up = Window.partitionBy(*leaf)
    edge = rest.select(*leaf, F.lit(0).cast("long").alias("prefix"), "rest")
    for level in range(LEVELS + 1):
        inside = keyed.join(edge, leaf).where(F.shiftright("key", HASH_BITS - BIN_BITS * level) == F.col("prefix"))
        last = level == LEVELS
        at_bin = F.col("key") if last else F.shiftright("key", HASH_BITS - BIN_BITS * (level + 1))
        sums = inside.groupBy(*leaf, at_bin.alias("bin")).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
        over = sums.withColumn("upto", F.sum("t").over(up.orderBy("bin"))).where("upto > rest")
        first = F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("t")).alias("rest")))
        edge = stored(over.groupBy(*leaf).agg(first.alias("e")).select(
            *leaf, F.col("e.bin").alias("prefix"), F.col("e.rest").alias("rest")), "mix-edges")
    return edge


def mix_documents(docs: DataFrame) -> DataFrame:
    """``mix`` with the production tree over lang and source."""
    source = F.col("source").cast("string")
    return mix(docs, {"domain": domain_of(source), "language": F.col("lang"), "origin": source},
               word_tokens(F.col("text").cast("string")))
