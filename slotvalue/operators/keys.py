"""Entity keys from names: clean the name, build a short base key from the
last and first words, and make it unique by occurrence number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.text import base_key, latin_ascii, letters_only, word
from slotvalue.operators.ordinal import number_within


def name_clean(df: DataFrame, name: str = "name") -> DataFrame:
    """Add name_clean (Latin-ASCII, letters and spaces only), first_name
    (first word), last_name (last word) and base_id."""
    clean = letters_only(latin_ascii(F.col(name)))
    return (df.withColumn("name_clean", clean)
            .withColumn("first_name", word(F.col("name_clean"), 1))
            .withColumn("last_name", word(F.col("name_clean"), -1))
            .withColumn("base_id", base_key(F.col("first_name"), F.col("last_name"))))


def entity_key(df: DataFrame, *, name: str = "name",
               order: Sequence[str] = ("class_year", "id")) -> DataFrame:
    """Add base_id and player_id: the base key when it is unique over the
    whole table, else the base key followed by its occurrence number in
    ``order`` (class, then table order).

    Names collapse onto few base keys (every ``Customer#...`` name gives the
    same key), so one key can hold most rows: occurrence numbers and key
    counts come from the skew-safe numbering operator, not from a window
    partitioned by the key.
    """
    # only the base key travels through the numbering; the other name parts
    # are cheap expressions and are derived again afterwards
    keyed = name_clean(df, name).drop("name_clean", "first_name", "last_name")
    numbered = number_within(keyed, ["base_id"], list(order), rn="_occ", n="_n_key")
    player = F.when(F.col("_n_key") == 1, F.col("base_id")).otherwise(
        F.concat(F.col("base_id"), F.col("_occ").cast("string")))
    return name_clean(numbered.withColumn("player_id", player).drop("_occ", "_n_key"), name)
