"""Reading the driver tables and deriving the entrants fact table from them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  Only the columns a plan uses are read: Catalyst prunes
    the parquet ReadSchema and pushes filters into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def entrants_from_orders(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Entrants: one row per order.

    class_year = order year, slot = customer nation + 1, id = order key,
    name = customer name, exposure = number of line items, value =
    total price / 1000, and 0 for orders without line items (the
    never-played case).

    Plan: line items are counted per order with a partial (map-side)
    aggregate, so only one row per order leaves each map task; the count
    is then hash-partitioned on the order key, which the left join with
    orders reuses.  Customers join on the customer key; AQE turns that into a
    broadcast join only when the customer side is small at runtime, and
    splits a skewed customer key otherwise.
    """
    items = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = customer.select("c_custkey", "c_name", "c_nationkey")
    joined = (o.join(c, o.o_custkey == c.c_custkey, "inner")
              .join(items, o.o_orderkey == items.l_orderkey, "left"))
    return joined.select(
        F.year("o_orderdate").cast("bigint").alias("class_year"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("slot"),
        F.col("o_orderkey").cast("bigint").alias("id"),
        F.col("c_name").alias("name"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("double").alias("exposure"),
        F.when(F.col("n_items").isNull(), F.lit(0.0))
         .otherwise(F.col("o_totalprice") / 1000).cast("double").alias("value"),
    )


def entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entrants_from_orders(read_table(spark, sf_dir, "orders"),
                                read_table(spark, sf_dir, "customer"),
                                read_table(spark, sf_dir, "lineitem"))


def raw_entrant_text(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The entrants as a scraped page table would hold them: every field is
    text, exposure and value are ``""`` when an order has no line items, and
    orders in status ``P`` stand in for repeated header rows (slot text
    ``Pk``).  Input for ``clean_entrants`` that grows with the tables."""
    items = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    c = customer.select("c_custkey", "c_name", "c_nationkey")
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
         .join(items, o.o_orderkey == items.l_orderkey, "left"))
    none = F.col("n_items").isNull()
    return j.select(
        F.year("o_orderdate").cast("bigint").alias("class_year"),
        F.col("o_orderkey").cast("bigint").alias("row_pos"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Pk"))
         .otherwise((F.col("c_nationkey") + 1).cast("string")).alias("Pk"),
        F.col("c_name").alias("Player"),
        F.when(none, F.lit("")).otherwise(F.col("n_items").cast("string")).alias("Yrs"),
        F.when(none, F.lit("")).otherwise((F.col("o_totalprice") / 1000).cast("string")).alias("WS"),
        F.col("o_totalprice").cast("string").alias("VORP"),
    )


def raw_entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_entrant_text(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"),
                            read_table(spark, sf_dir, "lineitem"))



def rendered_pages(raw: DataFrame, columns: Sequence[str], per_page: int) -> DataFrame:
    """Raw text rows (class_year, row_pos and ``columns``) as stored pages, one
    HTML table each: a page holds the rows of one class whose ``row_pos`` lies in
    one stretch of ``per_page``, so no page grows with the table.  Its number is
    made of the stretch and the class; its url ends in the class."""
    def escaped(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    rows = raw.select((F.floor(F.col("row_pos") / per_page) * 10_000 + F.col("class_year")).alias("page_id"), "class_year",
                      F.struct("row_pos", row.alias("html")).alias("row"))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    pages = rows.groupBy("page_id", "class_year").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return pages.select(
        "page_id", F.concat(F.lit("https://example.org/class/"), F.col("class_year").cast("string")).alias("url"),
        F.concat(F.lit(f"<html><body><p>one <b>page</b></p>{head}"), F.array_join("rows.html", ""),
                 F.lit("</table><ul><li>after</li></ul></body></html>")).alias("html"))
