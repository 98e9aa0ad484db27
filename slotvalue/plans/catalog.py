"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
computed from the driver tables with the library's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.operators import bands, clean, compare, corpus, exemplars, fuzzy, keys, report, searchindex, slots
from slotvalue.plans.params import (AS_OF, FIRST_ROUND, FLOAT_DIGITS, FOCUS_SLOT, LOTTERY, MATURITY_YEARS,
                                    PLACEHOLDER, REPORT_SLOTS, LISTING_PAGE, LISTING_DEEP, LISTING_SIZE, CATEGORY,
                                    COMPARE_FIRST, DISPLAY_SLOTS, PAGE_ORDERS)
from slotvalue.session import scratch_path
from slotvalue.sources import coltypes, docindex, files, pages, tables

Query = Callable[[SparkSession, str], DataFrame]


def r6(name: str) -> Column:
    return F.round(F.col(name), FLOAT_DIGITS).alias(name)


def q_slot_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = slots.slot_value(tables.entrants(spark, sf_dir), max_slot=FIRST_ROUND, focus_slot=FOCUS_SLOT)
    return df.select("slot", r6("total"), r6("avg"), r6("med"), "label_avg", "label_med", "highlight")


def q_class_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.class_rank(tables.entrants(spark, sf_dir))


def q_slot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = slots.class_rank(tables.entrants(spark, sf_dir))
    df = slots.slot_rank(ranked, max_slot=FIRST_ROUND, focus_slot=FOCUS_SLOT)
    return df.select("slot", r6("avg_rank"), r6("med_rank"), "label_avg", "label_med", "highlight")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.band_assign(tables.entrants(spark, sf_dir), as_of=AS_OF, max_slot=LOTTERY,
                             years=MATURITY_YEARS)


def q_band_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _assigned(spark, sf_dir)
    return df.select("class_year", "slot", "id", "name", "exposure", "value", "rate",
                     r6("mean_rate"), r6("sd_rate"), "band", "band_ord")


def q_band_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bands.band_share(_assigned(spark, sf_dir))
    return df.select("slot", "band", "band_ord", "count", r6("prop"), "label")


def q_band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bands.band_stack(bands.band_share(_assigned(spark, sf_dir)))
    return df.select("slot", "band", "band_ord", r6("prop"), "label", r6("ymin"), r6("ymax"), r6("ymid"))


def q_band_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bands.band_zero_fill(_assigned(spark, sf_dir))
    return df.select("slot", "band", "band_ord", "count", r6("prop"), "band_label")


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exemplars.exemplars(tables.entrants(spark, sf_dir), as_of=AS_OF, max_slot=LOTTERY,
                               years=MATURITY_YEARS)


def q_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _exemplars(spark, sf_dir)
    return df.select("class_year", "slot", "id", "name", "exposure", "value", "rate", "rn", "n",
                     "middle_dist", "category", "category_ord")


def q_name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return keys.name_clean(docs, "text").select("doc_id", "name_clean", "first_name", "last_name", "base_id")


def q_entity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = keys.entity_key(tables.entrants(spark, sf_dir).select("class_year", "slot", "id", "name"))
    return df.select("class_year", "slot", "id", "name", "base_id", "player_id")


def q_clean_entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_entrants(tables.raw_entrants(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, sf_dir, "pages")


def q_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_scan(_pages(spark, sf_dir))


def q_page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_cells(_pages(spark, sf_dir))


def q_page_first_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_first_table(_pages(spark, sf_dir))


def q_header_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.header_promote(_pages(spark, sf_dir))


def q_class_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.class_union(_pages(spark, sf_dir))


def q_page_entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed entrants with keys from the pages' first lists.  The lists have
    one column and no header, so its cells are names, and their row and length
    stand in for the other columns."""
    cells = pages.page_tables(_pages(spark, sf_dir), first_only=True)
    wide = pages.to_wide(cells.withColumn("class_year", pages.class_from_url(F.col("url"))), ["0"],
                         ["page_id", "class_year", "row_idx"], "col_idx")
    raw = wide.select("page_id", "class_year", F.col("row_idx").alias("row_pos"),
                      F.col("row_idx").cast("string").alias("Pk"), F.col("0").alias("Player"),
                      F.length("0").cast("string").alias("Yrs"), F.lit("").alias("WS"), F.lit("x").alias("VORP"))
    typed = clean.clean_entrants(raw, keep=["page_id"])
    return keys.entity_key(typed, order=("class_year", "page_id", "row_pos")).select(
        "class_year", "slot", "name", "exposure", "value", "value2", "page_id", "row_pos", "base_id", "player_id")


def q_load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entrants with keys in one call from stored pages: the orders rendered as
    HTML tables, several pages a class."""
    html = tables.rendered_pages(tables.raw_entrants(spark, sf_dir), clean.PAGE_COLUMNS, PAGE_ORDERS)
    return clean.load_pages(html).select(
        "class_year", "slot", "name", "exposure", "value", "value2", "base_id", "player_id")


def _lottery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as HTML tables, with a column of ``TRUE``, ``FALSE`` and ``NA``."""
    slot = F.col("Pk").try_cast("bigint")
    raw = tables.raw_entrants(spark, sf_dir).withColumn(
        "Lot", F.when(slot.isNull(), "NA").when(slot <= LOTTERY, "TRUE").otherwise("FALSE"))
    return tables.rendered_pages(raw, clean.PAGE_COLUMNS + ["Lot"], PAGE_ORDERS)


def q_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each column of each rendered page's table."""
    return coltypes.column_types(_lottery_pages(spark, sf_dir), first_only=True)


def q_typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered pages' tables, stacked, in the types all pages agree on."""
    return coltypes.typed_table(_lottery_pages(spark, sf_dir), clean.PAGE_COLUMNS + ["Lot"])


def _report(spark: SparkSession, sf_dir: str, chosen: list[int] | None) -> DataFrame:
    ex = _exemplars(spark, sf_dir).withColumn("player_id", F.col("id").cast("string"))
    images = files.image_paths(tables.read_table(spark, sf_dir, "labels"), "doc_id")
    return report.slot_report(ex, images, slots=chosen, placeholder=PLACEHOLDER)


def q_slot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, REPORT_SLOTS)


def q_slot_report_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the chosen slots, in report order (its place is a column)
    and under display names."""
    rep = report.slot_report_placed(_report(spark, sf_dir, DISPLAY_SLOTS))
    return report.display_labels(rep.select("slot", "place", "category", "path", "name", "class_year", "exposure",
                                            "value", "rate"))


def q_slot_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as one table per slot by one job, and read back."""
    path = scratch_path(spark, "slot-reports")
    report.write_slot_reports(q_slot_report(spark, sf_dir), path)
    return spark.read.parquet(path).select("category", "category_ord", "path", "name", "class_year", "exposure", "value",
                                           "rate", F.col("slot").cast("bigint").alias("slot"))


def q_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as a JSON search index, and loaded from it."""
    path = scratch_path(spark, "doc-index")
    docindex.write_doc_index(corpus.doc_index(tables.read_table(spark, sf_dir, "documents")), path)
    loaded = docindex.read_doc_index(spark, path, lines=True)
    return loaded.select("entry_id", "href", "title", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_index_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as files of one JSON array each, and loaded from
    them by several tasks a file."""
    path = scratch_path(spark, "doc-arrays")
    docindex.write_doc_arrays(corpus.doc_index(tables.read_table(spark, sf_dir, "documents")), path)
    loaded = docindex.read_doc_arrays(spark, path)
    return loaded.select("entry_id", "href", "title", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _slot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.slot_value(tables.entrants(spark, sf_dir), max_slot=FIRST_ROUND, focus_slot=FOCUS_SLOT)


def q_cmp_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.lowest_mean(_slot_summary(spark, sf_dir), first=COMPARE_FIRST).select("slot", r6("avg"))


def q_cmp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compare.nearest_mean(_slot_summary(spark, sf_dir), focus=FOCUS_SLOT)
    return df.select("slot", r6("avg"), r6("focus_avg"), r6("diff"))


def q_cmp_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compare.ratio_to_focus(_slot_summary(spark, sf_dir), focus=FOCUS_SLOT)
    return df.select("slot", r6("med"), r6("focus_med"), r6("ratio"))


def q_cmp_worst_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only the first five slots are compared: summarise just those (ranks are
    # still computed over every slot of each class)
    ranks = slots.slot_rank(slots.class_rank(tables.entrants(spark, sf_dir)), max_slot=COMPARE_FIRST)
    df = compare.worst_rank(ranks, first=COMPARE_FIRST)
    return df.select("slot", r6("avg_rank"), r6("med_rank"), "avg_pos", "med_pos")


def q_cmp_bust_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compare.bust_rank(bands.band_share(_assigned(spark, sf_dir)))
    return df.select("slot", r6("bust_share"), "bust_pos")


def _doc_index(spark: SparkSession, sf_dir: str) -> searchindex.SearchIndex:
    """The documents' index: the first query of a session writes it."""
    return searchindex.kept_index(spark, f"documents {sf_dir}", lambda: searchindex.build_search_index(
        corpus.doc_index(tables.read_table(spark, sf_dir, "documents"))))


def _page_index(spark: SparkSession, sf_dir: str) -> searchindex.SearchIndex:
    return searchindex.kept_index(spark, f"pages {sf_dir}", lambda: searchindex.build_search_index(
        corpus.page_index(_pages(spark, sf_dir))))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("bigint").alias("query_id"), F.col("text").alias("query"))


def _doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searchindex.search(_doc_index(spark, sf_dir), _passages(spark, sf_dir))


def q_doc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_hits(spark, sf_dir).select("query_id", "query", "entry_id", "href", "score", "rank")


def q_doc_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents, up to one edit for ten characters."""
    return fuzzy.fuzzy_search(corpus.doc_index(tables.read_table(spark, sf_dir, "documents")), _passages(spark, sf_dir))


def q_doc_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _doc_index(spark, sf_dir).entries.select("entry_id", "text")
    # written, so that the few hits are known to be few and the texts stay where they are
    hits = searchindex.written(_doc_hits(spark, sf_dir).select("query_id", "query", "entry_id"), scratch_path(spark, "hits"))
    return hits.join(texts, "entry_id").select(
        "query_id", "entry_id", corpus.snippet(F.col("text"), F.col("query")).alias("snippet"))


def q_doc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles searched in the pages and their paragraphs, by page."""
    index = _page_index(spark, sf_dir)
    hits = corpus.collapse(searchindex.search(index, corpus.title_queries(index.entries)))
    return hits.select("query_id", "base_href", "group_rank", "item_pos", "href", "entry_id.page_id", "entry_id.pos",
                       "score", "group_size", "more")


def q_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_stats(tables.read_table(spark, sf_dir, "documents"))


def _listing(spark: SparkSession, sf_dir: str, page: int) -> DataFrame:
    rows = tables.read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("order_date"))
    found = corpus.listing_page(rows, page=page, size=LISTING_SIZE, order=[("order_date", "desc"), "o_orderkey"])
    return found.withColumn("order_date", F.col("order_date").cast("string"))


def q_doc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the orders, newest first."""
    return _listing(spark, sf_dir, LISTING_PAGE)


def q_doc_listing_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far from the first."""
    return _listing(spark, sf_dir, LISTING_DEEP)


def q_doc_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return corpus.in_category(docs, CATEGORY, F.concat_ws(",", "lang", "source"))


QUERIES: dict[str, Query] = {
    "slot_value": q_slot_value,
    "class_rank": q_class_rank,
    "slot_rank": q_slot_rank,
    "band_assign": q_band_assign,
    "band_share": q_band_share,
    "band_stack": q_band_stack,
    "band_zero_fill": q_band_zero_fill,
    "exemplars": q_exemplars,
    "name_clean": q_name_clean,
    "entity_key": q_entity_key,
    "clean_entrants": q_clean_entrants,
    "page_scan": q_page_scan,
    "page_cells": q_page_cells,
    "page_first_table": q_page_first_table,
    "header_promote": q_header_promote,
    "class_union": q_class_union,
    "page_entrants": q_page_entrants,
    "load_pages": q_load_pages,
    "page_types": q_page_types,
    "typed_table": q_typed_table,
    "slot_report": q_slot_report,
    "slot_report_display": q_slot_report_display,
    "slot_report_files": q_slot_report_files,
    "index_files": q_index_files,
    "index_arrays": q_index_arrays,
    "cmp_lowest": q_cmp_lowest,
    "cmp_nearest": q_cmp_nearest,
    "cmp_ratio": q_cmp_ratio,
    "cmp_worst_rank": q_cmp_worst_rank,
    "cmp_bust_rank": q_cmp_bust_rank,
    "doc_search": q_doc_search,
    "doc_fuzzy": q_doc_fuzzy,
    "doc_snippet": q_doc_snippet,
    "doc_collapse": q_doc_collapse,
    "doc_stats": q_doc_stats,
    "doc_listing": q_doc_listing,
    "doc_listing_deep": q_doc_listing_deep,
    "doc_category": q_doc_category,
}
