"""Document operators: search entries from documents and pages, grouping of
hits by document, snippets around the first match, listing pages, category
filter and word counts.  ``searchindex`` searches the entries."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotvalue.operators.ordinal import Order, rows_between

# Functions that run on executors are pickled with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: items of a group that are shown.
COLLAPSE_AFTER = 3

# ---------------------------------------------------------------- indexes

def doc_index(documents: DataFrame) -> DataFrame:
    """Search entries from a documents table: text only."""
    return documents.select(
        F.col("doc_id").cast("bigint").alias("entry_id"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("href"),
        F.lit("").alias("title"), F.lit("").alias("section"), F.col("text"))


_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)
_H1 = re.compile(r"<h1[^>]*>(.*?)</h1>", re.I | re.S)
_ARTICLE = re.compile(r"<article[^>]*>(.*?)</article>", re.I | re.S)
_BODY = re.compile(r"<body[^>]*>(.*?)(?:</body>|$)", re.I | re.S)
_PARA = re.compile(r"<p\b[^>]*>(.*?)</p>", re.I | re.S)
_UNSEEN = re.compile(r"<(script|style)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"[ \t-\r\xa0]+")


def _plain(markup: str) -> str:
    """Text of a piece of markup: tags removed, all character references
    decoded, white space collapsed."""
    return _SPACE.sub(" ", html.unescape(_TAG.sub("", markup))).strip(" ")


def _first(pattern: re.Pattern, page: str) -> str:
    found = pattern.search(page)
    return _plain(found[1]) if found else ""


def page_entries(page: str) -> tuple[str, str, list[str]]:
    """(title, first heading, texts): the first text is the whole page's, all
    its articles or, without any, its body less scripts and styles; then one
    per paragraph."""
    articles = [m[1] for m in _ARTICLE.finditer(page)]
    if not articles:
        body = _BODY.search(page)
        articles = [_UNSEEN.sub(" ", body[1] if body else "")]
    whole = _SPACE.sub(" ", " ".join(map(_plain, articles))).strip(" ")
    return _first(_TITLE, page), _first(_H1, page), [whole, *(_plain(m[1]) for m in _PARA.finditer(page))]


def page_index(pages: DataFrame) -> DataFrame:
    """Search entries from stored pages: one entry for the page (href
    without fragment; title, first heading, text) and one per paragraph (href
    ``#p<n>``, same title and heading, paragraph text).  ``entry_id`` is the
    pair (page_id, pos), pos 0 being the page.  Every page is read once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, base, page in zip(pdf["page_id"], pdf["base"], pdf["html"]):
                title, section, texts = page_entries(page or "")
                rows += [(page_id, pos, base if not pos or base is None else f"{base}#p{pos - 1}", title, section, text)
                         for pos, text in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href", "title", "section", "text"])

    src = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.substring_index("url", "#", 1).alias("base"), "html")
    rows = src.mapInPandas(run, "page_id long, pos long, href string, title string, section string, text string")
    return rows.select(F.struct("page_id", "pos").alias("entry_id"), "href", "title", "section", "text")


def title_queries(index: DataFrame) -> DataFrame:
    """Distinct page titles of a page index as queries (query id = lowest page
    id)."""
    titles = index.where("entry_id.pos = 0").select("entry_id.page_id", F.col("title").alias("query"))
    return titles.groupBy("query").agg(F.min("page_id").cast("bigint").alias("query_id"))


# ------------------------------------------------------------------- hits

def collapse(hits: DataFrame, *, after: int = COLLAPSE_AFTER) -> DataFrame:
    """Group the hits of each query by base document (href before ``#``):
    the document's own entry first, then the others in rank order; groups
    in order of their best hit.  The first ``after`` items of a group are
    kept, ``more`` counts the rest.

    The group position is a ``row_number() <= after`` limit (applied
    partially before the shuffle); group sizes are a separate aggregate
    joined on (query, document), with at most ``after`` rows per key on the
    other side.
    """
    h = hits.withColumn("base_href", F.substring_index("href", "#", 1)) \
        .withColumn("is_doc", F.instr("href", "#") == 0)
    gkeys = ["query_id", "base_href"]
    w = Window.partitionBy(*gkeys).orderBy(F.col("is_doc").desc(), F.col("rank"))
    top = h.withColumn("item_pos", F.row_number().over(w).cast("bigint")).where(F.col("item_pos") <= after)
    sizes = h.groupBy(*gkeys).agg(F.count(F.lit(1)).cast("bigint").alias("group_size"),
                                  F.min("rank").alias("group_rank"))
    out = top.join(sizes, gkeys)
    return out.select("query_id", "base_href", "group_rank", "item_pos", "href", "entry_id", "score",
                      "group_size",
                      F.greatest(F.col("group_size") - after, F.lit(0)).cast("bigint").alias("more"))


def snippet(text: Column, query: Column, *, before: int = 50, width: int = 200) -> Column:
    """Text around the first case-insensitive match of ``query``.

    Match at 0-based index ``before`` or more: start just after the last
    space, comma or colon at or before the match (0 if none); else start at
    0.  End at the first such break at or after ``start + width``, adding
    ``…``; if the text ends before ``start + width`` or has no later break,
    take it to the end.  No match: the whole text.
    """
    s = F.instr(F.lower(text), F.lower(query)) - 1
    head = text.substr(F.lit(1), s + 1)
    lead = F.regexp_extract(head, r"(?s)^(.*)[ ,:]", 1)
    has_break = head.rlike("[ ,:]")
    start = F.when(s < before, F.lit(0)).when(has_break, F.length(lead) + 1).otherwise(F.lit(0))
    e0 = start + width
    tail = text.substr(e0 + 1, F.length(text))
    run = F.regexp_extract(tail, r"^([^ ,:]*)", 1)
    found = (e0 <= F.length(text)) & (F.length(run) < F.length(tail))
    end = e0 + F.length(run)
    cut = F.concat(text.substr(start + 1, end - start), F.lit("…"))
    rest = text.substr(start + 1, F.length(text))
    return F.when(s < 0, text).when(found, cut).otherwise(rest)


# ---------------------------------------------------------------- listing

def word_stats(documents: DataFrame, *, words_per_minute: int = 200) -> DataFrame:
    """Word count (runs of non-space characters), reading minutes
    (``ceil(words / words_per_minute)``) and character count of each text."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    return documents.select(
        "doc_id", words.cast("bigint").alias("words"),
        F.ceil(words / words_per_minute).cast("bigint").alias("reading_minutes"),
        F.length("text").cast("bigint").alias("chars"))


def listing_page(df: DataFrame, *, page: int, size: int, order: list[Order]) -> DataFrame:
    """Rows ``(page-1)*size + 1 .. page*size`` of ``df`` in ``order``, with
    their position.  Any page costs the same: only the rows around it are
    sorted (``ordinal.rows_between``)."""
    return rows_between(df, order, (page - 1) * size + 1, page * size, rn="position")


def in_category(df: DataFrame, category: str, categories: Column) -> DataFrame:
    """Rows whose comma-separated ``categories`` include ``category``; an
    empty category keeps every row; NULL categories never match."""
    if category == "":
        return df
    return df.where(F.coalesce(F.array_contains(F.split(categories, ","), category), F.lit(False)))
