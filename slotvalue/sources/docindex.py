"""Loading a JSON document index (an array of flat objects with objectID,
href, title, section and text) as search entries."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INDEX_SCHEMA = "objectID string, href string, title string, section string, text string"


def read_doc_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Search entries from JSON index files: ``entry_id`` is the objectID.

    A file that is one array is read whole by one task (``read_doc_arrays``
    shares it out); ``lines`` reads files with one object per line, which Spark
    splits.  The schema is fixed (no
    inference pass)."""
    raw = spark.read.option("multiLine", not lines).schema(INDEX_SCHEMA).json(path)
    return raw.select(F.col("objectID").alias("entry_id"), "href",
                      *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "section", "text")])


def read_doc_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Search entries from files that are one JSON array each, of any size.

    A file is cut at every ``"objectID":``, which a JSON text can hold only as
    the name of a member (inside a string its quotes are escaped), so tasks
    share a file.  ``objectID`` must be the first member of each object, and
    objects must be flat."""
    pieces = spark.read.option("lineSep", '"objectID":').text(path)
    last = r"\}\s*(,\s*\{\s*|\]\s*)?\z"
    whole = F.concat(F.lit('{"objectID":'), F.regexp_replace("value", last, "}"))
    raw = pieces.where(F.col("value").rlike(last)).select(F.from_json(whole, INDEX_SCHEMA).alias("e")).select("e.*")
    return raw.select(F.col("objectID").alias("entry_id"), "href",
                      *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "section", "text")])


def write_doc_arrays(entries: DataFrame, path: str) -> None:
    """Write search entries as JSON files that are one array each, an object a
    line, a file for every task that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, mark = None, "["
        for line in (x for b in batches for x in b.column(0).to_pylist()):
            if before is not None:
                yield pa.RecordBatch.from_arrays([pa.array([mark + before + ","])], names=["value"])
                mark = " "
            before = line
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([mark + before + "]"])], names=["value"])

    objects = entries.select(F.to_json(F.struct(F.col("entry_id").cast("string").alias("objectID"), "href", "title", "section",
                                                "text")).alias("value"))
    objects.mapInArrow(run, "value string").write.text(path)


def write_doc_index(entries: DataFrame, path: str) -> None:
    """Write search entries as JSON index files, one object per line."""
    entries.select(F.col("entry_id").cast("string").alias("objectID"), "href", "title", "section", "text") \
        .write.json(path)
