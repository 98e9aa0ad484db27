"""Listing files as a table (the image dimension of the report)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.functions.text import file_stem


def file_listing(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Files directly in ``directory`` matching ``glob``: path, file name and
    key (file name without its last extension).

    Uses the ``binaryFile`` source with only ``path`` selected, so file
    contents are never read (the scan's ReadSchema is the path alone); the
    listing itself is distributed by Spark's file index.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
             .select("path"))
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    return files.select("path", name.alias("file_name"), file_stem(F.col("path")).alias("player_id"))


def image_paths(keys: DataFrame, key: str, prefix: str = "images/", ext: str = ".jpg") -> DataFrame:
    """A path dimension built from a key column: ``prefix + key + ext``,
    with the key read back from the path as a file listing would give it."""
    path = F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(ext))
    return keys.select(path.alias("path")).select("path", file_stem(F.col("path")).alias("player_id"))
