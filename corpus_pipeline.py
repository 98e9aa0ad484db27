"""The corpus pipeline: documents in, a mixed and sharded training corpus out.

Every stage calls one of the corpus operators and works on all rows that the
stage before it kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.llm import decontam, langid, mixing, sharding, simhash
from slotvalue.llm.common import remainder, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language classifier rejects: no letters, or
    ambiguous.  It learns from the labelled rows whose crc32 remainder is not 2;
    without any, only documents without letters are dropped."""
    model = langid.fit(docs, remainder("doc_id", 4) != 2)
    if model is None:
        marked = langid.lettered(docs)
        return marked.where(F.col(marked.columns[-1])).select(*docs.columns)
    marked = langid.identify(docs, model)
    lang, _, ambiguous = marked.columns[len(docs.columns):]
    kept = marked.where((F.col(lang) != langid.NONE) & ~F.col(ambiguous))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth is benchmark text."""
    marked = decontam.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col(marked.columns[-1])).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select documents to the target weights; a document comes once for every
    epoch in which it is selected."""
    return mixing.mix_documents(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Name the shard of every row."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: SQL cannot express the language model and the SimHash components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; every stage's rows are written
    as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
