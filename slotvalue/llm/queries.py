"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.llm import (ann, decontam, divergence, langid, mixing, quality, sharding, simhash, substring, tokenio,
                           urlfilter, veccode, warc)
from slotvalue.llm.common import remainder, table
from slotvalue.llm.oracle import SQL  # noqa: F401
from slotvalue.session import scratch_path


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return sharding.shard(docs).select("doc_id", size.alias("n_bytes"), "shard")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_documents(docs).drop("text", "lang", "source")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenio.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenio.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = urlfilter.literal_table(spark, urlfilter.HOST_RULES, {"host": "string", "path": "string", "action": "string"})
    spam = urlfilter.literal_table(spark, [(p, "block") for p in urlfilter.SPAM_PATTERNS],
                                   {"pattern": "string", "action": "string"})
    rules = urlfilter.host_rules(hosts, level=1).union(urlfilter.pattern_rules(spam, level=0))
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select(F.col("id").alias("page_id"), "host", "path",
                         F.when(F.col("level") == 1, F.col("rule")).alias("rule"), "verdict")


def op13_veccodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = veccode.compress(table(spark, sf_dir, "embeddings"))
    if coded is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_decontam": op5_decontam,
    "op6_langid": op6_langid,
    "op7_substring": op7_substring,
    "op8_mixing": op8_mixing,
    "op9_ann": op9_ann,
    "op10_tokens": op10_tokens,
    "op11_divergence": op11_divergence,
    "op12_urls": op12_urls,
    "op13_veccodes": op13_veccodes,
}
