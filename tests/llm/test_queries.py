"""Registered queries: against SQL where there is some, else their contracts'
columns and counts (the brute-force versions are beside the operators)."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from oracle_compare import compare, duck
from slotvalue.llm.oracle import SQL
from slotvalue.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_decontam": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6_langid": ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
    "op7_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


def test_all_operators_and_the_pipeline_are_registered():
    numbers = {int(k[2:].split("_")[0]) for k in QUERIES}
    assert numbers == set(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, key):
    _, problems = compare(spark, duck(SF), key, QUERIES[key], SQL[key], SF)
    assert not problems, problems


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_columns_and_rows(spark, key):
    df = QUERIES[key](spark, SF)
    assert df.columns == COLUMNS[key]
    rows = df.select("doc_id").collect()
    assert len(rows) == len(set(rows)) == 1000


def test_op9_ranks(spark):
    df = QUERIES["op9_ann"](spark, SF)
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and df.count() == 50


def test_stage_names():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5
