"""Column types of page tables against the rules written out cell by cell."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotvalue.sources import coltypes

CELLS = ["", " ", "NA", "T", "F", "TRUE", "false", "True", "1", "+7", "-0", "007", "2147483647", "2147483648",
         "-2147483648", "99999999999999999999", "1.5", ".5", "5.", "1e3", "1e400", "Inf", "-Inf", "INFINITY", "NaN", "nan",
         "0x1A", "1d", "1,000", "5%", "x", "١", "1 2", "T F", "Pk", "Ł", "-"]


def expected(cells):
    """The first type that takes all cells that are not missing."""
    here = [c.strip() for c in cells if c is not None and c.strip() not in ("", "NA")]
    number = r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?"
    if all(c in ("T", "F", "TRUE", "FALSE", "true", "false") for c in here):
        return "logical"
    if all(re.fullmatch(r"[-+]?[0-9]+", c) and abs(int(c)) < 2 ** 31 for c in here):
        return "integer"
    if all(re.fullmatch(number, c) or re.fullmatch(r"[-+]?Inf|NaN", c) or c.lower().lstrip("+-") == "infinity" for c in here):
        return "double"
    return "text"


def types_of(spark, columns):
    rows = [(i, c) for i, cells in enumerate(columns) for c in cells]
    df = spark.createDataFrame(rows, "k int, c string")
    got = df.groupBy("k").agg(coltypes.type_of(F.bit_or(coltypes.cell_kind(F.col("c")))).alias("t")).collect()
    return {r["k"]: r["t"] for r in got}


def test_single_cells_and_pairs(spark):
    columns = [[a, b] for a in CELLS + [None] for b in CELLS + [None]]
    got = types_of(spark, columns)
    wrong = [(c, got[i], expected(c)) for i, c in enumerate(columns) if got[i] != expected(c)]
    assert not wrong, wrong


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.one_of(st.none(), st.sampled_from(CELLS), st.text("0123456789.eE+-TFNA \t", max_size=6)),
                         min_size=1, max_size=5), min_size=20, max_size=60))
def test_any_columns(spark, columns):
    got = types_of(spark, columns)
    assert got == {i: expected(c) for i, c in enumerate(columns)}


def test_white_space_around_words_and_numbers(spark):
    columns = [["F\t"], ["\tNA\n"], ["\t7 "], ["\n1.5\r"], ["x\t"]]
    assert types_of(spark, columns) == {0: "logical", 1: "logical", 2: "integer", 3: "double", 4: "text"}
    cells = spark.createDataFrame([("F\t", "\t7", "1.5\n", "\tNA")], "a string, b string, c string, d string")
    kinds = {"a": "logical", "b": "integer", "c": "double", "d": "text"}
    assert tuple(cells.select(*[coltypes.typed(F.col(c), k) for c, k in kinds.items()]).head()) == (False, 7, 1.5, None)


def test_inferred_types_walk_the_pages_once(stored):
    plan = coltypes.typed_table(stored, ["Pk", "WS"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan and "Scan parquet" in plan


def page(rows, head=("Pk", "Player", "WS")):
    def line(tag, cells):
        return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"


@pytest.fixture()
def stored(spark):
    return spark.createDataFrame([
        (1, "https://h/2000", page([("1", "A", "2"), ("NA", "B", ""), ("3", "NA", "7")])),
        (2, "https://h/2001", page([("2", "C", "1.5"), ("4", "", "Inf")])),
        (3, "https://h/2002", page([])),
        (4, "https://h/2003", None),
        (5, "https://h/2004", page([("9", "D", "4")]) + page([("x",)], ("Pk",))),
        (None, "https://h/2005", page([("text", "E", "text")])),
    ], "page_id long, url string, html string")


def test_types_by_page(stored):
    got = {(r["page_id"], r["table_idx"], r["col_name"]): (r["n_cells"], r["n_missing"], r["type"])
           for r in coltypes.column_types(stored).collect()}
    assert got == {
        (1, 0, "Pk"): (3, 1, "integer"), (1, 0, "Player"): (3, 1, "text"), (1, 0, "WS"): (3, 1, "integer"),
        (2, 0, "Pk"): (2, 0, "integer"), (2, 0, "Player"): (2, 1, "text"), (2, 0, "WS"): (2, 0, "double"),
        (5, 0, "Pk"): (1, 0, "integer"), (5, 0, "Player"): (1, 0, "text"), (5, 0, "WS"): (1, 0, "integer"),
        (5, 1, "Pk"): (1, 0, "text"),
    }


def test_stacked_pages_agree_on_a_type(stored):
    df = coltypes.typed_table(stored, ["Pk", "Player", "WS", "Absent"])
    assert [f.dataType.simpleString() for f in df.schema] == [
        "bigint", "bigint", "bigint", "bigint", "string", "double", "boolean"]
    got = [tuple(r) for r in df.orderBy("page_id", "row_pos").collect()]
    assert got == [(1, 2000, 1, 1, "A", 2.0, None), (1, 2000, 2, None, "B", None, None), (1, 2000, 3, 3, None, 7.0, None),
                   (2, 2001, 1, 2, "C", 1.5, None), (2, 2001, 2, 4, "", math.inf, None), (5, 2004, 1, 9, "D", 4.0, None)]


def test_given_types_read_the_pages_once(stored):
    df = coltypes.typed_table(stored, ["WS"], types={"WS": "integer"})
    assert [r["WS"] for r in df.orderBy("page_id", "row_pos").collect()] == [2, None, 7, None, None, 4]
    with pytest.raises(ValueError):
        coltypes.typed_table(stored, ["WS"], types={"WS": "number"})


def test_empty_pages_and_names_with_dots(spark, stored):
    none = coltypes.typed_table(stored.where("false"), ["Pk"])
    assert none.count() == 0 and none.schema["Pk"].dataType.simpleString() == "boolean"
    twice = spark.createDataFrame([(1, "u/1", page([("1", "T")], ("MP", "MP")))], "page_id long, url string, html string")
    assert tuple(coltypes.typed_table(twice, ["MP", "MP.1"]).head())[3:] == (1, True)


def test_kinds_are_combined_in_the_map_tasks(stored):
    plan = coltypes.column_types(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_bit_or") == 1 and plan.count("Exchange") == 1
