"""Run registered queries in Spark and their oracle SQL in DuckDB on the same
parquet tables and compare row count, column names and sorted values.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from slotvalue.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE",
                 "StringType": "VARCHAR", "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP"}


def compare(spark, con, key, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    got = sdf.toPandas()
    rel = con.sql(sql)
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    exp = rel.df()
    problems = []
    bad_types = [(f.name, type(f.dataType).__name__, duck_types.get(f.name)) for f in sdf.schema.fields
                 if SPARK_TO_DUCK.get(type(f.dataType).__name__) != duck_types.get(f.name)]
    if bad_types:
        problems.append(f"types differ: {bad_types}")
    if sorted(got.columns) != sorted(exp.columns):
        problems.append(f"columns spark={sorted(got.columns)} oracle={sorted(exp.columns)}")
    if len(got) != len(exp):
        problems.append(f"rows spark={len(got)} oracle={len(exp)}")
    if not problems:
        a, b = rows_of(got), rows_of(exp)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problems.append(f"{len(bad)} value rows differ; first: spark={bad[0][0]} oracle={bad[0][1]}")
    return len(got), problems


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from slotvalue.session import local_session
    spark = local_session(8, 8, scratch=tempfile.mkdtemp(prefix="oracle-", dir="/tmp"))
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    for k in keys or list(qs):
        if k not in sqls:
            n = qs[k](spark, sf_dir).count()
            print(f"{k:20s} rows={n} (no oracle)")
            continue
        try:
            n, problems = compare(spark, con, k, qs[k], sqls[k], sf_dir)
        except Exception as e:  # noqa: BLE001
            n, problems = -1, [f"error: {type(e).__name__}: {str(e)[:400]}"]
        failed += bool(problems)
        print(f"{k:20s} rows={n} {'OK' if not problems else 'FAIL ' + '; '.join(problems)}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv))
