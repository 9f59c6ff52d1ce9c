"""Run queries() against oracle_sql() like the driver does (rows, columns, values).

usage: python tests/oracle_check.py [sf_dir] [key-substring ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0) and v.tzinfo is None:
        return v.date()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


_SPARK_CLASS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "float": "float",
                "double": "double", "string": "str", "date": "date", "boolean": "bool", "timestamp": "ts",
                "timestamp_ntz": "ts"}
_DUCK_CLASS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint", "HUGEINT": "hugeint",
               "FLOAT": "float", "DOUBLE": "double", "VARCHAR": "str", "DATE": "date", "BOOLEAN": "bool",
               "TIMESTAMP": "ts"}


def type_mismatches(sdf, con, sql):
    """Columns whose Spark and DuckDB types fall in different classes (int vs bigint, float vs double, ...)."""
    duck_types = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for name, t in sdf.dtypes:
        a = _SPARK_CLASS.get(t, t)
        d = duck_types.get(name, "?")
        b = _DUCK_CLASS.get(d, "decimal" if d.startswith("DECIMAL") else d)
        if a != b:
            out.append(f"{name}:{t}/{d}")
    return out


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_pd = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns)
    t1 = time.time()
    if sql is None:
        return f"{key:32s} rows-only  spark={len(s_pd)} ({t1 - t0:.1f}s)"
    d_pd = con.execute(sql).fetchdf()
    t2 = time.time()
    status = "OK"
    detail = ""
    if sorted(s_pd.columns) != sorted(d_pd.columns):
        status, detail = "COLS", f"{sorted(s_pd.columns)} vs {sorted(d_pd.columns)}"
    elif len(s_pd) != len(d_pd):
        status, detail = "COUNT", f"{len(s_pd)} vs {len(d_pd)}"
    else:
        a, b = rows_of(s_pd), rows_of(d_pd)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            status, detail = "VALUES", f"{len(bad)} differ, e.g. {str(bad[0][0])[:300]} vs {str(bad[0][1])[:300]}"
    try:
        tm = type_mismatches(sdf, con, sql)
    except Exception as e:  # DESCRIBE of a complex statement
        tm = [f"?{type(e).__name__}"]
    types = f" TYPES {','.join(tm)}" if tm else ""
    return f"{key:32s} {status:6s} rows={len(s_pd)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s {detail}{types}"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    import __spark_entry__ as E
    from tessera.session import get_session
    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if pats and not any(p in key for p in pats):
            continue
        try:
            line = compare(spark, con, key, fn, sqls.get(key), sf_dir)
        except Exception as e:  # report and go on
            line = f"{key:32s} ERROR  {type(e).__name__}: {str(e)[:300]}"
        if " OK " not in line and "rows-only" not in line:
            bad += 1
        print(line, flush=True)
    print(f"done, {bad} not OK")


if __name__ == "__main__":
    main()
