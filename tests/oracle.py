"""Run registered queries against DuckDB on the same tables: python tests/oracle.py [pattern] [sf_dir]."""

from __future__ import annotations

import os
import re
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer, float, np.floating)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(text(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(spark_df, con, sql):
    mine = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}", len(mine)
    a, b = canonical(mine), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(a)
    for x, y in zip(a, b):
        if x != y:
            diff = sum(p != q for p, q in zip(a, b))
            return f"{diff} rows differ, e.g. {sorted(mine.columns)}\n     spark {x}\n     sql   {y}", len(a)
    return None, len(a)


def main():
    from wearpath.session import local_session
    import __spark_entry__ as entry

    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    folder = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.001"
    spark = local_session()
    for pair in filter(None, os.environ.get("SPARK_SETTINGS", "").split(",")):
        spark.conf.set(*pair.split("="))
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in sql:
                problem, rows = compare(df, con, sql[name])
            else:
                problem, rows = None, len(df.toPandas())
        except Exception as error:  # report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:900]}", 0
        mark = "FAIL" if problem else ("ok  " if name in sql else "rows")
        bad += bool(problem)
        print(f"{mark} {time.time() - start:6.2f}s {rows:7d} {name} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
