"""Run catalog queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's check: row count, column names, order-insensitive values
(floats rounded).
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(v):
    if v is None:
        return None
    if v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return normal(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def rows_of(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = [tuple(normal(v) for v in rec) for rec in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=repr)


def compare(name, spark_df, duck_df):
    sc, sr = rows_of(spark_df)
    dc, dr = rows_of(duck_df)
    if sc != dc:
        return f"columns differ: {sc} vs {dc}"
    st = {c: str(spark_df[c].dtype) for c in sc}
    # integers with nulls come as floats from one side
    dt_ = {c: "float64" if str(duck_df[c].dtype) == "Int64" and st[c] == "float64" else str(duck_df[c].dtype) for c in dc}
    if st != dt_ and len(spark_df):
        diff = {c: (st[c], dt_[c]) for c in sc if st[c] != dt_[c]}
        return f"dtypes differ: {diff}"
    if len(sr) != len(dr):
        return f"rows differ: {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}"
    return None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from custval.session import get_spark

    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    failures = 0
    for name in names or list(qs):
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            spark_pd = sdf.toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:300]}")
            failures += 1
            continue
        ts = time.time() - t
        if name not in oracle:
            print(f"rows-only {name}: {len(spark_pd)} rows ({ts:.1f}s)")
            continue
        try:
            duck_pd = con.execute(oracle[name]).df()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:300]}")
            failures += 1
            continue
        err = compare(name, spark_pd, duck_pd)
        print(f"{'FAIL' if err else 'ok  '} {name}: {len(spark_pd)} rows ({ts:.1f}s) {err or ''}")
        failures += bool(err)
    print("failures:", failures)


if __name__ == "__main__":
    main()
