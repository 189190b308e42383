"""Compares a query with its DuckDB SQL on the driver's tables."""

import glob
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_value(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    return bytes(x) if isinstance(x, bytearray) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    want = con.sql(sql)
    want_names, want_rows = rows_of(want.columns, want.fetchall())
    df = query(spark, sf_dir)
    got_names, got_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got_names == want_names
    extra, missing = got_rows - want_rows, want_rows - got_rows
    assert not extra and not missing, f"{sum(extra.values())} extra, {sum(missing.values())} missing: {list(extra)[:2]} / {list(missing)[:2]}"
    return sum(want_rows.values())
