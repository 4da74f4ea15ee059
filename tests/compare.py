"""Results of Spark and DuckDB as sorted rows of plain values."""

import os

import duckdb
import pandas as pd


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return x.item() if hasattr(x, "item") else x


def rows(pdf):
    columns = sorted(pdf.columns)
    out = []
    # whole numbers beside nulls are doubles in one library and integers in the other
    numbers = [c for c in columns if pdf[c].isna().any() and pd.api.types.is_numeric_dtype(pdf[c])]
    pdf = pdf.astype(dict.fromkeys(numbers, float))
    for r in pdf[columns].astype(object).itertuples(index=False):
        out.append(repr(tuple(float(v) if isinstance(v := plain(x), float) else v for x in r)))
    return columns, sorted(out)


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c
