"""Holds a Spark result against a DuckDB result as bags of rows."""

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder=DATA):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (str, bytes)):
        return value
    if type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return round(float(value), 6)


def bag(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)
