"""Rows of a query against the rows of its SQL, in any order."""

import decimal
import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def database(folder=DATA):
    found = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        found.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return found


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(float(value))
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.map(plain).values.tolist()))


def assert_same(spark_frame, sql_frame):
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    assert rows(spark_frame) == rows(sql_frame)
