"""Spark results against DuckDB's, as the driver compares them."""

import os

import duckdb
import pandas as pd


def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def cell(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return [cell(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr([cell(v) for v in r]) for r in frame.itertuples(index=False, name=None))
