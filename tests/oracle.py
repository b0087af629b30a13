"""Run a query's SQL in DuckDB and compare rows with Spark's."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


def sql_rows(sql, sf=SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return rows_of(con.sql(sql).df())
