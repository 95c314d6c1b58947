"""Comparison of a registered query with its SQL on DuckDB."""

import math
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("MARLSTONE_TESTDATA", "/root/testdata/sf0.001"))


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def spark_rows(df) -> list:
    columns = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(sql: str) -> tuple[list, list]:
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(_plain(row[i]) for i in order) for row in result.fetchall()), key=repr)


def check(spark, query, sql: str | None) -> None:
    df = query(spark, str(DATA))
    mine = spark_rows(df)
    if sql is None:
        assert df.columns
        return
    names, theirs = sql_rows(sql)
    assert sorted(df.columns) == names
    assert mine == theirs
