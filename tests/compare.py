"""Rows of a Spark query beside the rows of its SQL in DuckDB."""

import decimal
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float | decimal.Decimal):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())


def sql_rows(sql, sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(row[k]) for k in order) for row in result.fetchall())
