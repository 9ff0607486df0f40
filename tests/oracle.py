"""Runs registered queries beside their SQL, as the driver does."""

import math

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in rows], key=repr)


def differences(spark: SparkSession, sf_dir: str, run, sql: str) -> str:
    """Empty if both give the same rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    expected = _rows(columns, answer.fetchall())
    df = run(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(expected):
        return f"{len(got)} and {len(expected)} rows"
    return next((f"{g} and {e}" for g, e in zip(got, expected, strict=True) if g != e), "")
