"""Schema, null and number policies, each a layer of its own."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.errors import NotEnoughDataError, ValidationError, require
from driftspan.operators.pairs import numeric_columns


def finite(column: str) -> Column:
    x = F.col(column).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def missing_values(reference: DataFrame, current: DataFrame, policy: str = "error", min_samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """Both sides as doubles with missing (null, NaN, infinite) values handled: error, ignore (drop rows) or impute.

    impute takes the mean of the reference's finite values, 0 if there are none. One aggregation a side counts.
    """
    require(policy in ("error", "ignore", "impute"), "policy must be error, ignore or impute")
    require(reference.columns == current.columns, "feature counts or names differ")
    columns = reference.columns
    ok = lambda: [finite(c) for c in columns]
    whole = ok()[0]
    for x in ok()[1:]:
        whole = whole & x
    means = reference.agg(*(F.coalesce(F.avg(F.when(finite(c), F.col(c).cast("double"))), F.lit(0.0)).alias(c) for c in columns)).first()
    out = []
    for df in (reference, current):
        counts = df.agg(F.count("*").alias("n"), F.sum(whole.cast("long")).alias("good")).first()
        good = counts["good"] or 0
        if policy == "error":
            require(good == counts["n"], f"{counts['n'] - good} rows have missing values")
        if (counts["n"] if policy == "impute" else good) < min_samples:
            raise NotEnoughDataError(f"fewer than {min_samples} rows are left")
        numbers = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
        if policy == "impute":
            numbers = numbers.select(*(F.when(finite(c), F.col(c)).otherwise(means[c]).alias(c) for c in columns))
        elif policy == "ignore":
            numbers = numbers.where(whole)
        out.append(numbers)
    return out[0], out[1]


def matching_columns(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both have the same set of columns; names what is missing and what is extra."""
    missing, extra = sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))
    require(not missing and not extra, f"columns differ: missing {missing}, extra {extra}")


def schema_diff(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, status): missing, extra, retyped or same."""
    a, b = (dict(df.dtypes) for df in (reference, current))
    rows = [(c, "extra" if c not in a else "missing" if c not in b else "same" if a[c] == b[c] else "retyped") for c in sorted(a | b)]
    return reference.sparkSession.createDataFrame(rows, "column string, status string")


def align(reference: DataFrame, current: DataFrame, policy: str = "strict") -> tuple[DataFrame, DataFrame]:
    """strict: same columns, the current in the reference's order. align_intersection: what both have. ignore: extra ones dropped."""
    require(policy in ("strict", "align_intersection", "ignore"), "unknown schema policy")
    if policy == "strict":
        matching_columns(reference, current)
    shared = [c for c in reference.columns if c in current.columns]
    if policy == "ignore":
        require(shared == reference.columns, f"missing columns: {sorted(set(reference.columns) - set(shared))}")
    require(bool(shared), "no columns in common")
    return reference.select(*shared), current.select(*shared)


def coerce_numeric(df: DataFrame, columns: Sequence[str], policy: str = "strict") -> DataFrame:
    """columns as doubles: strict raises on text that is no number, coerce makes it null."""
    require(policy in ("strict", "coerce"), "unknown number policy")
    unknown = [c for c in columns if c not in df.columns]
    require(not unknown, f"unknown columns: {unknown}")
    tried = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    if policy == "strict" and columns:
        bad = df.agg(*(F.sum((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("int")).alias(c) for c in columns)).first()
        wrong = [c for c in columns if bad[c]]
        require(not wrong, f"columns hold text that is no number: {wrong}")
    return tried


def coerce_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns as strings; a null is the category 'nan'."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns})


def null_rows(df: DataFrame, policy: str = "error") -> DataFrame:
    """error raises on any null; drop_rows drops rows with one and raises if none is left."""
    require(policy in ("error", "drop_rows"), "unknown null policy")
    kept = df.na.drop("any")
    if policy == "error":
        counts = df.agg(*(F.sum(F.col(c).isNull().cast("int")).alias(c) for c in df.columns)).first()
        nulls = [c for c in df.columns if counts[c]]
        require(not nulls, f"columns hold nulls: {nulls}")
        return df
    if kept.isEmpty():
        raise NotEnoughDataError("no row is without nulls")
    return kept


def validate_pair(reference: DataFrame, current: DataFrame, schema: str = "strict", numbers: str = "strict", nulls: str = "error", numeric: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """align, then numbers, then nulls."""
    a, b = align(reference, current, schema)
    columns = [c for c in (numeric if numeric is not None else numeric_columns(a)) if c in a.columns]
    pair = [null_rows(coerce_numeric(df, columns, numbers), nulls) for df in (a, b)]
    return pair[0], pair[1]


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """df's named columns, all without names; unknown ones raise."""
    if not columns:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValidationError(f"unknown columns: {unknown}")
    return df.select(*columns)


def from_columnar(spark, data) -> DataFrame:
    """A DataFrame from Arrow, pandas, polars or nested lists; one-dimensional data becomes column x0."""
    import pandas as pd
    import pyarrow as pa

    if hasattr(data, "to_arrow"):
        data = data.to_arrow()
    if isinstance(data, pa.Table | pd.DataFrame):
        return spark.createDataFrame(data)
    rows = [r if isinstance(r, list | tuple) else [r] for r in (data.tolist() if hasattr(data, "tolist") else data)]
    require(bool(rows) and len({len(r) for r in rows}) == 1, "rows must be non-empty and of one width")
    require(not any(isinstance(x, list | tuple) for x in rows[0]), "data must have one or two dimensions")
    schema = T.StructType([T.StructField(f"x{i}", T.DoubleType()) for i in range(len(rows[0]))])
    return spark.createDataFrame([[float(x) for x in r] for r in rows], schema)
