"""Two samples as one relation: feature, v, r and c, where r and c count a row for the reference or the current side."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.errors import require

ACCURACY = 20  # of the cuts between slices: so many times their number


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers and booleans, in order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType | T.BooleanType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in numeric_columns(df)]


def _long(df: DataFrame, columns: Sequence[str], kind: str, keys: Sequence[str]) -> DataFrame:
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    text = ["'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in columns]
    pairs = ", ".join(f"{t}, cast({q} as {kind})" for t, q in zip(text, quoted, strict=True))
    return df.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) as (feature, v)"))


def pairs(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, kind: str = "double", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, v, r, c). Numbers: nulls and NaN are left out. Strings: a null is the category 'nan'.

    One scan of each side whatever the number of columns. keys are cohort columns of both sides.
    """
    columns = list(columns or (numeric_columns(reference) if kind == "double" else categorical_columns(reference)))
    require(bool(columns), "no columns to compare")
    sides = []
    for df, r, c in ((reference, 1.0, 0.0), (current, 0.0, 1.0)):
        missing = [x for x in columns if x not in df.columns]
        require(not missing, f"missing columns: {missing}")
        sides.append(_long(df, columns, kind, keys).withColumns({"r": F.lit(r), "c": F.lit(c)}))
    both = sides[0].unionByName(sides[1])
    if kind == "double":
        return both.where("v is not null and not isnan(v)")
    return both.withColumn("v", F.coalesce("v", F.lit("nan")))


def value_counts(relation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, v, r, c) with one row for each distinct value; summed on the map side first."""
    return relation.groupBy(*keys, "feature", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def few(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """table, which has a bounded number of rows for each (keys..., feature), as the side of a join.

    Without keys there is a feature a column of the input, so it goes to all tasks and the other side stays where it is.
    Cohorts may be many: with keys both sides are dealt by them, and a large cohort is split at run time.
    """
    return table if keys else F.broadcast(table)


def running_counts(relation: DataFrame, keys: Sequence[str] = (), slices: int | None = None, counted: bool = False) -> DataFrame:
    """value_counts with cr, cc (counts up to and with v), n, m (totals), next (the next larger value, or null) and slice.

    With slices > 1 the values of a feature are cut at approximate quantiles, added up within slices and moved by the
    totals of the slices before: no task sorts a whole feature. The result is the same. By default there are as many
    slices as shuffle partitions. counted: relation has a row a value already, as value_counts gives it.
    """
    slices = slices or int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "feature"]
    counts = relation if counted else value_counts(relation, keys)
    order = Window.partitionBy(*by).orderBy("v")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    if slices <= 1:
        return counts.withColumns({"cr": F.sum("r").over(upto), "cc": F.sum("c").over(upto), "n": F.sum("r").over(whole), "m": F.sum("c").over(whole), "next": F.lead("v").over(order), "slice": F.lit(0)})
    shares = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    used = counts.where("r + c >= 0")  # all columns are read, so that the counts' shuffle serves both sides of the join
    cuts = used.groupBy(*by).agg(F.percentile_approx("v", shares, max(1000, ACCURACY * slices)).alias("cuts"))
    sliced = counts.join(few(cuts, keys), by).withColumn("slice", _place(F.col("v"), F.col("cuts"))).drop("cuts")
    totals = sliced.groupBy(*by, "slice").agg(F.sum("r").alias("sr"), F.sum("c").alias("sc"), F.min("v").alias("first"))
    by_slice = Window.partitionBy(*by).orderBy("slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"br": F.coalesce(F.sum("sr").over(before), F.lit(0.0)), "bc": F.coalesce(F.sum("sc").over(before), F.lit(0.0)), "n": F.sum("sr").over(whole), "m": F.sum("sc").over(whole), "after": F.lead("first").over(by_slice)})
    inner = Window.partitionBy(*by, "slice").orderBy("v")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.withColumns({"cr": F.sum("r").over(upto), "cc": F.sum("c").over(upto), "next": F.lead("v").over(inner)}).join(few(totals.drop("sr", "sc", "first"), keys), [*by, "slice"])
    return rows.withColumns({"cr": F.col("cr") + F.col("br"), "cc": F.col("cc") + F.col("bc"), "next": F.coalesce("next", "after")}).select(*by, "v", "r", "c", "cr", "cc", "n", "m", "next", "slice")


def _place(v: Column, cuts: Column) -> Column:
    """Number of the cuts up to v."""
    return F.size(F.filter(cuts, lambda x: v >= x))
