"""Multiple-testing corrections as windows over a relation of p-values."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require

METHODS = ("none", "bonferroni", "bh")


def adjust(rows: DataFrame, p: str, method: str, out: str, within: list[str] | None = None) -> DataFrame:
    """rows with column out: p adjusted by none, bonferroni or bh (step-up) within groups."""
    require(method in METHODS, f"correction must be one of {', '.join(METHODS)}")
    if method == "none":
        return rows.withColumn(out, F.col(p))
    whole = Window.partitionBy(F.col(p).isNull(), *(within or []))
    tests = F.count(p).over(whole)
    if method == "bonferroni":
        return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * tests)))
    upto = whole.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = whole.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = rows.withColumn("__step", F.col(p) * tests / F.count(p).over(upto))
    return stepped.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__step").over(down)))).drop("__step")
