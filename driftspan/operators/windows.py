"""Count-based windows of ordered series."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require


def sliding(order: str, key: str, size: int):
    """The last `size` rows up to the current one."""
    require(size >= 1, "size must be at least 1")
    return Window.partitionBy(key).orderBy(order).rowsBetween(1 - size, 0)


def expanding(order: str, key: str, max_size: int | None = None):
    """All rows so far, or the last max_size of them."""
    return sliding(order, key, max_size) if max_size else Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def block(order: str, key: str, size: int) -> Column:
    """Number of the tumbling block of `size` rows that a row is in, from 0."""
    require(size >= 1, "size must be at least 1")
    return F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("long")


def newest(df: DataFrame, order: str, size: int, key: str | None = None) -> DataFrame:
    """The last `size` rows of every key. Without a key a top-k: each task keeps `size` rows before they meet."""
    require(size >= 1, "size must be at least 1")
    if key is None:
        return df.orderBy(F.desc(order)).limit(size)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= size).drop("__rank")
