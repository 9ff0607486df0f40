"""Ordered series of any length: numbered without sorting one in a task, and computed over count windows in blocks."""

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftspan.errors import require

BLOCK = 8192


def sliced(df: DataFrame, order: str, slices: int | None = None) -> DataFrame:
    """df and slice: where `order` (a number, date or timestamp) lies between approximate quantiles of all rows.

    Slices follow each other in the order, rows of equal order share one, and a null lies in the first.
    """
    slices = slices or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    cuts = df.agg(F.percentile_approx(order, shares, max(1000, 20 * slices)).alias("__cuts"))  # one row
    place = F.size(F.filter("__cuts", lambda x: F.col(order) >= x))
    return df.crossJoin(F.broadcast(cuts)).withColumn("slice", F.when(F.col(order).isNull(), 0).otherwise(F.greatest(place, F.lit(0)))).drop("__cuts")


def numbered(df: DataFrame, order: str, keys: Sequence[str] = (), ties: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """df, slice and position: from 1 within the keys' series, by order and then ties. A task sorts a slice of a series."""
    rows = sliced(df, order, slices)
    sizes = rows.groupBy(*keys, "slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(order, *ties))
    joined = with_slices(rows.withColumn("__own", own), starts, keys)
    return joined.withColumn("position", F.col("__start") + F.col("__own")).select(*df.columns, "slice", "position")


def with_slices(rows: DataFrame, table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rows with the columns of table, which has a row for each (keys..., slice); null keys are a series too."""
    by = [*keys, "slice"]
    named = table.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(by)})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)))
    return rows.join(named if keys else F.broadcast(named), same).drop(*(f"__k{i}" for i in range(len(by))))


def running(rows: DataFrame, keys: Sequence[str], sums: dict[str, Column], least: dict[str, Column] | None = None) -> DataFrame:
    """rows (keys, slice, position) with running sums, by name, and, by name, running minima of expressions over these.

    Each slice runs by itself and is moved by what the slices before it come to: sums add up, the least of all is the least of
    each slice's. So one long series is the work of as many tasks as it has slices.
    """
    least = least or {}
    own = Window.partitionBy(*keys, "slice").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    if sums:
        rows = _summed(rows, keys, sums, own, before)
    if not least:
        return rows
    rows = rows.withColumns({name: F.min(x).over(own) for name, x in least.items()})
    lows = rows.groupBy(*keys, "slice").agg(*(F.min(name).alias(name) for name in least))
    lows = lows.select(*keys, "slice", *(F.min(name).over(before).alias(f"__{name}") for name in least))
    return with_slices(rows, lows, keys).withColumns({name: F.least(name, f"__{name}") for name in least}).drop(*(f"__{name}" for name in least))


def _summed(rows: DataFrame, keys: Sequence[str], sums: dict[str, Column], own: WindowSpec, before: WindowSpec) -> DataFrame:
    rows = rows.withColumns({name: F.sum(x).over(own) for name, x in sums.items()})
    totals = rows.groupBy(*keys, "slice").agg(*(F.max_by(name, "position").alias(name) for name in sums))
    starts = totals.select(*keys, "slice", *(F.coalesce(F.sum(name).over(before), F.lit(0.0)).alias(f"__{name}") for name in sums))
    moved = with_slices(rows, starts, keys).withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums})
    return moved.drop(*(f"__{name}" for name in sums))


def windowed(df: DataFrame, order: str, keys: Sequence[str], columns: Sequence[str], window: int, compute: Callable[[pa.Table, int], dict[str, np.ndarray]], fields: str, ties: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """(keys..., order, position, fields): what compute(rows, window) says of each row, from the last `window` rows up to it.

    compute gets consecutive rows of one series, with the given columns, and returns an array a field with a value a row; it may
    only look at the window. A series is cut into blocks of rows, each of which comes with the window - 1 rows before it, so a task holds
    a block and a window whatever the length of the series.
    """
    require(window >= 1, "window must be at least 1")
    size = block or max(window, BLOCK)
    require(size >= window - 1, "a block holds a window at least")
    rows = numbered(df.select(*keys, order, *(c for c in columns if c not in (*keys, order)), *(t for t in ties if t not in (*keys, order, *columns))), order, keys, ties)
    number = F.expr(f"(position - 1) div {size}")
    next_too = F.when(F.expr(f"(position - 1) % {size}") >= size - (window - 1), number + 1)
    dealt = rows.drop("slice").withColumn("__block", F.explode(F.array_compact(F.array(number, next_too))))
    types = {name: {"long": pa.int64(), "double": pa.float64()}[kind] for name, kind in map(str.split, fields.split(", "))}
    kinds = {c: df.schema[c].dataType for c in (*keys, order)}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        own = table["position"].to_numpy() > key[-1].as_py() * size
        found = compute(table, window) if own.any() else dict.fromkeys(types, np.zeros(len(table)))
        kept = table.select([*keys, order, "position"]).filter(pa.array(own))
        for name, kind in types.items():
            kept = kept.append_column(name, pa.array(found[name][own], from_pandas=True).cast(kind))
        return kept

    shown = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in (*keys, order))
    return dealt.groupBy(*keys, "__block").applyInArrow(run, f"{shown}, position long, {fields}")


def rolled(values: np.ndarray, window: int) -> np.ndarray:
    """Sums of the last `window` values up to each, of fewer at the beginning."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.arange(1, len(values) + 1)
    return upto[ends] - upto[np.maximum(0, ends - window)]
