"""Change points of ordered series, one series a key."""

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.operators.series import numbered, running
from driftspan.operators.shared import kept

FEW = 100_000  # splits that go to all tasks


class _Sums:
    """Sums of squared deviations of any stretch, from prefix sums."""

    def __init__(self, x: np.ndarray):
        x = x - x.mean() if len(x) else x
        self.one, self.two = (np.concatenate([[0.0], np.cumsum(y)]) for y in (x, x * x))

    def cost(self, a, b):
        n = np.maximum(np.subtract(b, a), 1)
        s = self.one[b] - self.one[a]
        return self.two[b] - self.two[a] - s * s / n


def binary_segmentation(x: np.ndarray, penalty: float, min_size: int = 2, max_breaks: int | None = None) -> list[tuple[int, float]]:
    """[(change point, gain)] in order: the split that lowers the squared error most, again and again, while it lowers it by more than penalty.

    A heap holds the best split of every open segment, so a split looks at its two new segments only.
    """
    require(min_size >= 1 and penalty >= 0, "min_size must be at least 1 and penalty not negative")
    sums, heap, found, turn = _Sums(np.asarray(x, float)), [], [], 0

    def offer(a: int, b: int) -> None:
        nonlocal turn
        at = np.arange(a + min_size, b - min_size + 1)
        if len(at):
            gains = sums.cost(a, b) - sums.cost(a, at) - sums.cost(at, b)
            best = int(gains.argmax())
            turn += 1
            heapq.heappush(heap, (-float(gains[best]), turn, int(at[best]), a, b))

    offer(0, len(x))
    while heap and (max_breaks is None or len(found) < max_breaks):
        gain, _, at, a, b = heapq.heappop(heap)
        if -gain <= penalty:
            break
        found.append((at, -gain))
        offer(a, at)
        offer(at, b)
    return sorted(found)


def pelt(x: np.ndarray, penalty: float, min_size: int = 1) -> list[int]:
    """Change points of the segmentation with the least squared error plus penalty for each point, exactly."""
    require(min_size >= 1 and penalty >= 0, "min_size must be at least 1 and penalty not negative")
    n = len(x)
    sums, best, came = _Sums(np.asarray(x, float)), np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0], open_ = -penalty, np.array([0])
    for end in range(min_size, n + 1):
        ready = open_[end - open_ >= min_size]
        if len(ready):
            costs = best[ready] + sums.cost(ready, end) + penalty
            k = int(costs.argmin())
            best[end], came[end] = costs[k], ready[k]
            long_enough = end - open_ >= min_size
            keep = ~long_enough
            keep[long_enough] = costs - penalty <= best[end]
            open_ = open_[keep]
        open_ = np.append(open_, end)
    points, at = [], n
    while at > 0:
        at = int(came[at])
        if at:
            points.append(at)
    return points[::-1]


def by_series(df: DataFrame, segment: Callable[[np.ndarray], list], value: str, order: str, key: str) -> DataFrame:
    """(key, change_point, score) of every series by a function of its ordered values. A series fits into one task."""
    kind = df.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values(order)[value].to_numpy(float)
        points = [p if isinstance(p, tuple) else (p, None) for p in segment(values)] if len(values) else []
        found = np.array([(p, np.nan if s is None else s) for p, s in points], float).reshape(-1, 2)
        return pd.DataFrame({key: group[key].iloc[:1].repeat(len(found)).to_numpy(object), "change_point": found[:, 0].astype("int64"), "score": found[:, 1]})

    return df.select(key, order, value).where(F.col(value).isNotNull()).groupBy(key).applyInPandas(run, f"`{key}` {kind}, change_point long, score double")


def window_gaps(df: DataFrame, value: str, order: str, key: str, window: int = 30) -> DataFrame:
    """(key, order, t, stat): standardised gap of the means of `window` values before position t (from 0) and from it on."""
    require(window >= 2, "window must be at least 2")
    by = Window.partitionBy(key).orderBy(order)
    left, right = by.rowsBetween(-window, -1), by.rowsBetween(0, window - 1)
    rows = df.select(key, order, F.col(value).cast("double").alias("x")).where("x is not null").withColumn("t", F.row_number().over(by).cast("long") - 1)
    rows = rows.withColumns({"size": F.count("*").over(Window.partitionBy(key)), "a": F.avg("x").over(left), "b": F.avg("x").over(right), "va": F.var_pop("x").over(left), "vb": F.var_pop("x").over(right)})
    stat = F.abs(F.col("a") - F.col("b")) / (F.sqrt((F.col("va") + F.col("vb")) / 2) + 1e-12)
    return rows.where((F.col("t") >= window) & (F.col("t") <= F.col("size") - window)).select(key, order, "t", stat.alias("stat"))


def window_changes(df: DataFrame, value: str, order: str, key: str, window: int = 30, threshold: float = 3.0, min_gap: int | None = None) -> DataFrame:
    """(key, change_point, score): gaps above threshold, none nearer than min_gap (by default window) to the one before it."""
    require(threshold > 0, "threshold must be positive")
    apart = window if min_gap is None else min_gap
    kind = df.schema[key].dataType.simpleString()

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for t, s in group.sort_values("t")[["t", "stat"]].itertuples(index=False):
            if last is None or t - last >= apart:
                kept.append((t, s))
                last = t
        return pd.DataFrame({key: [group[key].iloc[0]] * len(kept), "change_point": [int(t) for t, _ in kept], "score": [s for _, s in kept]})

    hits = window_gaps(df, value, order, key, window).where(F.col("stat") > threshold)
    return hits.groupBy(key).applyInPandas(thin, f"`{key}` {kind}, change_point long, score double")


def binary_segments(df: DataFrame, value: str, order: str, key: str, penalty: float, min_size: int = 2) -> DataFrame:
    """(key, change_point, score): as binary_segmentation() of each series, for series of any length.

    Prefix sums run over slices of a series. A round looks for the best split of all open segments of all series at once, an
    arg-max added up by task; rows of segments that were not split drop out, the others learn their new segment. Rounds
    are kept in shared storage; there are as many as segments lie within each other. Positions count from 0 over the rows that have a value.
    """
    require(min_size >= 1 and penalty >= 0, "min_size must be at least 1 and penalty not negative")
    valued = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("x")).where("x is not null")
    rows = numbered(valued, "o", ["k"], ["x"])
    means = rows.groupBy(F.col("k").alias("__k")).agg(F.avg("x").alias("mean"))
    rows = rows.join(means, F.col("k").eqNullSafe(F.col("__k"))).withColumn("x", F.col("x") - F.col("mean")).drop("__k", "mean")
    rows = running(rows, ["k"], {"one": F.col("x"), "two": F.col("x") * F.col("x")}).select("k", F.struct(F.col("position").alias("n"), "one", "two").alias("at"))
    ends = rows.groupBy(F.col("k").alias("__k")).agg(F.max_by("at", "at.n").alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("one"), F.lit(0.0).alias("two"))
    opened = rows.join(ends, F.col("k").eqNullSafe(F.col("__k"))).select("k", "at", start.alias("a"), "b")
    opened = kept(opened)

    def cost(p: str, q: str) -> Column:
        n, one = F.greatest(F.col(f"{q}.n") - F.col(f"{p}.n"), F.lit(1)), F.col(f"{q}.one") - F.col(f"{p}.one")
        return F.col(f"{q}.two") - F.col(f"{p}.two") - one * one / n

    wide = (F.col("at.n") - F.col("a.n") >= min_size) & (F.col("b.n") - F.col("at.n") >= min_size)
    found = [opened.select("k", F.lit(0).cast("long").alias("change_point"), F.lit(0.0).alias("score")).limit(0)]
    while True:
        gains = opened.where(wide).withColumn("gain", cost("a", "b") - cost("a", "at") - cost("at", "b"))
        best = gains.groupBy(F.col("k").alias("__k"), F.col("a.n").alias("__a")).agg(F.max_by(F.struct("at", "gain"), F.struct("gain", (-F.col("at.n")).alias("first"))).alias("s"))
        splits = kept(best.where(F.col("s.gain") > penalty))
        n = splits.count()
        if not n:
            break
        found.append(splits.select(F.col("__k").alias("k"), F.col("s.at.n").alias("change_point"), F.col("s.gain").alias("score")))
        told = opened.join(F.broadcast(splits) if n <= FEW else splits, F.col("k").eqNullSafe(F.col("__k")) & (F.col("a.n") == F.col("__a")))
        left = F.col("at.n") <= F.col("s.at.n")
        opened = kept(told.select("k", "at", F.when(left, F.col("a")).otherwise(F.col("s.at")).alias("a"), F.when(left, F.col("s.at")).otherwise(F.col("b")).alias("b")))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("k", key)
