"""Distances between two samples, for all features of pairs() in one job."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.operators.binning import bin_edges, histograms, known_edges
from driftspan.operators.pairs import running_counts, value_counts

TINY = 1e-12


def psi_of(p: Column, q: Column, epsilon: float = 1e-6) -> Column:
    """Population stability index of shares p (reference) and q; zeros become epsilon."""
    a, b = (F.when(x <= 0, F.lit(epsilon)).otherwise(x) for x in (p, q))
    return F.sum((b - a) * F.ln(b / a))


def _clipped(df: DataFrame, by: Sequence[str], columns: Sequence[str], epsilon: float) -> DataFrame:
    """columns as distributions within `by`: normalised, clipped from below, normalised again."""
    whole = Window.partitionBy(*by)
    for _ in range(2):
        df = df.withColumns({c: F.greatest(F.col(c) / F.sum(c).over(whole), F.lit(epsilon)) for c in columns})
    return df.withColumns({c: F.col(c) / F.sum(c).over(whole) for c in columns})


def divergences(shares: DataFrame, by: Sequence[str] = ("feature",), epsilon: float = TINY, psi_epsilon: float | None = None) -> DataFrame:
    """(by..., kl_pq, kl_qp, js in nats, js_distance with base 2, tvd) of columns p and q, one row each bin or category; given an epsilon for it, psi too, and the sizes n and m that shares carry."""
    raw = shares.withColumns({"__p": F.col("p"), "__q": F.col("q")})
    clipped = _clipped(raw, by, ["p", "q"], epsilon).withColumn("mid", (F.col("p") + F.col("q")) / 2)
    kl = lambda a, b: F.sum(F.col(a) * F.ln(F.col(a) / F.col(b)))
    js = (kl("p", "mid") + kl("q", "mid")) / 2
    psi = [] if psi_epsilon is None else [psi_of(F.col("__p"), F.col("__q"), psi_epsilon).alias("psi"), F.max("n").alias("n"), F.max("m").alias("m")]
    rows = clipped.groupBy(*by).agg(kl("p", "q").alias("kl_pq"), kl("q", "p").alias("kl_qp"), F.greatest(js, F.lit(0.0)).alias("js"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tvd"), *psi)
    return rows.withColumn("js_distance", F.sqrt(F.col("js") / F.ln(F.lit(2.0))))


def binned(relation: DataFrame, bins: int = 10, strategy: str = "quantile", keys: Sequence[str] = (), epsilon: float = 1e-6) -> DataFrame:
    """(keys..., feature, psi, js, n, m), all from one histogram."""
    by = [*keys, "feature"]
    counted = strategy == "quantile"  # these edges come from counts by value, and the bins of the same counts
    rows = value_counts(relation, keys) if counted else relation
    edges = bin_edges(rows, bins, strategy, keys=keys, counted=counted)
    shares = histograms(rows, edges if keys or counted else known_edges(edges), keys)
    return divergences(shares, by, psi_epsilon=epsilon).select(*by, "psi", "js", "n", "m")


def category_shares(relation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, v, r, c, p, q) over the union of both samples' categories."""
    whole = Window.partitionBy(*keys, "feature")
    return value_counts(relation, keys).withColumns({s: F.col(n) / F.greatest(F.sum(n).over(whole), F.lit(1.0)) for n, s in (("r", "p"), ("c", "q"))})


def chi_square(relation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, statistic, df, tvd, n, m): Pearson's statistic of the 2 x k table without a continuity correction."""
    by = [*keys, "feature"]
    whole = Window.partitionBy(*by)
    rows = category_shares(relation, keys).withColumns({"n": F.sum("r").over(whole), "m": F.sum("c").over(whole)})
    total = F.col("n") + F.col("m")
    part = sum((F.pow(F.col(x) - (F.col("r") + F.col("c")) * F.col(s) / total, 2) / ((F.col("r") + F.col("c")) * F.col(s) / total) for x, s in (("r", "n"), ("c", "m"))), F.lit(0.0))
    grouped = rows.groupBy(*by).agg(F.sum(part).alias("statistic"), (F.count("*") - 1).cast("int").alias("df"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tvd"), F.max("n").alias("n"), F.max("m").alias("m"))
    return grouped.withColumn("statistic", F.when(F.col("df") < 1, 0.0).otherwise(F.col("statistic")))


def _rank_part(count: Column, before: Column, rank: Column) -> Column:
    """Sum of (rank - before - j)^2 for j from 1 to count."""
    a = rank - before
    return count * a * a - a * count * (count + 1) + count * (count + 1) * (2 * count + 1) / 6


def cdf_statistics(relation: DataFrame, keys: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """(keys..., feature, n, m, ks, wasserstein, energy, cvm): all from one pass over the pooled distribution.

    energy is the energy distance of one-dimensional samples, twice the integral of the squared gap; cvm the
    two-sample Cramer-von Mises statistic with mid-ranks for ties.
    """
    gap = F.abs(F.col("cr") / F.col("n") - F.col("cc") / F.col("m"))
    width = F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))
    tied, below = F.col("r") + F.col("c"), F.col("cr") + F.col("cc") - F.col("r") - F.col("c")
    rank = below + (tied + 1) / 2
    parts = F.col("n") * _rank_part(F.col("r"), F.col("cr") - F.col("r"), rank) + F.col("m") * _rank_part(F.col("c"), F.col("cc") - F.col("c"), rank)
    rows = running_counts(relation, keys, slices).groupBy(*keys, "feature").agg(
        F.max("n").alias("n"), F.max("m").alias("m"), F.max(gap).alias("ks"), F.sum(gap * width).alias("wasserstein"), (2 * F.sum(gap * gap * width)).alias("energy"), F.sum(parts).alias("u"))
    nm, total = F.col("n") * F.col("m"), F.col("n") + F.col("m")
    return rows.withColumn("cvm", F.col("u") / (nm * total) - (4 * nm - 1) / (6 * total)).drop("u")
