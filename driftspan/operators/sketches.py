"""Quantile sketches by chunk of time, stored once and merged for any range of chunks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.operators.pairs import few, running_counts


def rank_bound(k: int) -> float:
    """The error of a KLL sketch's rank, as a share of all rows, that 99 of 100 sketches keep, whatever is merged into them.

    Fixed values: 2.296 and 0.9021, the published fit for this sketch.
    """
    return 2.296 / k**0.9021


def sketch_chunks(rows: DataFrame, chunk: str | Column, k: int = 400) -> DataFrame:
    """(chunk, feature, n, sketch) of rows (feature, v): a row of a few kB for each chunk and feature, from one pass.

    Chunks may be sketched at different times and kept as a table; a chunk that was sketched in parts has a row for each part.
    """
    require(8 <= k <= 65535, "k must lie between 8 and 65535")
    named = F.col(chunk) if isinstance(chunk, str) else chunk
    kept = rows.where("v is not null and not isnan(v)")
    return kept.groupBy(named.alias("chunk"), "feature").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, first=None, last=None) -> DataFrame:
    """(feature, n, sketch) of the chunks from first to last, both included; no end means all on that side."""
    if first is not None:
        sketches = sketches.where(F.col("chunk") >= F.lit(first))
    if last is not None:
        sketches = sketches.where(F.col("chunk") <= F.lit(last))
    return sketches.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(whole: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(feature, share, v) of merged sketches."""
    require(all(0 <= s <= 1 for s in shares), "shares lie between 0 and 1")
    each = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.expr(f"kll_sketch_get_quantile_double(sketch, {float(s)}D)").alias("v")) for s in shares))
    return whole.select("feature", F.explode(each).alias("x")).select("feature", "x.share", "x.v")


def sketch_edges(whole: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges) of merged sketches, for histograms()."""
    rows = sketch_quantiles(whole, [i / bins for i in range(bins + 1)]).groupBy("feature").agg(F.array_sort(F.collect_set("v")).alias("edges"))
    only = F.col("edges")[0]
    return rows.select("feature", F.when(F.size("edges") < 2, F.array(only, only + 1)).otherwise(F.col("edges")).alias("edges"))


def rank_errors(quantiles: DataFrame, rows: DataFrame) -> DataFrame:
    """(feature, share, v, error): how far a share lies outside the ranks that v has among rows (feature, v), as a share of them."""
    counts = running_counts(rows.where("v is not null and not isnan(v)").select("feature", "v", F.lit(1.0).alias("r"), F.lit(0.0).alias("c")))
    asked = quantiles.groupBy("feature").agg(F.collect_list(F.struct("share", F.col("v").alias("x"))).alias("asked"))
    found = counts.join(few(asked), "feature").select("feature", F.explode("asked").alias("a"), "v", "r", "cr", "n").where("v <= a.x")
    ranks = found.groupBy("feature", "a.share", F.col("a.x").alias("v")).agg(F.max(F.when(F.col("v") < F.col("a.x"), F.col("cr")).otherwise(F.col("cr") - F.col("r"))).alias("below"), F.max("cr").alias("upto"), F.max("n").alias("n"))
    return ranks.select("feature", "share", "v", F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("share"), F.col("share") - F.col("upto") / F.col("n")).alias("error"))
