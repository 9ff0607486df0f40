"""The per-column metric table: smoothed categorical and kernel-density numeric measures."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspan.functions.pvalues import chi2_p, ks_p
from driftspan.operators.distances import cdf_statistics
from driftspan.operators.pairs import pairs, value_counts


def _js(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / mid)).otherwise(0.0))
    return shares.groupBy(*by).agg(F.sqrt(F.greatest(F.lit(0.0), (part("p") + part("q")) / 2)).alias("js_distance"))


def categorical_metrics(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, chi_square, p_value, kl_post_prior, kl_prior_post, js_distance, wasserstein) of shares smoothed by one; nulls take no part.

    chi_square is the goodness of fit of the current counts to the smoothed reference shares; wasserstein compares the two sets of shares.
    """
    known = [df.select(*columns) for df in (reference, current)]
    relation = pairs(*known, columns, "string").where("v <> 'nan'")
    whole = Window.partitionBy("feature")
    smoothed = {s: (F.col(n) + 1) / (F.sum(n).over(whole) + F.count("*").over(whole)) for n, s in (("r", "p"), ("c", "q"))}
    shares = value_counts(relation).withColumns({**smoothed, "m": F.sum("c").over(whole), "k": F.count("*").over(whole)})
    expected = F.col("p") * F.col("m")
    measures = shares.groupBy("feature").agg(
        F.sum(F.pow(F.col("c") - expected, 2) / expected).alias("chi_square"), (F.max("k") - 1).cast("int").alias("df"),
        F.sum(F.col("q") * F.ln(F.col("q") / F.col("p"))).alias("kl_post_prior"), F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl_prior_post"))
    long = shares.select("feature", F.explode(F.array(F.struct(F.col("p").alias("v"), F.lit(1.0).alias("r"), F.lit(0.0).alias("c")), F.struct(F.col("q").alias("v"), F.lit(0.0).alias("r"), F.lit(1.0).alias("c")))).alias("x")).select("feature", "x.*")
    moved = cdf_statistics(long).select("feature", "wasserstein")
    rows = measures.join(_js(shares, ["feature"]), "feature").join(moved, "feature")
    return rows.withColumn("p_value", chi2_p(F.col("chi_square"), F.col("df"))).select("feature", "chi_square", "p_value", "kl_post_prior", "kl_prior_post", "js_distance", "wasserstein")


def _kernel_sums(steps: int):
    """(feature, i, r, c): Gaussian kernel sums of a task's distinct values at the points of each feature's grid."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for feature in pc.unique(batch.column("feature")):
                own = batch.filter(pc.equal(batch.column("feature"), feature))
                at = {c: own.column(c).to_numpy() for c in own.schema.names if c != "feature"}
                x = at["lo"][0] + (at["hi"][0] - at["lo"][0]) * np.arange(steps) / (steps - 1)
                sums = total.setdefault(feature.as_py(), np.zeros((2, steps)))
                for k, s in enumerate("rc"):
                    width = at[f"sd{s}"][0] * at[f"n{s}"][0] ** -0.2
                    sums[k] += at[s] @ np.exp(-(((x[None, :] - at["v"][:, None]) / width) ** 2) / 2)
        for feature, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([feature] * steps), pa.array(np.arange(steps, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], ["feature", "i", "r", "c"])

    return add


def numeric_metrics(reference: DataFrame, current: DataFrame, columns: Sequence[str], steps: int = 100) -> DataFrame:
    """(feature, ks, p_value, wasserstein, js_distance): the last between Gaussian kernel densities on a grid of `steps` points.

    Features with fewer than two values a side are left out; one without spread has a NaN js_distance. Kernel sums run
    over distinct values, at the grid's points only: linear in the data, and a task sends `steps` sums a feature.
    """
    relation = pairs(reference, current, columns)
    spread = lambda s: F.sqrt(F.greatest((F.sum(F.col(s) * F.col("v") * F.col("v")) - F.pow(F.sum(F.col(s) * F.col("v")), 2) / F.sum(s)) / (F.sum(s) - 1), F.lit(0.0)))
    counts = value_counts(relation)
    shape = counts.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), *(x for s in "rc" for x in (F.sum(s).alias(f"n{s}"), spread(s).alias(f"sd{s}"))))
    shape = shape.where("nr >= 2 and nc >= 2")
    shown = counts.join(F.broadcast(shape.where("sdr > 0 and sdc > 0")), "feature")
    density = shown.mapInArrow(_kernel_sums(steps), "feature string, i int, r double, c double").groupBy("feature", "i").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    whole = Window.partitionBy("feature")
    shares = density.select("feature", *((F.col(s) / F.sum(s).over(whole)).alias(x) for s, x in (("r", "p"), ("c", "q"))))
    rows = cdf_statistics(relation).where("n >= 2 and m >= 2").join(_js(shares, ["feature"]), "feature", "left")
    return rows.select("feature", "ks", ks_p(F.col("n"), F.col("m"), F.col("ks")).alias("p_value"), "wasserstein", F.coalesce("js_distance", F.lit(float("nan"))).alias("js_distance"))
