"""Synthetic drift scenarios and scale checks, generated by Spark."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.operators.detectors import Univariate
from driftspan.operators.distances import binned
from driftspan.operators.pairs import pairs

NUMERIC = ("no_drift", "mean_shift", "variance_shift", "tail_shift")
# Category shares of the two categorical scenarios, reference then current.
CATEGORICAL = {"cat_no_drift": ((0.4, 0.4, 0.2), (0.4, 0.4, 0.2)), "cat_shift": ((0.5, 0.4, 0.1), (0.1, 0.3, 0.6))}


def scenario(spark: SparkSession, name: str, n: int, seed: int = 42, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """(reference, current) with column v, n rows each."""
    ids = spark.range(0, n, 1, parts)
    if name in CATEGORICAL:
        return tuple(ids.select(F.rand(seed + i).alias("u")).select(F.when(F.col("u") < s[0], "a").when(F.col("u") < s[0] + s[1], "b").otherwise("c").alias("v")) for i, s in enumerate(CATEGORICAL[name]))
    require(name in NUMERIC, f"unknown scenario {name}")
    z = F.randn(seed + 1)
    chi = sum((F.pow(F.randn(seed + k), 2) for k in (2, 3, 4)), F.lit(0.0))
    current = {"no_drift": z, "mean_shift": z + 0.8, "variance_shift": z * 1.8, "tail_shift": z / F.sqrt(chi / 3)}[name]
    return ids.select(F.randn(seed).alias("v")), ids.select(current.alias("v"))


def trials(spark: SparkSession, method: str, name: str, n: int = 300, count: int = 25, seed: int = 42) -> DataFrame:
    """(trial, drift, score): independent repetitions as features of one job."""
    a, b = scenario(spark, name, n * count, seed)
    columns = {f"t{i}": F.when(F.col("k") == i, F.col("v")) for i in range(count)}
    sides = [df.withColumn("k", F.pmod(F.monotonically_increasing_id(), F.lit(count))).select(*(c.alias(k) for k, c in columns.items())) for df in (a, b)]
    if name in CATEGORICAL:
        rows = []
        for i in range(count):
            parts = [df.select(f"t{i}").where(F.col(f"t{i}").isNotNull()) for df in sides]
            rows.append(Univariate(method, correction="none", columns=[f"t{i}"]).fit(parts[0]).detect_features(parts[1]))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
    else:
        out = Univariate(method, correction="none", columns=list(columns)).fit(sides[0]).detect_features(sides[1])
    return out.select(F.col("feature").alias("trial"), "drift", "score")


def summaries(spark: SparkSession, method: str, n: int = 300, count: int = 25, seed: int = 42) -> list[dict]:
    """A row for each scenario of the method's kind: drift_rate, avg_score and avg_latency_ms of a trial, its share of one job's time."""
    rows = []
    for name in CATEGORICAL if method in ("chi2", "tvd") else NUMERIC:
        began = time.monotonic()
        found = trials(spark, method, name, n, count, seed).collect()
        took = 1000 * (time.monotonic() - began) / len(found)
        rows.append({"method": method, "scenario": name, "drift_rate": sum(r["drift"] for r in found) / len(found), "avg_score": sum(r["score"] for r in found) / len(found), "avg_latency_ms": round(took, 3)})
    return rows


def massive_psi(spark: SparkSession, rows: int = 100_000_000, bins: int = 10, sample: int = 50_000, parts: int | None = None) -> dict:
    """PSI of N(0.35, 1) against N(0, 1) with `rows` generated rows a side: seconds, rows a second, and the gap to a sample's PSI.

    Edges come from a sketch of the reference; counting is one map-side aggregation, nothing is sorted or kept.
    """
    parts = parts or spark.sparkContext.defaultParallelism * 4
    made = lambda n: (spark.range(0, n, 1, parts).select(F.randn(1).alias("v")), spark.range(0, n, 1, parts).select((F.randn(2) + 0.35).alias("v")))
    began = time.monotonic()
    value, seconds = binned(pairs(*made(rows)), bins, "approx").first()["psi"], time.monotonic() - began
    small = binned(pairs(*made(sample)), bins).first()["psi"]
    return {"rows": rows, "score": value, "sample_score": small, "delta": abs(value - small), "seconds": seconds, "rows_per_second": rows / seconds}


def parity(spark: SparkSession, methods: tuple[str, ...] = ("psi", "ks", "js", "wasserstein"), small: int = 2000, large: int = 20_000, tolerance: float = 0.12, seed: int = 42) -> DataFrame:
    """(method, small_score, large_score, delta, within): scores of a shifted sample and of the same sample tiled to `large` rows."""
    from driftspan.operators.detectors import statistics

    require(0 < small <= large and large % small == 0, "large must be a multiple of small")
    a, b = scenario(spark, "mean_shift", small, seed)
    tiles = spark.range(large // small)
    tile = lambda df: df.crossJoin(F.broadcast(tiles)).select("v")  # a fixed number of copies
    parts = []
    for m in methods:
        one, many = (statistics(x, y, m, ["v"]).select(F.col("statistic").alias(n)) for x, y, n in ((a, b, "small_score"), (tile(a), tile(b), "large_score")))
        parts.append(one.crossJoin(F.broadcast(many)).select(F.lit(m).alias("method"), "small_score", "large_score"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("delta", F.abs(F.col("large_score") - F.col("small_score"))).withColumn("within", F.col("delta") <= tolerance)


def stream_phases(spark: SparkSession, state: str, batches: int = 12, size: int = 64, seed: int = 101) -> dict[str, float]:
    """Drift rates of the early, middle (shifted) and late third of a replayed stream against a fixed baseline."""
    from driftspan.streaming.monitor import StreamMonitor

    require(batches >= 3 and size >= 2, "need three batches of two rows")
    monitor = StreamMonitor(spark, state, Univariate("ks"))
    monitor.set_baseline(spark.range(size * 4).select(F.randn(seed).alias("v")))
    third, hits = batches // 3, {"early": [], "middle": [], "late": []}
    for i in range(batches):
        phase = "early" if i < third else "middle" if i < 2 * third else "late"
        batch = spark.range(0, size, 1, 1).select((F.randn(seed + i + 1) + (1.5 if phase == "middle" else 0.0)).alias("v"))
        hits[phase].append(any(r["drift"] for r in monitor.process(batch, i)))
    return {k: sum(v) / len(v) for k, v in hits.items()}
