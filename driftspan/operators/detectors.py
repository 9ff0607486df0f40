"""Batch detectors: a relation with one result row for each feature, and decisions over it.

Result rows: feature, method, drift, score, threshold, comparator, p_value, statistic, raw_p_value. Methods
with a p-value report the adjusted p-value as their score and drift below alpha; the others drift above a threshold.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import NotFittedError, ValidationError, require
from driftspan.functions.corrections import METHODS as CORRECTIONS
from driftspan.functions.corrections import adjust
from driftspan.functions.pvalues import chi2_p, cvm_p, ks_p, ks_p_limit
from driftspan.operators.binning import exact_quantiles
from driftspan.operators.distances import binned, cdf_statistics, chi_square
from driftspan.operators.pairs import numeric_columns, pairs, value_counts
from driftspan.operators.shared import kept

P_METHODS, CATEGORICAL = ("ks", "cvm", "chi2"), ("chi2", "tvd")
# Default thresholds, and least recommended sample sizes by method.
THRESHOLDS = {"psi": 0.2, "js": 0.1, "tvd": 0.1}
FAMILIES = (CATEGORICAL, ("psi", "js"), ("ks", "cvm", "wasserstein", "energy"))
RESULT = ("feature", "method", "drift", "score", "threshold", "comparator", "p_value", "statistic", "raw_p_value")


def statistics(reference: DataFrame, current: DataFrame, method: str, columns: Sequence[str] | None = None, bins: int = 10, strategy: str = "quantile", keys: Sequence[str] = (), p_limit: bool = False) -> DataFrame:
    """(keys..., feature, statistic, raw_p_value, n, m) by one of ks, cvm, chi2, psi, js, tvd, wasserstein, energy."""
    return _statistics(pairs(reference, current, columns, _kind(method), keys), method, bins, strategy, keys, p_limit)


def _kind(method: str) -> str:
    return "string" if method in CATEGORICAL else "double"


def _statistics(relation: DataFrame, method: str, bins: int, strategy: str, keys: Sequence[str], p_limit: bool) -> DataFrame:
    by = [*keys, "feature"]
    none = F.lit(None).cast("double")
    if method in CATEGORICAL:
        rows = chi_square(relation, keys)
        p = F.when(F.col("df") < 1, 1.0).otherwise(chi2_p(F.col("statistic"), F.col("df"))) if method == "chi2" else none
        return rows.select(*by, F.col("statistic" if method == "chi2" else "tvd").alias("statistic"), p.alias("raw_p_value"), "n", "m")
    if method in ("psi", "js"):
        return binned(relation, bins, strategy, keys).select(*by, F.col(method).alias("statistic"), none.alias("raw_p_value"), "n", "m")
    if method not in ("ks", "cvm", "wasserstein", "energy"):
        raise ValidationError(f"unknown method {method}")
    rows = cdf_statistics(relation, keys)
    size = [F.col("n"), F.col("m"), F.col(method)]
    p = {"ks": ks_p_limit if p_limit else ks_p, "cvm": cvm_p}.get(method, lambda *_: none)(*size)
    return rows.select(*by, F.col(method).alias("statistic"), p.alias("raw_p_value"), "n", "m")


def rollup(reference: DataFrame, current: DataFrame, method: str, keys: Sequence[str], columns: Sequence[str] | None = None, bins: int = 10, strategy: str = "quantile", p_limit: bool = False) -> DataFrame:
    """(level, keys..., feature, statistic, raw_p_value, n, m): the whole tables (level 0, keys null), cohorts by the first key, by the first two, and so on.

    Rows are scanned and counted by value once, for the finest cohorts; the others add these counts up, and every cohort has edges
    and running counts of its own. A null key is a cohort, which its level tells from a rolled-up one.
    """
    require(bool(keys), "keys to roll up are needed")
    require(strategy in ("quantile", "uniform") or method not in ("psi", "js"), "sketches are of rows, not of counts")
    counts = value_counts(pairs(reference, current, columns, _kind(method), keys), keys)
    kinds = {k: reference.schema[k].dataType for k in keys}
    level = lambda n: F.struct(F.lit(n).alias("level"), *(F.col(k).alias(k) if i < n else F.lit(None).cast(kinds[k]).alias(k) for i, k in enumerate(keys)))
    rows = counts.select(F.explode(F.array(*(level(n) for n in range(len(keys) + 1)))).alias("cohort"), "feature", "v", "r", "c")
    return _statistics(rows, method, bins, strategy, ["cohort"], p_limit).select("cohort.*", "feature", "statistic", "raw_p_value", "n", "m")


def _family(reference: DataFrame, current: DataFrame, methods: Sequence[str], columns: Sequence[str] | None, p_limit: bool) -> DataFrame:
    """(feature, method, statistic, raw_p_value) by methods of one family, from one aggregation."""
    none = F.lit(None).cast("double")
    relation = pairs(reference, current, columns, "string" if methods[0] in CATEGORICAL else "double")
    size = [F.col("n"), F.col("m")]
    if methods[0] in CATEGORICAL:
        rows, p = chi_square(relation), {"chi2": F.when(F.col("df") < 1, 1.0).otherwise(chi2_p(F.col("statistic"), F.col("df")))}
    elif methods[0] in ("psi", "js"):
        rows, p = binned(relation), {}
    else:
        rows, p = cdf_statistics(relation), {"ks": (ks_p_limit if p_limit else ks_p)(*size, F.col("ks")), "cvm": cvm_p(*size, F.col("cvm"))}
    values = [F.struct(F.lit(m).alias("method"), F.col("statistic" if m == "chi2" else m).alias("statistic"), p.get(m, none).alias("raw_p_value")) for m in methods]
    return rows.select("feature", F.explode(F.array(*values)).alias("x")).select("feature", "x.*")


def decide(rows: DataFrame, method: str, alpha: float, threshold: float | None, correction: str, keys: Sequence[str] = (), across: Sequence[str] = ()) -> DataFrame:
    """statistics() as result rows; p-values are adjusted over the features of a group `across`."""
    if method in P_METHODS:
        rows = adjust(rows, "raw_p_value", correction, "p_value", list(across))
        drift, score, limit, sign = F.col("p_value") < alpha, F.col("p_value"), alpha, "<"
    else:
        rows = rows.withColumn("p_value", F.lit(None).cast("double"))
        drift, score, limit, sign = F.col("statistic") > threshold, F.col("statistic"), threshold, ">"
    shown = {"method": F.lit(method), "drift": drift, "score": score, "threshold": F.lit(float(limit)), "comparator": F.lit(sign)}
    return rows.withColumns(shown).select(*keys, *RESULT)


@dataclass
class Univariate:
    """One method over every column, corrected for the number of columns."""

    method: str = "ks"
    alpha: float = 0.05
    threshold: float | None = None
    bins: int = 10
    correction: str = "bh"
    strategy: str = "quantile"
    p_limit: bool = False
    columns: Sequence[str] | None = None
    reference: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        require(self.method in (*P_METHODS, *THRESHOLDS, "wasserstein"), f"unknown method {self.method}")
        require(0 < self.alpha < 1, "alpha must lie between 0 and 1")
        require(self.correction in CORRECTIONS, f"correction must be one of {', '.join(CORRECTIONS)}")
        if self.method not in P_METHODS and self.threshold is None:
            self.threshold = THRESHOLDS.get(self.method)
            require(self.threshold is not None, f"{self.method} has no default threshold")

    def fit(self, reference: DataFrame) -> "Univariate":
        self.reference = reference
        return self

    def detect_features(self, current: DataFrame, keys: Sequence[str] = (), least: int = 0) -> DataFrame:
        """Result rows by feature; with keys by cohort, corrected over the cohorts of a feature. Cohorts of fewer than `least` rows on a side are left out."""
        if self.reference is None:
            raise NotFittedError("fit first")
        rows = statistics(self.reference, current, self.method, self.columns, self.bins, self.strategy, keys, self.p_limit)
        if least:
            rows = rows.where((F.col("n") >= least) & (F.col("m") >= least))
        return decide(rows, self.method, self.alpha, self.threshold, self.correction, keys, ["feature"] if keys else [])

    def detect(self, current: DataFrame) -> DataFrame:
        """One row: any feature drifts; the least adjusted p-value or the largest score."""
        pick = F.min if self.method in P_METHODS else F.max
        rows = self.detect_features(current)
        return rows.agg(F.lit(self.method).alias("method"), F.max("drift").alias("drift"), pick("score").alias("score"), F.first("threshold").alias("threshold"), F.count("*").alias("n_features"), F.sum(F.col("drift").cast("int")).alias("n_drifting"), F.array_sort(F.collect_list(F.when(F.col("drift"), F.col("feature")))).alias("drifting"))


@dataclass
class MixedType:
    """Numbers by numeric_method, everything else by chi-square; one correction over all p-values."""

    numeric_method: str = "ks"
    alpha: float = 0.05
    threshold: float | None = None
    bins: int = 10
    correction: str = "bh"
    overrides: dict[str, str] = field(default_factory=dict)
    p_limit: bool = False
    reference: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        require(self.numeric_method in ("ks", "psi", "js"), "numeric_method must be ks, psi or js")
        require(set(self.overrides.values()) <= {"numeric", "categorical"}, "overrides name numeric or categorical")

    def fit(self, reference: DataFrame) -> "MixedType":
        self.reference = reference
        return self

    def kinds(self) -> tuple[list[str], list[str]]:
        """(numeric, categorical) columns of the reference, overrides applied."""
        numeric = set(numeric_columns(self.reference))
        kind = {c: self.overrides.get(c, "numeric" if c in numeric else "categorical") for c in self.reference.columns}
        return [c for c in kind if kind[c] == "numeric"], [c for c in kind if kind[c] == "categorical"]

    def detect_features(self, current: DataFrame) -> DataFrame:
        if self.reference is None:
            raise NotFittedError("fit first")
        require(current.columns == self.reference.columns, "both samples need the same columns in the same order")
        numeric, categorical = self.kinds()
        parts = []
        for method, columns in ((self.numeric_method, numeric), ("chi2", categorical)):
            if columns:
                parts.append(statistics(self.reference, current, method, columns, self.bins, p_limit=self.p_limit).withColumn("method", F.lit(method)))
        rows = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        rows = adjust(rows, "raw_p_value", self.correction, "p_value")
        limit = self.threshold if self.threshold is not None else THRESHOLDS.get(self.numeric_method, self.alpha)
        has_p = F.col("p_value").isNotNull()
        shown = {"drift": F.when(has_p, F.col("p_value") < self.alpha).otherwise(F.col("statistic") > limit), "score": F.coalesce("p_value", "statistic"), "threshold": F.when(has_p, F.lit(self.alpha)).otherwise(F.lit(float(limit))), "comparator": F.when(has_p, "<").otherwise(">")}
        return rows.withColumns(shown).select(*RESULT)

    def detect(self, current: DataFrame) -> DataFrame:
        """One row: drift if any column drifts, score the number of them, threshold 0."""
        drifting = F.sum(F.col("drift").cast("int"))
        return self.detect_features(current).agg((drifting > 0).alias("drift"), drifting.cast("double").alias("score"), F.lit(0.0).alias("threshold"), F.count("*").alias("n_features"))


def required_votes(mode: str, methods: int, min_votes: int | None = None) -> int:
    """Votes that make a drift: one, all, or more than half; min_votes overrides."""
    require(mode in ("any", "majority", "all", "stacking"), "vote mode must be any, majority, all or stacking")
    if mode == "stacking":
        return 0
    if min_votes is not None:
        require(1 <= min_votes <= methods, "min_votes must be from 1 to the number of methods")
        return min_votes
    return {"any": 1, "all": methods}.get(mode, methods // 2 + 1)


@dataclass
class Ensemble:
    """Several methods for every column, and a vote for each column.

    A method's confidence is 1 - p, or score / threshold up to 1; stacking compares their mean with stack_threshold.
    A correction runs by method over the columns, before the vote; a corrected p-value votes below alpha.
    """

    methods: Sequence[str] = ("psi", "ks", "cvm", "js")
    vote_mode: str = "majority"
    min_votes: int | None = None
    correction: str = "none"
    stack_threshold: float = 0.5
    alpha: float = 0.05
    columns: Sequence[str] | None = None
    p_limit: bool = False

    def results(self, reference: DataFrame, current: DataFrame) -> DataFrame:
        """Result rows of every method and column with confidence. Methods of one family share its counts."""
        unknown = set(self.methods) - {m for family in FAMILIES for m in family}
        require(not unknown, f"unknown methods: {sorted(unknown)}")
        parts = []
        for family in FAMILIES:
            own = [m for m in self.methods if m in family]
            if own:
                parts.append(_family(reference, current, own, self.columns, self.p_limit))
        rows = adjust(reduce(DataFrame.unionByName, parts), "raw_p_value", self.correction, "p_value", ["method"])
        has_p = F.col("method").isin(*P_METHODS)
        limits = F.create_map(*(x for m in self.methods if m in THRESHOLDS for x in (F.lit(m), F.lit(THRESHOLDS[m])))) if set(self.methods) & set(THRESHOLDS) else None
        limit = F.when(has_p, F.lit(self.alpha)) if limits is None else F.when(has_p, F.lit(self.alpha)).otherwise(limits[F.col("method")])
        score = F.when(has_p, F.col("p_value")).otherwise(F.col("statistic"))
        rows = rows.withColumns({"threshold": limit, "score": score, "comparator": F.when(has_p, "<").otherwise(">")})
        rows = rows.withColumn("drift", F.when(has_p, F.col("score") < F.col("threshold")).otherwise(F.col("score") > F.col("threshold"))).select(*RESULT)
        confidence = F.when(F.col("p_value").isNotNull(), 1 - F.col("p_value")).otherwise(F.col("score") / F.col("threshold"))
        return rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))

    def detect(self, reference: DataFrame, current: DataFrame) -> DataFrame:
        """(feature, drift, votes, required_votes, stack_score)"""
        return vote(self.results(reference, current), self.vote_mode, len(self.methods), self.min_votes, self.stack_threshold)


def vote(rows: DataFrame, mode: str, methods: int, min_votes: int | None = None, stack_threshold: float = 0.5) -> DataFrame:
    """Votes over result rows by feature."""
    require(0 <= stack_threshold <= 1, "stack_threshold must lie between 0 and 1")
    needed = required_votes(mode, methods, min_votes)
    grouped = rows.groupBy("feature").agg(F.sum(F.col("drift").cast("int")).cast("int").alias("votes"), F.avg("confidence").alias("stack_score"))
    drift = F.col("stack_score") >= stack_threshold if mode == "stacking" else F.col("votes") >= needed
    return grouped.select("feature", drift.alias("drift"), "votes", F.lit(needed).alias("required_votes"), "stack_score")


def combine(results: DataFrame, mode: str = "majority") -> DataFrame:
    """One row for result rows of several detectors on the same data: score is the number of drifts, against 0, n/2 or n - 1."""
    require(mode in ("any", "majority", "all"), "vote must be any, majority or all")
    n, votes = F.count("*"), F.sum(F.col("drift").cast("int"))
    limit = {"any": F.lit(0.0), "majority": n / 2, "all": (n - 1).cast("double")}[mode]
    return results.agg((votes > limit).alias("drift"), votes.cast("double").alias("score"), limit.alias("threshold"))


def _weighted_median(rows: DataFrame, value: Column) -> DataFrame:
    """One row, median: of value, each as often as w says; null without rows. Selected by running counts of the distinct values."""
    counts = rows.groupBy(F.lit("x").alias("feature"), value.alias("v")).agg(F.sum("w").cast("double").alias("r"), F.lit(0.0).alias("c"))
    return exact_quantiles(kept(counts), [0.5]).agg(F.max(F.get("raw", F.lit(0))).alias("median"))


def datetime_drift(reference: DataFrame, current: DataFrame, column: str, threshold: float = 0.2, cadence_weight: float = 0.6, hour_weight: float = 0.4) -> DataFrame:
    """cadence_score, hour_score, score, threshold, drift of arrival gaps and hours of the day; invalid stamps are left out, and a side
    without valid ones is an error.

    Equal stamps are counted first and make gaps of zero; distinct stamps are sorted by day, and a day's first gap
    reaches back to the last stamp of the day with stamps before.
    """
    require(threshold > 0 and cadence_weight >= 0 and hour_weight >= 0 and cadence_weight + hour_weight > 0, "weights and threshold must be positive")
    stamps = [df.select(F.try_to_timestamp(F.col(column).cast("string")).alias("t")).where("t is not null") for df in (reference, current)]
    for side, name in zip(stamps, ("reference", "current"), strict=True):
        require(not side.isEmpty(), f"no valid timestamps on the {name} side")
    both = stamps[0].withColumn("side", F.lit(0)).unionByName(stamps[1].withColumn("side", F.lit(1))).groupBy("side", "t").agg(F.count("*").alias("k")).withColumn("day", F.to_date("t"))
    ends = both.groupBy("side", "day").agg(F.max("t").alias("end"))
    ends = ends.select("side", "day", F.lag("end").over(Window.partitionBy("side").orderBy("day")).alias("carried"))  # a row a day
    before = F.coalesce(F.lag("t").over(Window.partitionBy("side", "day").orderBy("t")), "carried")
    gaps = both.join(ends, ["side", "day"]).withColumn("gap", (F.unix_micros("t") - F.unix_micros(before)) / 1e6)
    gaps = gaps.select("side", F.explode(F.array(F.struct("gap", F.lit(1).cast("long").alias("w")), F.struct(F.lit(0.0).alias("gap"), (F.col("k") - 1).alias("w")))).alias("g")).select("side", "g.*").where("gap is not null and w > 0")
    gaps = kept(gaps)
    middle = _weighted_median(gaps.where("side = 0"), F.col("gap")).select(F.coalesce("median", F.lit(0.0)).alias("ref"))
    away = _weighted_median(gaps.where("side = 1").crossJoin(F.broadcast(middle)), F.abs(F.col("gap") - F.col("ref"))).select(F.col("median").alias("away"))
    cadence = middle.crossJoin(F.broadcast(away)).select((F.coalesce("away", "ref") / (F.col("ref") + 1e-9)).alias("cadence_score"))  # a row each
    hours = both.groupBy(F.hour("t").alias("h")).agg(*(F.sum(F.when(F.col("side") == s, F.col("k")).otherwise(0)).alias(x) for s, x in enumerate("pq")))
    total = Window.partitionBy(F.lit(1))
    shares = hours.withColumns({x: F.col(x) / F.sum(x).over(total) for x in "pq"}).withColumn("mid", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("mid"))).otherwise(0.0))
    hour = shares.agg(F.sqrt(F.greatest(F.lit(0.0), (part("p") + part("q")) / 2)).alias("hour_score"))
    score = (cadence_weight * F.col("cadence_score") + hour_weight * F.col("hour_score")) / (cadence_weight + hour_weight)
    return cadence.crossJoin(F.broadcast(hour)).withColumn("score", score).withColumns({"threshold": F.lit(threshold), "drift": F.col("score") > threshold})
