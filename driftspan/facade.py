"""One entry for every method on one column or a whole table, with configuration and telemetry."""

import json
import os
import time
import tomllib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspan.errors import NotEnoughDataError, ValidationError, require
from driftspan.operators.detectors import Ensemble, Univariate, datetime_drift
from driftspan.operators.multivariate import bootstrap, classifier_test, two_sample_test, wasserstein_test

# Methods, and the least rows a side that they are recommended for.
RECOMMENDED = {"psi": 100, "js": 100, "ks": 20, "cvm": 20, "chi2cat": 50, "tvdcat": 50, "mmd": 50, "energy": 50, "c2st": 100, "wasserstein": 50, "datetime": 20}
COLUMNWISE = {"psi": "psi", "js": "js", "ks": "ks", "cvm": "cvm", "chi2cat": "chi2", "tvdcat": "tvd"}


@dataclass
class Unified:
    """detect() by any method. PSI and others of fixed bins take strategy and sketches for references beyond sorting."""

    method: str = "psi"
    alpha: float = 0.05
    threshold: float | None = None
    bins: int = 10
    strategy: str = "quantile"
    n_permutations: int = 200
    bootstrap_samples: int = 0
    random_state: int = 42
    record: Callable[[str, dict], None] | None = None

    def __post_init__(self):
        require(self.method in RECOMMENDED, f"unknown method {self.method}; one of {', '.join(RECOMMENDED)}")

    def detect(self, reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Result rows; too few rows raise, fewer than recommended are told to `record`."""
        began = time.monotonic()
        sizes = [df.count() for df in (reference, current)]
        if min(sizes) < 2:
            raise NotEnoughDataError("two rows a side are needed")
        if min(sizes) < RECOMMENDED[self.method]:
            self._tell("small_sample", rows=min(sizes), recommended=RECOMMENDED[self.method])
        try:
            rows = self._rows(reference, current, list(columns))
        except Exception as e:
            self._tell("error", kind=type(e).__name__)
            raise
        self._tell("latency_ms", value=1000 * (time.monotonic() - began))
        return rows

    def _tell(self, event: str, **values) -> None:
        if self.record:
            self.record(event, {"method": self.method, **values})

    def _rows(self, reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
        m = self.method
        if m in COLUMNWISE:
            rows = Univariate(COLUMNWISE[m], self.alpha, self.threshold, self.bins, "none", self.strategy, columns=columns).fit(reference).detect_features(current)
            return self._with_intervals(rows, reference, current, columns) if m in ("psi", "js") else rows
        if m in ("datetime", "wasserstein"):  # of one column each
            rows = reduce(DataFrame.unionByName, [self._one(reference, current, c) for c in columns])
            return self._with_intervals(rows, reference, current, columns) if m == "wasserstein" else rows
        if m == "c2st":
            found = classifier_test(reference, current, columns, self.n_permutations, self.alpha, seed=self.random_state).withColumn("score", F.col("statistic"))
        else:
            found = two_sample_test(reference, current, m, columns, self.n_permutations, self.alpha, seed=self.random_state).withColumn("score", F.col("statistic"))
        return self._shown(found, ",".join(columns))

    def _one(self, reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
        if self.method == "datetime":
            found = datetime_drift(reference, current, column, self.threshold or 0.2).withColumns({"p_value": F.lit(None).cast("double"), "statistic": F.col("score")})
        else:
            found = wasserstein_test(reference, current, column, self.n_permutations, self.alpha, self.random_state).withColumn("score", F.col("statistic"))
        return self._shown(found, column)

    def _with_intervals(self, rows: DataFrame, reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
        """rows with lo, hi and level of the bootstrap, if samples are asked for."""
        if not self.bootstrap_samples:
            return rows
        spans = [bootstrap(reference, current, c, self.method, self.bootstrap_samples, bins=self.bins, seed=self.random_state).withColumn("feature", F.lit(c)) for c in columns]
        return rows.join(reduce(DataFrame.unionByName, spans), "feature")

    def _shown(self, found: DataFrame, feature: str) -> DataFrame:
        return found.select(F.lit(feature).alias("feature"), F.lit(self.method).alias("method"), "drift", "score", "threshold", F.lit(">").alias("comparator"), "p_value", "statistic", F.col("p_value").alias("raw_p_value"))


@dataclass
class Config:
    """A check's settings, from keywords, a JSON, TOML or YAML file, or environment variables DRIFTSPAN_*."""

    method: str = "psi"
    threshold: float | None = None
    correction: str = "none"
    alpha: float = 0.05
    bins: int = 10
    strategy: str = "quantile"
    n_permutations: int = 200
    ensemble_methods: str = "psi,ks,cvm,js"
    vote_mode: str = "majority"
    min_votes: int | None = None
    stack_threshold: float = 0.5

    @classmethod
    def of(cls, values: dict) -> "Config":
        known = {f.name: f for f in fields(cls)}
        unknown = sorted(set(values) - set(known))
        require(not unknown, f"unknown settings: {unknown}")
        kinds = {"threshold": float, "alpha": float, "stack_threshold": float, "bins": int, "min_votes": int, "n_permutations": int}
        try:
            return cls(**{k: kinds.get(k, str)(v) if v is not None else None for k, v in values.items()})
        except (TypeError, ValueError) as e:
            raise ValidationError(f"a setting has the wrong type: {e}") from e

    @classmethod
    def from_file(cls, path: str) -> "Config":
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        if path.endswith(".toml"):
            return cls.of(tomllib.loads(text))
        import yaml

        return cls.of(yaml.safe_load(text) or {})

    @classmethod
    def from_env(cls, prefix: str = "DRIFTSPAN_") -> "Config":
        names = {f.name for f in fields(cls)}
        return cls.of({k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix) and k[len(prefix) :].lower() in names})


def run_check(reference: DataFrame, current: DataFrame, config: Config, columns: Sequence[str] | None = None) -> DataFrame:
    """Result rows of a check by a configuration; method ensemble gives a vote for each column."""
    from driftspan.operators.pairs import categorical_columns, numeric_columns
    from driftspan.operators.preprocessing import matching_columns, select_columns

    matching_columns(reference, current)
    reference, current = (select_columns(df, columns) for df in (reference, current))
    if config.method == "ensemble":
        names = [m.strip() for m in config.ensemble_methods.split(",")]
        return Ensemble(names, config.vote_mode, config.min_votes, config.correction, config.stack_threshold, config.alpha, columns).detect(reference, current)
    if config.method in COLUMNWISE:
        chosen = list(columns or (categorical_columns(reference) if config.method.endswith("cat") else numeric_columns(reference)))
        return Univariate(COLUMNWISE[config.method], config.alpha, config.threshold, config.bins, config.correction, config.strategy, columns=chosen).fit(reference).detect_features(current)
    stamps = [c for c, t in reference.dtypes if t.startswith("timestamp") or t == "date"]
    chosen = list(columns or (stamps if config.method == "datetime" else numeric_columns(reference)))
    require(bool(chosen), f"no columns for {config.method}")
    return Unified(config.method, config.alpha, config.threshold, config.bins, config.strategy, config.n_permutations).detect(reference, current, chosen)


class DriftMonitor(Estimator):
    """A pipeline stage that lets rows pass and keeps the drift of what it transforms against what it was fitted to."""

    def __init__(self, detector: Univariate | None = None):
        super().__init__()
        self.detector = detector or Univariate("psi")

    def _fit(self, dataset: DataFrame) -> "DriftMonitorModel":
        return DriftMonitorModel(self.detector, dataset)


class DriftMonitorModel(Model):
    def __init__(self, detector: Univariate, reference: DataFrame):
        super().__init__()
        self.detector, self.reference, self.last = detector, reference, None

    def score_drift(self, dataset: DataFrame) -> DataFrame:
        require(dataset.columns == self.reference.columns, "columns differ from those fitted to")
        return self.detector.fit(self.reference).detect_features(dataset)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.last = self.score_drift(dataset)
        return dataset
