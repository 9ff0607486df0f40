"""Sequential detectors over ordered series, one series a key.

Two forms. Windows: statistic and alarm of every row up to and with the first alarm of its series, as running
aggregates within code generation. Folds: all alarms with restart, a state machine for each series that
applyInPandas and the stateful streaming operator share. Series are independent, so keys are the parallelism.
"""

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.functions.pvalues import ks_exact
from driftspan.operators.series import numbered, running, with_slices

STEP = "score double, threshold double, warning boolean, drift boolean"


@dataclass
class Machine:
    """State machine: step(x) gives (score, threshold or None, warning, drift) and restarts itself after a drift."""

    state: dict = field(default_factory=dict, init=False)

    def __post_init__(self):
        self.check()
        self.state = self.start()

    def check(self) -> None: ...

    def start(self) -> dict:
        raise NotImplementedError

    def advance(self, x: float) -> tuple[float, float | None, bool, bool]:
        raise NotImplementedError

    def restart(self) -> None:
        self.state = self.start()

    def step(self, x: float) -> tuple[float, float | None, bool, bool]:
        out = self.advance(float(x))
        if out[3]:
            self.restart()
        return out


@dataclass
class Ddm(Machine):
    """Error rate p with deviation s against the least p + s so far; ties take the latest."""

    min_samples: int = 30
    warning_level: float = 2.0
    drift_level: float = 3.0

    def check(self):
        require(self.min_samples >= 1 and 0 < self.warning_level < self.drift_level, "need min_samples >= 1 and 0 < warning_level < drift_level")

    def start(self):
        return {"n": 0, "p": 0.0, "best": None}

    def advance(self, x):
        s = self.state
        s["n"] += 1
        s["p"] += (x - s["p"]) / s["n"]
        spread = math.sqrt(max(s["p"] * (1 - s["p"]), 0.0) / s["n"])
        score = s["p"] + spread
        if s["n"] < self.min_samples:
            return score, None, False, False
        if s["best"] is None or score <= sum(s["best"]):
            s["best"] = (s["p"], spread)
        base, unit = s["best"]
        drift = score > base + self.drift_level * unit
        return score, base + self.drift_level * unit, not drift and score > base + self.warning_level * unit, drift


@dataclass
class Eddm(Machine):
    """Mean distance between errors plus twice its deviation, against its largest value; other rows score 0."""

    min_errors: int = 30
    warning_level: float = 0.95
    drift_level: float = 0.9

    def check(self):
        require(self.min_errors >= 2 and 0 < self.drift_level < self.warning_level <= 1, "need min_errors >= 2 and 0 < drift_level < warning_level <= 1")

    def start(self):
        return {"n": 0, "errors": 0, "last": None, "sum": 0.0, "squares": 0.0, "top": 0.0}

    def advance(self, x):
        s = self.state
        s["n"] += 1
        if x < 0.5:
            return 0.0, None, False, False
        s["errors"] += 1
        previous, s["last"] = s["last"], s["n"]
        if previous is None:
            return 0.0, None, False, False
        distance, k = float(s["n"] - previous), s["errors"] - 1
        s["sum"] += distance
        s["squares"] += distance * distance
        mean = s["sum"] / k
        metric = mean + 2 * math.sqrt(max(s["squares"] / k - mean * mean, 0.0))
        if s["errors"] < self.min_errors:
            return metric, None, False, False
        s["top"] = max(s["top"], metric)
        limit = self.drift_level * s["top"]
        return metric, limit, limit <= metric < self.warning_level * s["top"], metric < limit


def _direction(direction: str) -> None:
    require(direction in ("increase", "decrease", "both"), "direction must be increase, decrease or both")


def _side(direction: str, up, down, most):
    return {"increase": up, "decrease": down}.get(direction) if direction != "both" else most(up, down)


@dataclass
class PageHinkley(Machine):
    """Cumulated deviation from the running mean against its own extreme; extremes begin at 0."""

    delta: float = 0.005
    threshold: float = 50.0
    direction: str = "both"

    def check(self):
        require(self.threshold > 0, "threshold must be positive")
        _direction(self.direction)

    def start(self):
        return {"n": 0, "mean": 0.0, "up": 0.0, "low": 0.0, "down": 0.0, "high": 0.0}

    def advance(self, x):
        s = self.state
        s["n"] += 1
        s["mean"] += (x - s["mean"]) / s["n"]
        s["up"] += x - s["mean"] - self.delta
        s["down"] += x - s["mean"] + self.delta
        s["low"], s["high"] = min(s["low"], s["up"]), max(s["high"], s["down"])
        score = _side(self.direction, s["up"] - s["low"], s["high"] - s["down"], max)
        return score, self.threshold, False, score > self.threshold


@dataclass
class Cusum(Machine):
    """Two-sided cumulative sums about target with slack."""

    target: float = 0.0
    slack: float = 0.5
    threshold: float = 5.0
    direction: str = "both"

    def check(self):
        require(self.threshold > 0 and self.slack >= 0, "threshold must be positive and slack not negative")
        _direction(self.direction)

    def start(self):
        return {"up": 0.0, "down": 0.0}

    def advance(self, x):
        s, away = self.state, x - self.target
        s["up"], s["down"] = max(0.0, s["up"] + away - self.slack), max(0.0, s["down"] - away - self.slack)
        score = _side(self.direction, s["up"], s["down"], max)
        return score, self.threshold, False, score > self.threshold


@dataclass
class Kswin(Machine):
    """KS test of the newest stat_size values of a full window against a seeded draw, with replacement, of the older ones.

    After a drift the newest stat_size values stay. The draw of a test depends on the seed and its number only.
    """

    alpha: float = 0.005
    window_size: int = 100
    stat_size: int = 30
    seed: int = 42

    def check(self):
        require(0 < self.alpha < 1 and 1 <= self.stat_size < self.window_size, "need 0 < alpha < 1 and 1 <= stat_size < window_size")

    def start(self):
        return {"tests": 0, "window": []}

    def restart(self):
        self.state["window"] = self.state["window"][-self.stat_size :]

    def advance(self, x):
        s = self.state
        s["window"] = [*s["window"], x][-self.window_size :]
        if len(s["window"]) < self.window_size:
            return 1.0, self.alpha, False, False
        older, newest = np.array(s["window"][: -self.stat_size]), np.sort(s["window"][-self.stat_size :])
        s["tests"] += 1
        drawn = np.sort(np.random.default_rng([self.seed, s["tests"]]).choice(older, self.stat_size))
        grid = np.concatenate([drawn, newest])
        d = np.abs(np.searchsorted(drawn, grid, "right") - np.searchsorted(newest, grid, "right")).max() / self.stat_size
        p = ks_exact(self.stat_size, self.stat_size, float(d))
        return p, self.alpha, False, p < self.alpha


@dataclass
class _Chart(Machine):
    control_limit: float = 3.0
    warmup: int = 30
    target: float | None = None
    sigma: float | None = None

    def check(self):
        require(self.control_limit > 0, "control_limit must be positive")
        require(self.warmup >= 2 or (self.target is not None and self.sigma is not None), "warmup must be at least 2")

    def start(self):
        known = self.target is not None and self.sigma is not None
        return {"seen": [], "target": self.target, "sigma": self.sigma, "z": self.target} if known else {"seen": [], "target": None, "sigma": None, "z": None}

    def restart(self) -> None:
        """Charts keep their limits after an alarm."""

    def warming(self, x: float) -> bool:
        s = self.state
        if s["target"] is not None:
            return False
        s["seen"].append(x)
        if len(s["seen"]) >= self.warmup:
            s["target"] = s["z"] = float(np.mean(s["seen"]))
            s["sigma"], s["seen"] = float(np.std(s["seen"])), []
        return True


@dataclass
class Shewhart(_Chart):
    """Single values against control_limit deviations about the mean of the warm-up."""

    def advance(self, x):
        if self.warming(x):
            return 0.0, None, False, False
        score, limit = abs(x - self.state["target"]), self.control_limit * self.state["sigma"]
        return score, limit, False, score > limit


@dataclass
class Ewma(_Chart):
    """Exponentially weighted mean against its asymptotic limits."""

    lam: float = 0.2

    def check(self):
        super().check()
        require(0 < self.lam <= 1, "lam must lie in (0, 1]")

    def advance(self, x):
        if self.warming(x):
            return 0.0, None, False, False
        s = self.state
        s["z"] = self.lam * x + (1 - self.lam) * s["z"]
        score, limit = abs(s["z"] - s["target"]), self.control_limit * s["sigma"] * math.sqrt(self.lam / (2 - self.lam))
        return score, limit, False, score > limit


MACHINES: dict[str, type[Machine]] = {"ddm": Ddm, "eddm": Eddm, "page_hinkley": PageHinkley, "cusum": Cusum, "kswin": Kswin, "shewhart": Shewhart, "ewma": Ewma}


def run_online(machine: Machine, values: Sequence[float]) -> list[int]:
    """Positions at which the machine fires."""
    return [i for i, x in enumerate(values) if machine.step(x)[3]]


def fold(df: DataFrame, machine: Callable[[], Machine], value: str, order: str, key: str) -> DataFrame:
    """(key, order, value, score, threshold, warning, drift) of every row, restarting after each drift.

    One state machine for each key; a series is read in order in batches and never held whole.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, current = None, None
        for batch in batches:
            rows = []
            for k, x in zip(batch[key], batch[value], strict=True):
                if own is None or k != current:
                    own, current = machine(), k
                rows.append(own.step(x))
            yield pd.concat([batch, pd.DataFrame(rows, columns=["score", "threshold", "warning", "drift"]).astype({"threshold": float})], axis=1)

    ordered = df.select(key, order, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` double, {STEP}")


def _running(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def first_alarm(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, position, order value, score, threshold) of the first row with drift of each series."""
    return rows.where("drift").groupBy(key).agg(F.min_by(F.struct("n", order, "score", "threshold"), order).alias("x")).select(key, "x.*")


def _numbered(df: DataFrame, value: str, order: str, key: str) -> DataFrame:
    kept = df.select(key, order, F.col(value).cast("double").alias("x")).where("x is not null")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def shewhart(df: DataFrame, value: str, order: str, key: str, control_limit: float = 3.0, warmup: int = 30) -> DataFrame:
    """(key, order, n, score, threshold, drift) of all rows; rows of the warm-up score 0."""
    whole = Window.partitionBy(key)
    early = F.when(F.col("n") <= warmup, F.col("x"))
    rows = _numbered(df, value, order, key).withColumns({"target": F.avg(early).over(whole), "sigma": F.stddev_pop(early).over(whole)})
    score = F.when(F.col("n") > warmup, F.abs(F.col("x") - F.col("target"))).otherwise(0.0)
    limit = F.when(F.col("n") > warmup, control_limit * F.col("sigma"))
    return rows.select(key, order, "n", score.alias("score"), limit.alias("threshold"), F.coalesce(score > limit, F.lit(False)).alias("drift"))


def _sliced_rows(df: DataFrame, value: str, order: str, key: str) -> DataFrame:
    """(key, order, x, slice, n) of the rows with a value; the position is `position` and, as a long, n."""
    kept = df.select(key, order, F.col(value).cast("double").alias("x")).where("x is not null")
    return numbered(kept, order, [key], ["x"]).withColumn("n", F.col("position").cast("long"))


def cusum(df: DataFrame, value: str, order: str, key: str, target: float = 0.0, slack: float = 0.5, threshold: float = 5.0, direction: str = "both") -> DataFrame:
    """(key, order, n, score, threshold, drift) without restarts: a sum less the least of its past and 0.

    A long series is cut into slices, whose sums and least sums are composed: max-plus sums are associative.
    """
    _direction(direction)
    sides = {"up": F.col("x") - target - slack, "down": target - F.col("x") - slack}
    rows = running(_sliced_rows(df, value, order, key), [key], sides, {f"low_{s}": F.col(s) for s in sides})
    held = {s: F.col(s) - F.least(F.lit(0.0), F.col(f"low_{s}")) for s in sides}
    score = _side(direction, held["up"], held["down"], F.greatest)
    return rows.select(key, order, "n", score.alias("score"), F.lit(threshold).alias("threshold")).withColumn("drift", F.col("score") > threshold)


def page_hinkley(df: DataFrame, value: str, order: str, key: str, delta: float = 0.005, threshold: float = 50.0, direction: str = "both") -> DataFrame:
    """(key, order, n, score, threshold, drift) without restarts. Slices as in cusum(), first for the running means, then for what lies off them."""
    _direction(direction)
    rows = running(_sliced_rows(df, value, order, key), [key], {"total": F.col("x")}).withColumn("away", F.col("x") - F.col("total") / F.col("n"))
    rows = running(rows, [key], {"up": F.col("away") - delta, "down": F.col("away") + delta}, {"low": F.col("up"), "high": -F.col("down")})
    up = F.col("up") - F.least(F.lit(0.0), F.col("low"))
    down = F.greatest(F.lit(0.0), -F.col("high")) - F.col("down")
    return rows.select(key, order, "n", _side(direction, up, down, F.greatest).alias("score"), F.lit(threshold).alias("threshold")).withColumn("drift", F.col("score") > threshold)


def _smoothed(x: np.ndarray, lam: float, block: int = 64) -> np.ndarray:
    """z_t = lam x_t + (1 - lam) z_{t-1} from z = 0: within blocks by a product, from block to block by the last z."""
    at = np.arange(block)
    weights = np.where(at[:, None] <= at[None, :], lam * (1 - lam) ** np.maximum(at[None, :] - at[:, None], 0), 0.0)
    out = np.append(x, np.zeros(-len(x) % block)).reshape(-1, block) @ weights
    fading, z = (1 - lam) ** (at + 1), 0.0
    for row in out:
        row += fading * z
        z = row[-1]
    return out.ravel()[: len(x)]


def ewma(df: DataFrame, value: str, order: str, key: str, control_limit: float = 3.0, warmup: int = 30, lam: float = 0.2) -> DataFrame:
    """(key, order, n, value, score, threshold, drift) of all rows, as the Ewma machine gives them; rows of the warm-up score 0.

    What a slice does to the mean that enters it is an affine map, so slices run by themselves from 0 and their maps are
    composed, a row a slice. Limits stay after an alarm.
    """
    Ewma(control_limit=control_limit, warmup=warmup, lam=lam)
    rows = _sliced_rows(df, value, order, key)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    early = rows.where(F.col("n") <= warmup).groupBy(F.col(key).alias("__key")).agg(F.avg("x").alias("target"), F.stddev_pop("x").alias("sigma"), F.count("*").alias("early"))

    def own(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        n = group["n"].to_numpy()
        z = np.zeros(len(n))
        z[n > warmup] = _smoothed(group["x"].to_numpy()[n > warmup], lam)
        return group.append_column("z", pa.array(z)).append_column("steps", pa.array(np.maximum(0, n - np.maximum(n[0] - 1, warmup))))

    local = rows.groupBy(key, "slice").applyInArrow(own, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, x double, slice int, position long, n long, z double, steps long")
    ends = local.groupBy(key, "slice").agg(F.max_by("z", "position").alias("z"), F.max("steps").alias("steps"))
    ends = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slice", "z", "steps"))).alias("ends"))  # a row a slice
    fade = lambda steps: F.pow(F.lit(1 - lam), steps)
    into = F.aggregate("ends", F.struct(F.col("target").alias("z"), F.array().cast("array<struct<slice:int,entering:double>>").alias("seen")), lambda s, e: F.struct((e["z"] + fade(e["steps"]) * s["z"]).alias("z"), F.concat(s["seen"], F.array(F.struct(e["slice"].alias("slice"), s["z"].alias("entering")))).alias("seen")), lambda s: s["seen"])
    entering = ends.join(early, F.col(key).eqNullSafe(F.col("__key"))).select(key, "target", "sigma", "early", F.explode(into).alias("e")).select(key, "target", "sigma", "e.slice", "e.entering")
    whole = with_slices(local, entering, [key])
    running_ = F.col("n") > warmup
    score = F.when(running_, F.abs(F.col("z") + fade(F.col("steps")) * F.col("entering") - F.col("target"))).otherwise(0.0)
    limit = F.when(running_, control_limit * F.col("sigma") * math.sqrt(lam / (2 - lam)))
    return whole.select(key, order, "n", F.col("x").alias(value), score.alias("score"), limit.alias("threshold"), F.coalesce(score > limit, F.lit(False)).alias("drift"))


def ddm(df: DataFrame, error: Column, order: str, key: str, min_samples: int = 30, drift_level: float = 3.0) -> DataFrame:
    """(key, order, n, score, threshold, drift) without restarts; error is 0 or 1. Slices as in cusum()."""
    rows = running(_sliced_rows(df.withColumn("__error", error), "__error", order, key), [key], {"errors": F.col("x")}).withColumn("p", F.col("errors") / F.col("n"))
    rows = rows.withColumn("s", F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(0.0)) / F.col("n")))
    late = F.when(F.col("n") >= min_samples, F.struct((F.col("p") + F.col("s")).alias("t"), (-F.col("n")).alias("k"), "p", "s"))
    rows = running(rows, [key], {}, {"best": late})
    limit = F.col("best.p") + drift_level * F.col("best.s")
    score = F.col("p") + F.col("s")
    return rows.select(key, order, "n", score.alias("score"), limit.alias("threshold"), F.coalesce(score > limit, F.lit(False)).alias("drift"))


def eddm(df: DataFrame, error: Column, order: str, key: str, min_errors: int = 30, drift_level: float = 0.9) -> DataFrame:
    """(key, order, n, score, threshold, drift) of the rows with an error, without restarts."""
    run = _running(key, order)
    rows = _numbered(df.withColumn("__error", error), "__error", order, key).where("x >= 0.5")
    rows = rows.withColumn("gap", (F.col("n") - F.lag("n").over(Window.partitionBy(key).orderBy(order))).cast("double"))
    metric = F.when(F.col("gap").isNull(), 0.0).otherwise(F.avg("gap").over(run) + 2 * F.stddev_pop("gap").over(run))
    rows = rows.withColumns({"score": metric, "errors": F.count("*").over(run)})
    top = F.max(F.when(F.col("errors") >= min_errors, F.col("score"))).over(run)
    rows = rows.withColumn("threshold", drift_level * top)
    return rows.select(key, order, "n", "score", "threshold", F.coalesce(F.col("score") < F.col("threshold"), F.lit(False)).alias("drift"))


def state_of(machine: Machine) -> dict:
    """What a stateful operator has to keep of a machine."""
    return {"parameters": {k: v for k, v in asdict(machine).items() if k != "state"}, "state": machine.state}
