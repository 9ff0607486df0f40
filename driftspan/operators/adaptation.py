"""When to retrain, on which rows, and which model to keep."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.operators.windows import newest


def periodic(df: DataFrame, order: str, period: int, key: str) -> DataFrame:
    """df with retrain: true at every period-th row of a key."""
    require(period >= 1, "period must be at least 1")
    return df.withColumn("retrain", F.row_number().over(Window.partitionBy(key).orderBy(order)) % period == 0)


@dataclass
class Trigger:
    """Retrain after enough drift events and/or a fall of a metric below its first value, then rest for `cooldown` calls."""

    required_drifts: int = 1
    metric: str | None = None
    min_drop: float | None = None
    baseline: float | None = None
    cooldown: int = 0
    require_all: bool = False
    drifts: int = field(default=0, init=False)
    resting: int = field(default=0, init=False)

    def __post_init__(self):
        require(self.required_drifts >= 1 and self.cooldown >= 0, "required_drifts must be at least 1 and cooldown not negative")
        require((self.metric is None) == (self.min_drop is None), "metric and min_drop go together")

    def reset(self) -> None:
        self.drifts = self.resting = 0

    def should_retrain(self, drift: bool, metrics: dict[str, float] | None = None) -> bool:
        """One call a check; events are counted while resting too."""
        self.drifts += bool(drift)
        fired = [self.drifts >= self.required_drifts]
        if self.metric is not None:
            value = (metrics or {}).get(self.metric)
            if value is not None and self.baseline is None:
                self.baseline = value
            fired.append(value is not None and self.baseline - value >= self.min_drop)
        if self.resting > 0:
            self.resting -= 1
            return False
        if not (all(fired) if self.require_all else any(fired)):
            return False
        self.drifts, self.resting = 0, self.cooldown
        return True


def select_sliding(df: DataFrame, order: str, size: int, key: str | None = None) -> DataFrame:
    """The newest `size` rows."""
    return newest(df, order, size, key)


def select_expanding(df: DataFrame, order: str, max_size: int | None = None, key: str | None = None) -> DataFrame:
    """All rows, or the newest max_size."""
    return df if max_size is None else newest(df, order, max_size, key)


def recency_weights(df: DataFrame, order: str, half_life: float, key: str) -> DataFrame:
    """df with weight 0.5^(age / half_life); the newest row of a key has age 0 and weight 1."""
    require(half_life > 0, "half_life must be positive")
    age = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    return df.withColumn("weight", F.pow(F.lit(0.5), age / half_life))


def champion_challenger(df: DataFrame, label: str, champion: str, challenger: str, metric: Callable[[Column, Column], Column] | None = None, higher_is_better: bool = True, min_improvement: float = 0.0) -> DataFrame:
    """champion_score, challenger_score, improvement, promote: promote if the improvement exceeds min_improvement. metric: by default accuracy."""
    score = metric or (lambda y, z: F.avg((y == z).cast("double")))
    rows = df.agg(score(F.col(label), F.col(champion)).alias("champion_score"), score(F.col(label), F.col(challenger)).alias("challenger_score"))
    gain = F.col("challenger_score") - F.col("champion_score")
    return rows.withColumn("improvement", gain if higher_is_better else -gain).withColumn("promote", F.col("improvement") > min_improvement)
