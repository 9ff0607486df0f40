"""Stream monitoring with Structured Streaming.

StreamMonitor scores each window of micro-batches against a baseline within foreachBatch. Baselines and the
history of scores are tables in shared storage, named by batch number: a batch that is delivered again after a
failure reads the same state and writes the same files. online() runs sequential detectors by key as a stateful operator.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftspan.errors import require
from driftspan.operators.detectors import Univariate
from driftspan.operators.online import MACHINES, Machine
from driftspan.operators.preprocessing import align
from driftspan.operators.series import numbered

HISTORY = "window long, feature string, score double, drift boolean"


@dataclass
class StreamMonitor:
    """Drift of every batch (or window of window_size batches) against a baseline.

    baseline: fixed; sliding (the last sliding_batches windows, the first baseline goes with the first window); or ewma
    (the size stays: a share ewma_alpha of rows drawn from the window, the rest from the baseline, by seeded hash).
    A drifting window enters the baseline too. schema: strict raises on other columns, ignore drops extra ones,
    drop scores what both have. With adaptive_threshold a feature is judged, from min_samples quiet scores on, by the
    quantile of its own last `history` quiet scores; methods with p-values never adapt.
    """

    spark: SparkSession
    state: str
    detector: Univariate = field(default_factory=lambda: Univariate("psi"))
    schema: str = "strict"
    window_size: int = 1
    baseline: str = "fixed"
    sliding_batches: int = 3
    ewma_alpha: float = 0.2
    seed: int = 42
    adaptive_threshold: bool = False
    quantile: float = 0.95
    history: int = 100
    min_samples: int = 20
    sinks: list = field(default_factory=list)
    on_drift: Callable[[dict], None] | None = None

    def __post_init__(self):
        require(self.schema in ("strict", "ignore", "drop"), "schema must be strict, ignore or drop")
        require(self.baseline in ("fixed", "sliding", "ewma"), "baseline must be fixed, sliding or ewma")
        require(self.window_size >= 1 and self.sliding_batches >= 1 and 0 < self.ewma_alpha <= 1, "sizes must be positive and ewma_alpha lie in (0, 1]")
        self.state = self.state.rstrip("/")

    def set_baseline(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.state}/baseline/-1")

    def _read(self, what: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.state}/{what}/{number}")

    def _baseline(self, window: int) -> DataFrame:
        """What window `window` is compared with."""
        if self.baseline == "fixed" or window == 0:
            return self._read("baseline", -1)
        if self.baseline == "ewma":
            return self._read("baseline", window - 1)
        first, *rest = [self._read("windows", i) for i in range(max(0, window - self.sliding_batches), window)]
        for df in rest:
            first = first.unionByName(df)
        return first

    def compare(self, df: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
        """Result rows of df against the baseline; no state changes."""
        base = self._read("baseline", -1) if baseline is None else baseline
        policy = {"strict": "strict", "ignore": "ignore", "drop": "align_intersection"}[self.schema]
        base, df = align(base, df, policy)
        return self.detector.fit(base).detect_features(df)

    def _judged(self, rows: DataFrame, window: int) -> DataFrame:
        if not self.adaptive_threshold or window == 0 or self.detector.threshold is None:
            return rows
        quiet = self._read("quiet", window - 1)
        limits = quiet.groupBy("feature").agg(F.percentile("score", F.lit(self.quantile)).alias("adapted"), F.count("*").alias("k")).where(F.col("k") >= self.min_samples)
        joined = rows.join(limits.select("feature", "adapted"), "feature", "left").withColumn("threshold", F.coalesce("adapted", "threshold")).drop("adapted")
        return joined.withColumn("drift", F.col("score") > F.col("threshold"))

    def process(self, df: DataFrame, window: int) -> list[dict]:
        """Scores one window and moves the baseline. Calling it again for the same window gives and writes the same."""
        base = self._baseline(window)
        rows = self._judged(self.compare(df, base), window)
        found = [r.asDict() for r in rows.orderBy("feature").collect()]  # a row a column
        scores = [(window, r["feature"], r["score"], r["drift"]) for r in found]
        own = self.spark.createDataFrame(scores, HISTORY).coalesce(1)
        own.write.mode("overwrite").parquet(f"{self.state}/scores/{window}")
        if self.adaptive_threshold:
            self._remember(own, window)
        if self.baseline == "sliding":
            df.write.mode("overwrite").parquet(f"{self.state}/windows/{window}")
        elif self.baseline == "ewma":
            self._mix(base, df, window).write.mode("overwrite").parquet(f"{self.state}/baseline/{window}")
        if any(r["drift"] for r in found):
            result = {r["feature"]: r for r in found}
            for receive in [*([self.on_drift] if self.on_drift else []), *(s.send for s in self.sinks)]:
                receive(result)
        return found

    def _remember(self, own: DataFrame, window: int) -> None:
        """The last `history` quiet scores of each feature up to this window, from those up to the one before."""
        quiet = own.where("not drift")
        if window > 0:
            quiet = self._read("quiet", window - 1).unionByName(quiet)
        newest = Window.partitionBy("feature").orderBy(F.desc("window"))
        kept = quiet.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= self.history).drop("age")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.state}/quiet/{window}")

    def _mix(self, base: DataFrame, df: DataFrame, window: int) -> DataFrame:
        size, fresh = base.count(), df.count()
        wanted = min(round(size * self.ewma_alpha), fresh) if fresh else 0

        def draw(x: DataFrame, n: int) -> DataFrame:
            """The n rows of least hash, selected by their numbers: no task takes them all."""
            marked = x.withColumn("__h", F.xxhash64(*x.columns, F.lit(self.seed + window)))
            return numbered(marked, "__h", (), x.columns).where(F.col("position") <= n).select(*x.columns)

        return draw(base, size - wanted).unionByName(draw(df, wanted).select(*base.columns))

    def run(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the stream; window_size batches make a window, a trailing part is scored by flush()."""

        def each(batch: DataFrame, number: int) -> None:
            if self.window_size == 1:
                self.process(batch, number)
                return
            batch.write.mode("overwrite").parquet(f"{self.state}/parts/{number}")
            if (number + 1) % self.window_size == 0:
                self.process(self._parts(number // self.window_size), number // self.window_size)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _parts(self, window: int) -> DataFrame:
        first = window * self.window_size
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.state).getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [p for i in range(first, first + self.window_size) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p := f"{self.state}/parts/{i}"))]
        return self.spark.read.parquet(*paths)

    def flush(self, batches: int) -> list[dict]:
        """Scores the trailing batches, fewer than window_size, after `batches` of them; nothing if there are none."""
        return self.process(self._parts(batches // self.window_size), batches // self.window_size) if batches % self.window_size else []

    def scores(self) -> DataFrame:
        return self.spark.read.schema(HISTORY).parquet(f"{self.state}/scores/*")


def online(stream: DataFrame, detector: str, value: str, order: str, key: str, **parameters) -> DataFrame:
    """(key, order, value, score, drift) of a stream by a sequential detector, its state kept by key across batches.

    Rows of a micro-batch are taken in order; across batches arrival is the order.
    """
    make: type[Machine] = MACHINES[detector]
    make(**parameters)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        machine = make(**parameters)
        if state.exists:
            machine.state = json.loads(state.get[0])
        rows = pd.concat(list(batches)).sort_values(order)
        out = [machine.step(x) for x in rows[value]]
        state.update((json.dumps(machine.state),))
        yield pd.DataFrame({key: rows[key], order: rows[order], value: rows[value], "score": [o[0] for o in out], "drift": [o[3] for o in out]})

    chosen = stream.select(key, order, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` double, score double, drift boolean"
    return chosen.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)
