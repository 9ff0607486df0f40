"""Monitors of a model's output: calibration, performance with delayed labels, predictions."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.errors import require
from driftspan.functions.pvalues import chi2_p
from driftspan.operators.distances import binned, chi_square
from driftspan.operators.pairs import pairs, running_counts
from driftspan.operators.series import rolled, windowed

REGRESSION = ("mae", "rmse")
CLASSIFICATION = ("accuracy", "precision", "recall", "f1", "auc")


def check_binary(df: DataFrame, label: str, score: str) -> None:
    """Raises unless labels are 0 or 1 and scores lie between 0 and 1."""
    bad = df.where(F.col(label).isNull() | F.col(score).isNull() | ~F.col(label).isin(0, 1) | (F.col(score) < 0) | (F.col(score) > 1))
    require(bad.isEmpty(), "labels must be 0 or 1 and scores between 0 and 1")


def brier(label: str, score: str) -> Column:
    return F.avg(F.pow(F.col(score) - F.col(label), 2))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., bin, n, accuracy, confidence) of equal bins open below; the first is closed."""
    number = F.greatest(F.lit(1), F.ceil(F.col(score) * bins)).cast("int")
    return df.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("accuracy"), F.avg(score).alias("confidence"))


def expected_calibration_error(df: DataFrame, label: str, score: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., ece)"""
    gaps = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")
    return calibration_bins(df, label, score, bins, keys).groupBy(*keys).agg(gaps.alias("ece"))


def rolling(df: DataFrame, value: Column, order: str, key: str, window: int, min_change: float, reference: float | None = None) -> DataFrame:
    """(key, order, current, reference, drift): the mean of value over the last `window` rows against the first full window.

    Rows before a full window have no drift. value is a loss: higher is worse.
    """
    by = Window.partitionBy(key).orderBy(order)
    last = by.rowsBetween(1 - window, 0)
    rows = df.withColumn("__v", value).select(key, order, F.row_number().over(by).alias("n"), F.avg("__v").over(last).alias("current"))
    first = F.lit(reference) if reference is not None else F.max(F.when(F.col("n") == window, F.col("current"))).over(Window.partitionBy(key))
    rows = rows.withColumn("reference", first)
    return rows.select(key, order, "current", "reference", F.coalesce((F.col("n") >= window) & (F.col("current") > F.col("reference") + min_change), F.lit(False)).alias("drift"))


def delayed_labels(predictions: DataFrame, labels: DataFrame, prediction_order: str, label_order: str, key: str) -> DataFrame:
    """Labels attached to the oldest prediction without one: the n-th label of a key to its n-th prediction; pending ones have null labels."""
    number = lambda df, o: df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(o)))
    return number(predictions, prediction_order).join(number(labels, label_order), [key, "__n"], "left").drop("__n")


def classification_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., accuracy, precision, recall, f1): the last three averaged over the classes of labels and predictions; 0 over 0 is 0."""
    cells = df.groupBy(*keys, F.col(label).alias("y"), F.col(prediction).alias("z")).agg(F.count("*").cast("double").alias("n"))
    sides = F.array(F.struct(F.col("y").cast("string").alias("cls"), F.lit(1).alias("actual"), F.lit(0).alias("said")), F.struct(F.col("z").cast("string").alias("cls"), F.lit(0).alias("actual"), F.lit(1).alias("said")))
    rows = cells.select(*keys, "n", (F.col("y") == F.col("z")).alias("hit"), F.explode(sides).alias("s")).select(*keys, "n", "hit", "s.*")
    per = rows.groupBy(*keys, "cls").agg(F.sum(F.when(F.col("hit"), F.col("n") * F.col("actual")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("actual")).alias("actual"), F.sum(F.col("n") * F.col("said")).alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"p": ratio(F.col("tp"), F.col("said")), "q": ratio(F.col("tp"), F.col("actual")), "f": ratio(2 * F.col("tp"), F.col("actual") + F.col("said"))})
    return per.groupBy(*keys).agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("q").alias("recall"), F.avg("f").alias("f1"))


def aucs(relation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, auc) of rows (keys..., feature, v: score, r: 1 for label 1, c: 1 for label 0), by mid-ranks of distinct
    scores, which no task sorts as a whole; null where a label is missing."""
    wins = F.col("r") * (F.col("cc") - F.col("c") / 2)
    return running_counts(relation, keys).groupBy(*keys, "feature").agg((F.sum(wins) / F.nullif(F.max("n") * F.max("m"), F.lit(0.0))).alias("auc"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc of labels 0 and 1; null where a class is missing."""
    side = lambda x: F.when(F.col(label) == x, 1.0).otherwise(0.0)
    return aucs(df.select(F.lit("score").alias("feature"), F.col(score).cast("double").alias("v"), side(1).alias("r"), side(0).alias("c"))).agg(F.max("auc").alias("auc"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mae, rmse"""
    gap = F.col(label) - F.col(prediction)
    return df.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def degradation(reference: DataFrame, current: DataFrame, metrics: Sequence[str], min_change: float = 0.05) -> DataFrame:
    """(metric, reference, current, change, drift) of two rows of metrics: a fall of a share or a rise of an error by more than min_change."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics))).alias("x")).select("x.*")
    rows = long(reference, "reference").join(long(current, "current"), "metric")
    sign = F.when(F.col("metric").isin(*REGRESSION), 1.0).otherwise(-1.0)
    return rows.withColumn("change", sign * (F.col("current") - F.col("reference"))).withColumn("drift", F.col("change") > min_change)


def _classified(table: pa.Table, window: int) -> dict[str, np.ndarray]:
    """Metrics of the last `window` rows: sums of each class's cells move by the row that comes and the row that goes."""
    y, z, s = (table[c].to_numpy(zero_copy_only=False) for c in ("label", "prediction", "score"))
    classes, codes = np.unique(np.concatenate([y, z]), return_inverse=True)
    y, z = np.split(codes, 2)
    n = np.minimum(np.arange(1, len(y) + 1), window)
    out = {"n": n, "accuracy": rolled(y == z, window) / n}
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    sums, there, labels, squares = np.zeros((3, len(y))), np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))
    for c in range(len(classes)):
        actual, said, hit = (rolled(x, window) for x in (y == c, z == c, (y == c) & (z == c)))
        there += actual + said > 0
        labels += actual > 0
        squares += actual.astype(float) ** 2
        sums += [share(hit, said), share(hit, actual), share(2 * hit, actual + said)]
    out |= dict(zip(("precision", "recall", "f1"), sums / there, strict=True))
    full = (labels == 2) & (rolled(np.isnan(s.astype(float)), window) == 0)
    if not full.any():
        return out | {"auc": np.full(len(y), np.nan)}
    # the larger label's score beats the smaller's: +1, loses: -1, by rank; pairs of one label and ties: 0
    ranks, balance = np.unique(s.astype(float), return_inverse=True)[1], np.zeros(len(y))
    for d in range(1, min(window, len(y))):
        signs = np.concatenate([[0] * d, np.sign((ranks[d:] - ranks[:-d]) * np.sign(y[d:] - y[:-d]))])
        balance += rolled(signs, window - d)
    both = (n.astype(float) ** 2 - squares) / 2
    return out | {"auc": np.where(full, 0.5 + balance / np.maximum(2 * both, 1), np.nan)}


def _regressed(table: pa.Table, window: int) -> dict[str, np.ndarray]:
    gap = (table["label"].to_numpy() - table["prediction"].to_numpy()).astype(float)
    n = np.minimum(np.arange(1, len(gap) + 1), window)
    return {"n": n, "mae": rolled(np.abs(gap), window) / n, "rmse": np.sqrt(np.maximum(rolled(gap * gap, window), 0) / n)}


def _calibrated(bins: int):
    def compute(table: pa.Table, window: int) -> dict[str, np.ndarray]:
        """Of each bin, the sums of labels less confidences move with the window."""
        y, p = table["label"].to_numpy().astype(float), table["score"].to_numpy().astype(float)
        n, number = np.minimum(np.arange(1, len(y) + 1), window), np.maximum(1, np.ceil(p * bins))
        ece = sum(np.abs(rolled(np.where(number == b, y - p, 0.0), window)) for b in np.unique(number)) / n
        return {"n": n, "ece": ece, "brier": rolled((p - y) ** 2, window) / n}

    return compute


def _against_reference(rows: DataFrame, metrics: Sequence[str], order: str, keys: Sequence[str], window: int, reference: dict[str, float] | None, min_change: float) -> DataFrame:
    """rows with reference_<metric>, change (the worst, at least 0), degraded and drift. Without a reference a series' first full window is it."""
    if reference is None:
        first = rows.where(F.col("position") == window).select(*keys, *(F.col(m).alias(f"reference_{m}") for m in metrics))
        rows = rows.join(first, list(keys), "left") if keys else rows.join(F.broadcast(first), F.lit(True), "left")  # without keys, one row
        known = F.col("position") >= window
    else:
        rows, known = rows.withColumns({f"reference_{m}": F.lit(reference.get(m)).cast("double") for m in metrics}), F.lit(True)
    worse = {m: F.when(known, (F.col(m) - F.col(f"reference_{m}")) * (1 if m in (*REGRESSION, "ece", "brier") else -1)) for m in metrics}
    change = F.greatest(F.lit(0.0), *(F.coalesce(w, F.lit(0.0)) for w in worse.values()))
    degraded = F.array_compact(F.array(*(F.when(w > min_change, F.lit(m)) for m, w in worse.items())))
    shown = rows.withColumns({"change": change, "degraded": degraded})
    return shown.select(*keys, order, "position", "n", *metrics, *(f"reference_{m}" for m in metrics), "change", "degraded", (F.size("degraded") > 0).alias("drift"))


def _typed(df: DataFrame, label: str, prediction: str) -> str:
    numbers = all(isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType) for c in (label, prediction))
    return "double" if numbers else "string"


def performance_monitor(df: DataFrame, label: str, prediction: str, order: str, keys: Sequence[str] = (), window: int = 500, metrics: Sequence[str] | None = None, score: str | None = None, reference: dict[str, float] | None = None, min_change: float = 0.05, task: str = "classification", block: int | None = None) -> DataFrame:
    """(keys..., order, position, n, metrics..., reference_..., change, degraded, drift): metrics of the last `window` labelled rows at each.

    classification: accuracy, and precision, recall and f1 averaged over the classes a window has as label or prediction; auc where a
    window has two labels and all its scores, the larger label being the positive one, else null. regression: mae, rmse.
    A metric is degraded if it is worse than the reference by more than min_change; without a reference, a series' first
    full window is it and earlier rows have no drift. Rows without label or prediction wait: they are not in the series.
    For labels that come later see delayed_labels(); order is then that of the labels. A series of any length is dealt
    over tasks in blocks.
    """
    require(task in ("classification", "regression"), "task must be classification or regression")
    allowed = CLASSIFICATION if task == "classification" else REGRESSION
    metrics = list(metrics or (("accuracy", "f1") if task == "classification" else REGRESSION))
    require(set(metrics) <= set(allowed), f"metrics must be among {', '.join(allowed)}")
    kind = _typed(df, label, prediction) if task == "classification" else "double"
    shown = F.col(score).cast("double") if score and "auc" in metrics else F.lit(None).cast("double")
    rows = df.select(*keys, order, F.col(label).cast(kind).alias("label"), F.col(prediction).cast(kind).alias("prediction"), shown.alias("score")).where("label is not null and prediction is not null")
    compute = _classified if task == "classification" else _regressed
    fields = ", ".join(["n long", *(f"{m} double" for m in allowed)])
    found = windowed(rows, order, keys, ["label", "prediction", "score"], window, compute, fields, ("label", "prediction", "score"), block)
    return _against_reference(found, metrics, order, keys, window, reference, min_change)


def calibration_monitor(df: DataFrame, label: str, score: str, order: str, keys: Sequence[str] = (), window: int = 500, metric: str = "ece", reference: float | None = None, min_increase: float = 0.05, bins: int = 10, block: int | None = None) -> DataFrame:
    """(keys..., order, position, n, metric, reference_metric, change, degraded, drift): ece or brier of the last `window` labelled rows at each.

    As performance_monitor(); both metrics are worse the higher they are. Labels are 0 or 1.
    """
    require(metric in ("ece", "brier"), "metric must be ece or brier")
    require(bins >= 1, "bins must be at least 1")
    rows = df.select(*keys, order, F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score")).where("label is not null and score is not null")
    found = windowed(rows, order, keys, ["label", "score"], window, _calibrated(bins), "n long, ece double, brier double", ("label", "score"), block)
    return _against_reference(found, [metric], order, keys, window, None if reference is None else {metric: reference}, min_increase)


def confidence_entropy(proba: Column) -> tuple[Column, Column]:
    """(top share, entropy in nats) of an array of class shares; one number p stands for [1 - p, p]."""
    clipped = F.transform(proba, lambda p: F.least(F.lit(1.0), F.greatest(F.lit(1e-12), p)))
    return F.array_max(proba), F.aggregate(clipped, F.lit(0.0), lambda s, p: s - p * F.ln(p))


def prediction_drift(reference: DataFrame, current: DataFrame, predicted: str, confidence: str | None = None, alpha: float = 0.05, psi_threshold: float = 0.2, bins: int = 10) -> DataFrame:
    """class_p, confidence_psi, drift: chi-square on predicted classes, or PSI of the top-class share."""
    classes = chi_square(pairs(reference, current, [predicted], "string"))
    p = F.when(F.col("df") < 1, 1.0).otherwise(chi2_p(F.col("statistic"), F.col("df")))
    rows = classes.select(F.col("statistic"), F.col("df"), p.alias("class_p"))
    if confidence is None:
        return rows.withColumns({"confidence_psi": F.lit(None).cast("double"), "drift": F.col("class_p") < alpha})
    psi = binned(pairs(reference, current, [confidence]), bins).select(F.col("psi").alias("confidence_psi"))
    return rows.crossJoin(F.broadcast(psi)).withColumn("drift", (F.col("class_p") < alpha) | (F.col("confidence_psi") > psi_threshold))
