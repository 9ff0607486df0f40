"""Train the same model on two samples and compare it on one test set."""

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.operators.monitoring import aucs, classification_metrics


def _count_encoded(df: DataFrame, columns: Sequence[str], counts: dict[str, DataFrame]) -> DataFrame:
    for c in columns:
        df = df.join(counts[c], c, "left").drop(c).withColumn(f"{c}__count", F.coalesce(f"{c}__count", F.lit(0)))
    return df


def _scored(reference: DataFrame, current: DataFrame, target: str, categorical: Sequence[str], numeric: Sequence[str], test: DataFrame | None, one_hot_cutoff: int, train_share: float, seed: int, trees: int) -> tuple[dict[str, DataFrame], list[str]]:
    """The test rows as the forest trained on either sample sees them, and the classes of a categorical target."""
    require(target in [*categorical, *numeric] and 0 < train_share < 1, "target must be a listed column, train_share between 0 and 1")
    features = [c for c in numeric if c != target]
    sorts = [c for c in categorical if c != target]
    used = [*features, *sorts, target]
    held = F.pmod(F.xxhash64(*used, F.lit(seed)), F.lit(1000)) >= int(1000 * train_share)
    sides = {"reference": reference.select(*used).na.drop(), "current": current.select(*used).na.drop()}
    if test is None:
        test, sides["current"] = sides["current"].where(held), sides["current"].where(~held)
    else:
        test = test.select(*used).na.drop()
    union = sides["reference"].unionByName(sides["current"])
    kinds = union.agg(*(F.count_distinct(c).alias(c) for c in sorts)).first() if sorts else {}
    hot = [c for c in sorts if kinds[c] <= one_hot_cutoff]
    many = [c for c in sorts if c not in hot]
    counts = {c: union.groupBy(c).agg(F.count("*").alias(f"{c}__count")) for c in many}
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in hot] + [OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v") for c in hot]
    stages.append(VectorAssembler(inputCols=[*features, *(f"{c}__v" for c in hot), *(f"{c}__count" for c in many)], outputCol="features"))
    classes = target in categorical
    labels = StringIndexer(inputCol=target, outputCol="__label", handleInvalid="keep").fit(union) if classes else None
    model = RandomForestClassifier(labelCol="__label", numTrees=trees, seed=seed) if classes else RandomForestRegressor(labelCol=target, numTrees=trees, seed=seed)
    encoders = Pipeline(stages=stages).fit(_count_encoded(union, many, counts))
    prepared = lambda df: (lambda x: labels.transform(x) if labels else x)(encoders.transform(_count_encoded(df, many, counts)))
    return {name: model.fit(prepared(df)).transform(prepared(test)) for name, df in sides.items()}, list(labels.labels) if labels else []


def evaluate(reference: DataFrame, current: DataFrame, target: str, categorical: Sequence[str], numeric: Sequence[str], test: DataFrame | None = None, one_hot_cutoff: int = 5, train_share: float = 0.7, seed: int = 42, trees: int = 20) -> DataFrame:
    """(trained_on, metric, value) of a random forest trained on either sample.

    Categories of at most one_hot_cutoff values are one-hot encoded, others counted. Without a test set, rows of the
    current side that a seeded hash holds out are it; all reference rows train. Rows with nulls take no part, in a
    given test set neither. Numbers as target: rmse, mae, r2, explained variance, mape. By class: see evaluate_classes().
    """
    rows = []
    found_sides, classes = _scored(reference, current, target, categorical, numeric, test, one_hot_cutoff, train_share, seed, trees)
    for name, scored in found_sides.items():
        if classes:
            found = classification_metrics(scored, "__label", "prediction").first().asDict()
        else:
            found = {m: RegressionEvaluator(labelCol=target, metricName=m).evaluate(scored) for m in ("rmse", "mae", "r2", "var")}
            found["mape"] = scored.agg(F.avg(F.abs((F.col(target) - F.col("prediction")) / F.nullif(F.col(target), F.lit(0.0))))).first()[0]
        rows += [(name, m, float(v) if v is not None else None) for m, v in found.items()]
    return reference.sparkSession.createDataFrame(rows, "trained_on string, metric string, value double")


def evaluate_classes(reference: DataFrame, current: DataFrame, target: str, categorical: Sequence[str], numeric: Sequence[str], test: DataFrame | None = None, one_hot_cutoff: int = 5, train_share: float = 0.7, seed: int = 42, trees: int = 20) -> DataFrame:
    """class_report() of a random forest trained on either sample, with the forest's shares as scores. target is categorical."""
    require(target in categorical, "target must be a listed category")
    sides, classes = _scored(reference, current, target, categorical, numeric, test, one_hot_cutoff, train_share, seed, trees)
    named = F.element_at(F.array(*(F.lit(c) for c in classes)), F.least(F.col("prediction") + 1, F.lit(len(classes))).cast("int"))
    rows = [df.select(F.lit(name).alias("trained_on"), F.col(target).cast("string").alias("label"), named.alias("said"), F.slice(vector_to_array("probability"), 1, len(classes)).alias("shares")) for name, df in sides.items()]
    return class_report(rows[0].unionByName(rows[1]), "trained_on", list(sides), "label", "said", "shares", classes)


MICRO, MACRO, WEIGHTED = "_MICRO_AVERAGE", "_MACRO_AVERAGE", "_WEIGHTED_AVERAGE"
_MEANS = ("accuracy", "precision", "recall", "f1", "roc_auc")
_CELLS = ("tn", "fp", "fn", "tp")


def class_report(scored: DataFrame, side: str, sides: Sequence[str], label: str, prediction: str, shares: str | None = None, classes: Sequence[str] = ()) -> DataFrame:
    """(side, class, accuracy, precision, recall, f1, roc_auc, tn, fp, fn, tp, n, score_auc), each class against the rest.

    roc_auc is that of the predictions themselves, score_auc that of a column `shares` of scores in the order of `classes`, null
    without it. With two classes the larger has a row for each side; with more, all have, and micro, macro and weighted averages
    follow: micro adds up the cells first, macro means every class alike, weighted by its rows n. Shares of nothing are 0, an AUC without
    rows of both kinds is null. All counts come from one cube of (side, label, prediction), all score_auc from one relation
    of running counts.
    """
    cube = scored.groupBy(F.col(side).alias("side"), F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("z")).agg(F.count("*").alias("k"))
    told = F.array(F.struct(F.col("y").alias("class"), F.col("k").alias("actual"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("z"), F.col("k")).otherwise(0).alias("hit")), F.struct(F.col("z").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("k").alias("said"), F.lit(0).cast("long").alias("hit")))
    cells = cube.select("side", F.explode(told).alias("c")).groupBy("side", "c.class").agg(F.sum("c.actual").alias("n"), F.sum("c.said").alias("said"), F.sum("c.hit").alias("tp"))
    every = cells.select("class").distinct().select("class", F.explode(F.array(*(F.lit(s) for s in sides))).alias("side"))
    cells = every.join(cells, ["side", "class"], "left").na.fill(0, ["n", "said", "tp"])
    whole = Window.partitionBy("side")
    cells = cells.withColumns({"total": F.sum("n").over(whole), "kinds": F.count("*").over(whole), "last": F.max("class").over(whole)})
    cells = cells.withColumns({"fp": F.col("said") - F.col("tp"), "fn": F.col("n") - F.col("tp")}).withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    ratio = lambda a, b, empty=0.0: F.when(b > 0, a / b).otherwise(empty)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    single = {"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "roc_auc": (ratio(tp, tp + fn, None) + ratio(tn, tn + fp, None)) / 2}
    rows = cells.withColumns(single)
    if shares:
        pairs = F.array(*(F.struct(F.lit(c).alias("class"), F.col(shares)[i].alias("v"), (F.col(label).cast("string") == c).cast("double").alias("r")) for i, c in enumerate(classes)))
        pairs = F.concat(pairs, F.transform(pairs, lambda x: F.struct(F.lit(MICRO).alias("class"), x["v"].alias("v"), x["r"].alias("r"))))
        long = scored.select(F.col(side).alias("side"), F.explode(pairs).alias("x")).select("side", F.col("x.class").alias("feature"), "x.v", "x.r", (1 - F.col("x.r")).alias("c"))
        scores = aucs(long, ["side"]).select("side", F.col("feature").alias("class"), F.col("auc").alias("score_auc"))
    else:
        scores = rows.select("side", "class", F.lit(None).cast("double").alias("score_auc")).limit(0)
    rows = rows.join(scores, ["side", "class"], "left")
    sums = [F.sum(c).alias(c) for c in _CELLS]
    more = rows.where("kinds > 2")
    micro = more.groupBy("side").agg(*sums, F.max("total").alias("n")).withColumns(single).withColumn("accuracy", F.col("recall")).withColumn("class", F.lit(MICRO)).join(scores, ["side", "class"], "left")
    macro = more.groupBy("side").agg(F.lit(MACRO).alias("class"), *sums, F.max("total").alias("n"), *(F.avg(c).alias(c) for c in (*_MEANS, "score_auc")))
    weighted = more.groupBy("side").agg(F.lit(WEIGHTED).alias("class"), *sums, F.max("total").alias("n"), *((F.sum(F.col(c) * F.col("n")) / F.max("total")).alias(c) for c in (*_MEANS, "score_auc")))
    shown = [F.col("side").alias(side), "class", *_MEANS, *_CELLS, "n", "score_auc"]
    alone = rows.where((F.col("kinds") > 2) | ((F.col("kinds") == 2) & (F.col("class") == F.col("last"))))
    return reduce(DataFrame.unionByName, [x.select(*shown) for x in (alone, micro, macro, weighted)])
