"""Numbered series, windowed monitors, keyed permutations, the batched classifier test and class reports, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspan.errors import ValidationError
from driftspan.operators import changepoint, detectors, efficacy, monitoring, multivariate, online, sketches
from driftspan.operators.pairs import pairs
from driftspan.operators.permuted import permuted
from driftspan.operators.series import numbered


def test_numbered_series(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(300) if i % 9 else None, i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t long, i long").repartition(6)
    got = numbered(df, "t", ["k"], ["i"], slices=5).collect()
    for k in ("a", "b", None):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        assert [(r.t, r.i) for r in own] == sorted(((r.t, r.i) for r in own), key=lambda x: (x[0] is not None, x))
    assert len(got) == len(rows) and max(Counter(r.slice for r in got).values()) < 500
    assert numbered(df.limit(0), "t").collect() == []


@pytest.mark.parametrize("slices", [2, 7])
def test_sliced_detectors_equal_machines(spark, slices):
    """One series holds most rows; slices cut it anywhere. The null key is a series, one is shorter than the warm-up."""
    rng = np.random.default_rng(slices)
    series = {"a": np.concatenate([rng.normal(0, 1, 400), rng.normal(1.5, 1, 200)]), None: rng.normal(0, 1, 90), "c": rng.normal(0, 1, 12)}
    rows = [(k, i, float(x)) for k, own in series.items() for i, x in enumerate(own)] + [("a", 9999, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        chart = online.ewma(df, "v", "i", "k", control_limit=2.0).collect()
        sums = online.cusum(df, "v", "i", "k", 0.0, 0.2, 1e9).collect()
        hinkley = online.page_hinkley(df, "v", "i", "k", 0.01, 1e9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for rows_, machine in ((chart, lambda: online.Ewma(control_limit=2.0)), (sums, lambda: online.Cusum(0.0, 0.2, 1e9)), (hinkley, lambda: online.PageHinkley(0.01, 1e9))):
        for k, own in series.items():
            m, got = machine(), sorted((r for r in rows_ if r.k == k), key=lambda r: r.n)
            assert [r.n for r in got] == list(range(1, len(own) + 1))
            for r, x in zip(got, own, strict=True):
                score, limit, _, drift = m.step(x)
                assert abs(r.score - score) < 1e-8 and r.drift == drift and (limit is None) == (r.threshold is None)


@pytest.mark.parametrize("slices", [2, 6])
def test_segments_of_sliced_series(spark, slices):
    rng = np.random.default_rng(slices)
    series = {"a": np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 200), (4, 90), (-3, 3), (1, 150), (1.2, 60))]), None: rng.normal(0, 1, 50), "c": np.ones(3)}
    rows = [(k, i, float(x)) for k, own in series.items() for i, x in enumerate(own)] + [("a", 7, None)]
    df = spark.createDataFrame(rows, "x string, k long, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        got = changepoint.binary_segments(df, "v", "k", "x", 12.0, 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = {(k, p): s for k, own in series.items() for p, s in changepoint.binary_segmentation(own, 12.0, 2)}
    assert {(r.x, r.change_point) for r in got} == set(expected) and len(got) == len(expected) >= 3
    assert all(abs(r.score - expected[r.x, r.change_point]) < 1e-6 for r in got)
    assert changepoint.binary_segments(df.limit(0), "v", "k", "x", 12.0).collect() == []


def test_weighted_median_by_running_counts(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 60):
        rows = [(rng.choice([0.5, 1.0, 2.0, 7.0, rng.random()]), rng.randrange(1, 6)) for _ in range(n)]
        df = spark.createDataFrame(rows, "v double, w long")
        assert abs(detectors._weighted_median(df, F.col("v")).first()[0] - np.median([v for v, w in rows for _ in range(w)])) < 1e-12
    assert detectors._weighted_median(df.limit(0), F.col("v")).first()[0] is None


def test_rollup_equals_each_cohort(spark):
    rng = random.Random(2)
    sides = [spark.createDataFrame([(rng.choice(["u", "v", None]), rng.randrange(2), rng.gauss(s, 1)) for _ in range(300)], "k string, j int, x double").repartition(3) for s in (0, 1)]
    for method in ("psi", "ks", "energy"):
        got = {(r.level, r.k, r.j): (r.statistic, r.n, r.m) for r in detectors.rollup(*sides, method, ["k", "j"], ["x"]).collect()}
        assert len(got) == 1 + 3 + 6
        for (level, k, j), seen in got.items():
            where = F.lit(True) & (F.col("k").eqNullSafe(k) if level > 0 else F.lit(True)) & (F.col("j").eqNullSafe(j) if level > 1 else F.lit(True))
            if (level, k, j) in ((0, None, None), (1, None, None), (2, "u", 1)):
                one = detectors.statistics(*(df.where(where) for df in sides), method, ["x"]).first()
                assert (one.n, one.m) == seen[1:] and abs(one.statistic - seen[0]) < 1e-9


def plain_metrics(rows):
    y, z, s = zip(*rows, strict=True)
    out, classes = {"accuracy": np.mean([a == b for a, b in zip(y, z, strict=True)])}, sorted({*y, *z})
    p, q, f = [], [], []
    for c in classes:
        tp, ac, sa = sum(a == b == c for a, b in zip(y, z, strict=True)), y.count(c), z.count(c)
        p.append(tp / sa if sa else 0)
        q.append(tp / ac if ac else 0)
        f.append(2 * tp / (ac + sa))
    out |= {"precision": np.mean(p), "recall": np.mean(q), "f1": np.mean(f), "auc": None}
    if len(set(y)) == 2 and None not in s:
        high = [v for v, c in zip(s, y, strict=True) if c == max(y)]
        low = [v for v, c in zip(s, y, strict=True) if c != max(y)]
        out["auc"] = np.mean([(a > b) + (a == b) / 2 for a in high for b in low])
    return out


@pytest.mark.parametrize(("window", "block", "words"), [(7, 7, False), (25, 40, True), (200, None, False)])
def test_performance_monitor_by_brute_force(spark, window, block, words):
    rng = random.Random(window)
    series = {}
    for k, n in (("x", 150), ("y", 90), ("z", 5)):
        name = (lambda c: f"c{c}") if words else int
        series[k] = [(name(rng.randrange(2 if i < 60 else 3)), name(rng.randrange(2)), rng.randrange(6) / 5 if i != 40 else None) for i in range(n)]
    rows = [(k, i * 10, *r) for k, own in series.items() for i, r in enumerate(own)] + [("x", 333, None, None, 0.5)]
    kind = "string" if words else "int"
    df = spark.createDataFrame(rows, f"k string, t long, y {kind}, z {kind}, s double").repartition(5)
    metrics = ["accuracy", "precision", "recall", "f1", "auc"]
    got = monitoring.performance_monitor(df, "y", "z", "t", ["k"], window, metrics, "s", block=block).collect()
    assert len(got) == 245
    plain = {(k, i): plain_metrics(own[max(0, i + 1 - window) : i + 1]) for k, own in series.items() for i in range(len(own))}
    for r in got:
        expected = plain[r.k, r.t // 10]
        assert r.position == r.t // 10 + 1 and r.n == min(r.position, window)
        for m in metrics:
            assert (r[m] is None) == (expected[m] is None) and (r[m] is None or abs(r[m] - expected[m]) < 1e-9)
        first = plain.get((r.k, window - 1), dict.fromkeys(metrics)) if len(series[r.k]) >= window else dict.fromkeys(metrics)
        worse = [m for m in metrics if r.position >= window and None not in (first[m], expected[m]) and first[m] - expected[m] > 0.05]
        assert r.degraded == worse and r.drift == bool(worse)


def test_performance_monitor_as_described(spark):
    frame = lambda rows, kinds="t long, y double, z double": spark.createDataFrame(rows, kinds)
    flips = [(i, float(i % 2), float((i + (i < 40)) % 2)) for i in range(100)]
    last = monitoring.performance_monitor(frame(flips), "y", "z", "t", window=100, metrics=["accuracy"], reference={"accuracy": 0.95}).where("position = 100").first()
    assert last.drift and last.degraded == ["accuracy"] and last.change > 0.05 and abs(last.accuracy - 0.6) < 1e-12
    perfect = monitoring.performance_monitor(frame([(i, float(i % 2), float(i % 2)) for i in range(50)]), "y", "z", "t", window=50, metrics=["accuracy"]).where("position = 50").first()
    assert perfect.reference_accuracy == 1.0 and not perfect.drift
    rng = np.random.default_rng(2)
    noisy = [(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.normal(0, 1, 100), rng.normal(0, 1, 100), strict=True))]
    rows = monitoring.performance_monitor(frame(noisy), "y", "z", "t", window=100, metrics=["mae", "rmse"], reference={"mae": 0.1}, task="regression").where("position = 100").first()
    gaps = np.array([b - a for _, a, b in noisy])
    assert rows.drift and rows.degraded == ["mae"] and abs(rows.mae - np.abs(gaps).mean()) < 1e-9 and abs(rows.rmse - np.sqrt((gaps**2).mean())) < 1e-9
    late = monitoring.delayed_labels(spark.createDataFrame([("k", i, 1) for i in range(6)], "k string, p long, z int"), spark.createDataFrame([("k", i, 0) for i in range(4)], "k string, a long, y int"), "p", "a", "k")
    seen = monitoring.performance_monitor(late, "y", "z", "a", ["k"], 10, ["accuracy"], reference={"accuracy": 1.0})
    assert seen.count() == 4 and seen.where("drift and accuracy = 0").count() == 4 and late.where("y is null").count() == 2
    for wrong in ({"metrics": ["mae"]}, {"window": 0}, {"task": "ranking"}):
        with pytest.raises(ValidationError):
            monitoring.performance_monitor(frame(flips), "y", "z", "t", **wrong)


@pytest.mark.parametrize(("metric", "bins"), [("ece", 10), ("ece", 3), ("brier", 10)])
def test_calibration_monitor_by_brute_force(spark, metric, bins):
    rng = random.Random(3)
    rows = [(i, float(rng.random() < 0.4), rng.choice([0.0, 1.0, 0.3, rng.random()])) for i in range(120)]
    df = spark.createDataFrame(rows, "t long, y double, p double").repartition(4)
    got = {r.t: r for r in monitoring.calibration_monitor(df, "y", "p", "t", window=30, metric=metric, bins=bins, block=35).collect()}

    def plain(own):
        if metric == "brier":
            return np.mean([(p - y) ** 2 for _, y, p in own])
        number = lambda p: max(1, int(np.ceil(p * bins)))
        return sum(abs(sum(y - p for _, y, p in own if number(p) == b)) for b in range(1, bins + 1)) / len(own)

    for i in range(120):
        value = plain(rows[max(0, i - 29) : i + 1])
        assert abs(got[i][metric] - value) < 1e-9
        assert got[i].drift == (i >= 29 and value - plain(rows[:30]) > 0.05)


@pytest.mark.parametrize("total", [1, 2, 3, 10, 1000, 4097])
def test_permutations_are_permutations(total):
    seen = [permuted(np.arange(total), total, 7, i) for i in range(3)]
    assert all(sorted(p.tolist()) == list(range(total)) for p in seen)
    assert np.array_equal(permuted(np.array([0, total - 1]), total, 7, 1), seen[1][[0, total - 1]])
    assert total < 10 or not np.array_equal(seen[0], seen[1])


def test_permutations_are_even():
    """Where 6000 permutations of 12 put three places: each cell within five standard deviations."""
    found = np.stack([permuted(np.arange(3), 12, 1, i) for i in range(6000)])
    for place in range(3):
        counts = np.bincount(found[:, place], minlength=12)
        assert np.abs(counts - 500).max() < 5 * np.sqrt(500 * 11 / 12)
    pairs_ = np.bincount(found[:, 0] * 12 + found[:, 1], minlength=144).reshape(12, 12)
    assert np.trace(pairs_) == 0 and np.abs(pairs_[~np.eye(12, dtype=bool)] - 6000 / 132).max() < 6 * np.sqrt(6000 / 132)


def plain_fit(x, y, penalty=1.0):
    d = np.hstack([x, np.ones((len(x), 1))])
    free, w = np.append(np.ones(x.shape[1]), 0), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.inv((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty * free) + 1e-12 * np.eye(len(w))) @ (d.T @ (p - y) + penalty * free * w)
    return w


def test_classifier_test_fits_each_permutation(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(0, 1, (70, 3)), rng.normal(0.8, 1.5, (41, 3))]
    x[0][:5] = x[0][5]  # equal rows
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in v] + [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "a double, b double, c double").repartition(3) for v in x]
    numbers = multivariate._numbered_rows(*frames, [multivariate._vector(f, ["a", "b", "c"]) for f in frames], 42, ["side"]).toPandas()
    deal = multivariate._Deal((70, 41), (21, 12), 25, 42)
    label, held = deal.parts(numbers["side"].to_numpy(), numbers["position"].to_numpy())
    assert (label[:, 0] == numbers["side"].to_numpy()).all() and len(numbers) == 111
    assert (label.sum(0) == 41).all() and ((held & label).sum(0) == 12).all() and ((held & ~label).sum(0) == 21).all()
    assert len({label[:, i].tobytes() for i in range(26)}) == 26
    data = np.stack(numbers["x"])
    expected = []
    for i in range(26):
        w = plain_fit(data[~held[:, i]], label[~held[:, i], i])
        s, y = data[held[:, i]] @ w[:-1] + w[-1], label[held[:, i], i]
        expected.append(np.mean([(a > b) + (a == b) / 2 for a in s[y] for b in s[~y]]))
    got = multivariate.classifier_test(*frames, ["a", "b", "c"], permutations=25).first()
    assert abs(got.statistic - expected[0]) < 1e-3 and abs(got.threshold - np.quantile(expected[1:], 0.95)) < 2e-3
    assert abs(got.p_value - (1 + sum(e >= expected[0] for e in expected[1:])) / 26) < 0.05 and got.n_permutations == 25


def test_two_sample_labels_by_block(spark):
    """The same test in blocks of any size, and against a plain statistic."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (40, 2)), rng.normal(1, 1, (30, 2))
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in v], "a double, b double").repartition(3) for v in (x, y)]
    rows = [multivariate.two_sample_test(*frames, "energy", permutations=50, block=b).first() for b in (7, 64, 2048)]
    far = lambda a, b: np.mean(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)))
    assert all(abs(r.statistic - (2 * far(x, y) - far(x, x) - far(y, y))) < 1e-9 for r in rows)
    assert len({round(r.threshold, 9) for r in rows}) == 1 and rows[0].drift and rows[0].p_value < 0.05


def test_class_report_rows(spark):
    rng = random.Random(6)
    rows = [(s, rng.choice("abc"), rng.choice("abcd")) for s in ("reference", "current") for _ in range(90)]
    df = spark.createDataFrame(rows, "side string, y string, z string")
    got = {(r.side, r["class"]): r for r in efficacy.class_report(df, "side", ["reference", "current"], "y", "z").collect()}
    assert {k[1] for k in got} == {"a", "b", "c", "d", efficacy.MICRO, efficacy.MACRO, efficacy.WEIGHTED}
    for side in ("reference", "current"):
        own = [(y, z) for s, y, z in rows if s == side]
        for c in "abcd":
            tp, fp, fn = sum(y == z == c for y, z in own), sum(z == c != y for y, z in own), sum(y == c != z for y, z in own)
            r = got[side, c]
            assert (r.tp, r.fp, r.fn, r.tn, r.n) == (tp, fp, fn, 90 - tp - fp - fn, tp + fn)
            assert abs(r.f1 - 2 * tp / max(1, 2 * tp + fp + fn)) < 1e-12 and r.score_auc is None
        assert abs(got[side, efficacy.MICRO].accuracy - sum(y == z for y, z in own) / 90) < 1e-12
        weights = Counter(y for y, _ in own)
        assert abs(got[side, efficacy.WEIGHTED].recall - sum(got[side, c].recall * weights[c] for c in "abc") / 90) < 1e-12
    two = efficacy.class_report(df.where("y < 'c' and z < 'c'"), "side", ["reference", "current"], "y", "z").collect()
    assert len(two) == 2 and {r["class"] for r in two} == {"b"}


def test_evaluate_classes(spark):
    rng = random.Random(8)
    rows = [(float(k), rng.gauss(3 * k, 1), "abc"[k]) for k in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "u double, x double, y string")
    got = {(r.trained_on, r["class"]): r for r in efficacy.evaluate_classes(df, df, "y", ["y"], ["x"], trees=5).collect()}
    assert len(got) == 12 and all(r.score_auc > 0.8 and r.roc_auc > 0.7 and r.accuracy > 0.7 for r in got.values())
    summary = {(r.trained_on, r.metric): r.value for r in efficacy.evaluate(df, df, "y", ["y"], ["x"], trees=5).collect()}
    assert abs(summary["current", "accuracy"] - got["current", efficacy.MICRO].accuracy) < 1e-9
    with pytest.raises(ValidationError):
        efficacy.evaluate_classes(df, df, "x", ["y"], ["x"])


def _exchanges(spark, df):
    """(partitioning, rows written) of each shuffle that ran."""
    df.collect()
    found, walk = [], [df._jdf.queryExecution().executedPlan()]
    while walk:
        node = walk.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            walk.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            found.append((node.outputPartitioning().toString(), node.metrics().apply("shuffleRecordsWritten").value()))
        children = node.children()
        walk += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("strategy", ["quantile", "kll", "approx", "uniform"])
def test_no_raw_rows_meet_on_their_feature(spark, strategy):
    """Only what is bounded by slices, bins and tasks is dealt by feature; rows are dealt by (feature, value) or slice at most."""
    from driftspan.operators.distances import binned, cdf_statistics

    n = 1_000_000
    sides = [spark.range(0, n, 1, 8).select((F.rand(s) * 10).alias("x")) for s in (1, 2)]
    for df in (binned(pairs(*sides), strategy=strategy), *([cdf_statistics(pairs(*sides))] if strategy == "quantile" else [])):
        by_feature = [rows for how, rows in _exchanges(spark, df) if how.startswith("hashpartitioning(feature#") and how.count("#") == 1]
        assert by_feature and max(by_feature) < 2000, by_feature


def test_sketches_merge_over_any_range(spark):
    """Ranks of merged sketches, kept in parts, against exact ranks; ties and one constant feature."""
    rng = np.random.default_rng(9)
    rows = [("x", round(float(rng.normal(d, 2)), 1), d) for d in range(8) for _ in range(1500)] + [("one", 3.0, d) for d in range(8)] + [("x", None, 1)]
    df = spark.createDataFrame(rows, "feature string, v double, d int").repartition(6)
    kept = sketches.sketch_chunks(df.where("v < 3 or v is null"), "d", 200).unionByName(sketches.sketch_chunks(df.where("v >= 3"), "d", 200))
    for first, last in ((None, None), (2, 5), (7, None)):
        whole = sketches.merged(kept, first, last)
        own = df.where(f"d between {first or 0} and {7 if last is None else last}")
        assert {r.feature: r.n for r in whole.collect()} == {r.feature: r["count"] for r in own.where("v is not null").groupBy("feature").count().collect()}
        errors = sketches.rank_errors(sketches.sketch_quantiles(whole, [0, 0.1, 0.5, 0.9, 1]), own).collect()
        assert len(errors) == 10 and max(r.error for r in errors) <= sketches.rank_bound(200)
    edges = {r.feature: r.edges for r in sketches.sketch_edges(sketches.merged(kept), 4).collect()}
    assert edges["one"] == [3.0, 4.0] and len(edges["x"]) == 5
    assert sketches.merged(kept, 100).collect() == []
