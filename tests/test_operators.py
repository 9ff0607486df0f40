import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspan.errors import NotEnoughDataError, NotFittedError, ValidationError
from driftspan.functions.corrections import adjust
from driftspan.operators import adaptation, changepoint, distances, efficacy, legacy, monitoring, multivariate, online, preprocessing, report, windows
from driftspan.operators.binning import bin_edges, histograms
from driftspan.operators.detectors import Ensemble, MixedType, Univariate, combine, datetime_drift, required_votes, statistics
from driftspan.operators.pairs import pairs


def frame(spark, values, name="v", kind="double"):
    values = [float(x) if kind == "double" and x is not None else x for x in values]
    return spark.createDataFrame([(x,) for x in values], f"`{name}` {kind}")


def normal(spark, shift, n=300, seed=0, sd=1.0):
    return frame(spark, (np.random.default_rng(seed).normal(shift, sd, n)).tolist())


def numpy_cdf(a, b):
    grid = np.unique(np.concatenate([a, b]))
    f, g = (np.searchsorted(np.sort(x), grid, "right") / len(x) for x in (a, b))
    gap = np.abs(f - g)
    return gap.max(), (gap[:-1] * np.diff(grid)).sum(), 2 * (gap[:-1] ** 2 * np.diff(grid)).sum()


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("slices", [1, 5])
def test_cdf_statistics(spark, seed, slices):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.normal(0, 1, 60), 1), np.round(rng.normal(0.3, 1, 45), 1)
    row = distances.cdf_statistics(pairs(frame(spark, a.tolist()), frame(spark, b.tolist())), slices=slices).first()
    assert (row["ks"], row["wasserstein"], row["energy"]) == pytest.approx(numpy_cdf(a, b))
    pairwise = lambda x, y: np.abs(x[:, None] - y[None, :]).mean()
    assert row["energy"] == pytest.approx(2 * pairwise(a, b) - pairwise(a, a) - pairwise(b, b))


def test_edges_and_histograms(spark):
    flat = pairs(frame(spark, [1.0] * 5), frame(spark, [1.0, 3.0]))
    assert bin_edges(flat, 4).first()["edges"] == [1.0, 2.0]
    rows = histograms(pairs(frame(spark, [0.0, 1, 2, 3]), frame(spark, [-9.0, 99.0])), bin_edges(pairs(frame(spark, [0.0, 1, 2, 3]), frame(spark, [0.0])), 2)).orderBy("bin").collect()
    assert [(r["p"], r["q"]) for r in rows] == [(0.5, 0.5), (0.5, 0.5)]
    assert sum(r["p"] for r in rows) == pytest.approx(1)


@pytest.mark.parametrize("strategy", ["quantile", "uniform", "approx", "kll"])
def test_psi_is_zero_on_itself_and_grows(spark, strategy):
    base = normal(spark, 0)
    scores = [distances.binned(pairs(base, normal(spark, s)), strategy=strategy).first()["psi"] for s in (0, 0.5, 1.5)]
    assert scores[0] == pytest.approx(0) and scores[0] < scores[1] < scores[2]


def test_null_and_category_policies(spark):
    a = frame(spark, [1.0, None, float("nan"), 2.0])
    assert pairs(a, a).count() == 4
    c = frame(spark, ["x", None, "x"], kind="string")
    assert {r["v"] for r in pairs(c, c, ["v"], "string").collect()} == {"x", "nan"}
    one = frame(spark, ["x"] * 4, kind="string")
    assert statistics(one, one, "chi2", ["v"]).first()["raw_p_value"] == 1.0


def test_corrections(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "k string, p double")
    got = {r["k"]: r["q"] for r in adjust(rows, "p", "bh", "q").collect()}
    assert got["a"] == pytest.approx(0.04) and got["b"] == got["c"] == pytest.approx(0.16 / 3) and got["e"] is None
    assert {r["k"]: r["q"] for r in adjust(rows, "p", "bonferroni", "q").collect()}["d"] == 1.0
    with pytest.raises(ValidationError):
        adjust(rows, "p", "other", "q")


@pytest.mark.parametrize(("method", "shift", "drift"), [("ks", 0.0, False), ("ks", 1.5, True), ("cvm", 1.5, True), ("psi", 2.0, True), ("js", 2.0, True)])
def test_univariate(spark, method, shift, drift):
    row = Univariate(method).fit(normal(spark, 0)).detect(normal(spark, shift, seed=1)).first()
    assert row["drift"] == drift and row["n_features"] == 1


def test_univariate_refuses(spark):
    for bad in ({"method": "x"}, {"alpha": 1.0}, {"method": "wasserstein"}, {"correction": "x"}):
        with pytest.raises(ValidationError):
            Univariate(**bad)
    with pytest.raises(NotFittedError):
        Univariate().detect(normal(spark, 0))


def test_mixed_ensemble_and_votes(spark):
    rng = np.random.default_rng(3)
    made = lambda age, p: spark.createDataFrame([(float(a), str(c), float(i)) for a, c, i in zip(rng.normal(age, 5, 500), rng.choice(["a", "b", "c"], 500, p=p), rng.normal(50, 10, 500), strict=True)], "age double, country string, income double")
    a, b = made(40, [0.5, 0.3, 0.2]), made(46, [0.2, 0.3, 0.5])
    got = {r["feature"]: r["drift"] for r in MixedType().fit(a).detect_features(b).collect()}
    assert got == {"age": True, "country": True, "income": False}
    assert MixedType().fit(a).detect(b).first()["score"] == 2.0
    votes = {r["feature"]: r["drift"] for r in Ensemble(columns=["age", "income"]).detect(a, b).collect()}
    assert votes == {"age": True, "income": False}
    assert [required_votes(m, 4) for m in ("any", "majority", "all", "stacking")] == [1, 3, 4, 0]
    assert combine(MixedType().fit(a).detect_features(b), "majority").first()["drift"]
    with pytest.raises(ValidationError):
        MixedType().fit(a).detect_features(b.select("country", "age", "income"))


def test_datetime(spark):
    stamps = lambda start, step: spark.sql(f"select timestamp'{start}' + make_interval(0,0,0,0,0,cast(id*{step} as int),0) as t from range(200)")
    base = stamps("2024-01-01", 60)
    assert not datetime_drift(base, stamps("2024-02-01", 60), "t").first()["drift"]
    assert datetime_drift(base, stamps("2024-02-01", 5), "t").first()["drift"]


STREAMS = {
    "ddm": (online.Ddm(), lambda r: np.concatenate([r.random(300) < 0.1, r.random(300) < 0.6]).astype(float)),
    "page_hinkley": (online.PageHinkley(), lambda r: np.concatenate([r.normal(0, 0.1, 300), r.normal(1, 0.1, 300)])),
    "cusum": (online.Cusum(), lambda r: np.concatenate([r.normal(0, 0.3, 300), r.normal(3, 0.3, 300)])),
    "kswin": (online.Kswin(), lambda r: np.concatenate([r.normal(0, 1, 300), r.normal(4, 1, 300)])),
    "shewhart": (online.Shewhart(), lambda r: np.concatenate([r.normal(0, 0.1, 300), r.normal(2, 0.1, 30)])),
    "ewma": (online.Ewma(), lambda r: np.concatenate([r.normal(0, 0.1, 300), r.normal(2, 0.1, 30)])),
}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_machines_fire_after_the_change(name):
    machine, make = STREAMS[name]
    alarms = online.run_online(type(machine)(), make(np.random.default_rng(7)))
    assert any(a >= 300 for a in alarms) and sum(a < 300 for a in alarms) <= 15


def test_windows_equal_folds_up_to_the_first_alarm(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(150) < 0.15, rng.random(250) < 0.7]).astype(float)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    forms = {
        online.ddm(df, F.col("v"), "i", "k"): online.Ddm(), online.eddm(df, F.col("v"), "i", "k", 10): online.Eddm(10),
        online.cusum(df, "v", "i", "k", 0.15, 0.1, 3.0): online.Cusum(0.15, 0.1, 3.0), online.page_hinkley(df, "v", "i", "k", 0.005, 8.0): online.PageHinkley(0.005, 8.0),
        online.shewhart(df, "v", "i", "k", 1.5): online.Shewhart(1.5),
    }
    for windowed, machine in forms.items():
        first = online.first_alarm(windowed, "k", "i").first()
        alarms = online.run_online(machine, x)
        assert (first["i"] if first else None) == (alarms[0] if alarms else None)
    folded = online.fold(df, lambda: online.Cusum(0.15, 0.1, 3.0), "v", "i", "k").where("drift").orderBy("i").collect()
    assert [r["i"] for r in folded] == online.run_online(online.Cusum(0.15, 0.1, 3.0), x)


def _best_segmentation(x, penalty):
    n, best = len(x), [-penalty]
    for t in range(1, n + 1):
        best.append(min(best[s] + ((x[s:t] - x[s:t].mean()) ** 2).sum() + penalty for s in range(t)))
    return best[n]


@pytest.mark.parametrize("seed", range(5))
def test_change_points(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 1, 20) for m in (0, 4, -2)])
    cuts = [0, *changepoint.pelt(x, 12.0), len(x)]
    cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 12.0 for a, b in zip(cuts[:-1], cuts[1:], strict=True)) - 12.0
    assert cost == pytest.approx(_best_segmentation(x, 12.0))
    points = [p for p, _ in changepoint.binary_segmentation(x, 30.0)]
    assert len(points) == 2 and abs(points[0] - 20) <= 2 and abs(points[1] - 40) <= 2
    assert changepoint.binary_segmentation(np.ones(3), 1.0) == [] and changepoint.pelt(np.ones(1), 1.0) == []


def test_preprocessing(spark):
    a = spark.createDataFrame([("1", 1.0), ("bad", 2.0), ("3", None)], "x string, y double")
    with pytest.raises(ValidationError):
        preprocessing.coerce_numeric(a, ["x"])
    kept, _ = preprocessing.validate_pair(a, a, "strict", "coerce", "drop_rows", ["x"])
    assert [tuple(r) for r in kept.collect()] == [(1.0, 1.0)]
    with pytest.raises(ValidationError, match="missing"):
        preprocessing.matching_columns(a, a.drop("x"))
    both = preprocessing.align(a, a.withColumn("z", F.lit(1)).drop("y"), "align_intersection")
    assert both[0].columns == both[1].columns == ["x"]
    n = frame(spark, [1.0, 3.0, float("inf")])
    with pytest.raises(ValidationError):
        preprocessing.missing_values(n, n)
    with pytest.raises(NotEnoughDataError):
        preprocessing.missing_values(n, frame(spark, [float("nan")]), "ignore")
    assert preprocessing.from_columnar(spark, [[1, 2], [3, 4]]).columns == ["x0", "x1"]


def test_multivariate(spark):
    rng = np.random.default_rng(1)
    made = lambda shift, seed: spark.createDataFrame(np.random.default_rng(seed).normal(shift, 1, (120, 3)).tolist(), "a double, b double, c double")
    base, same, far = made(0, 1), made(0, 2), made(1.2, 3)
    for method in ("mmd", "energy"):
        assert not multivariate.two_sample_test(base, same, method, permutations=60).first()["drift"]
        assert multivariate.two_sample_test(base, far, method, permutations=60).first()["drift"]
    x, y = (np.array(df.collect(), float) for df in (base.limit(40), far.limit(40)))
    both = multivariate.pair_statistics(base.limit(40), far.limit(40), ["a", "b", "c"], 0.2, block=16).first()
    norm = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1))
    assert both["energy"] == pytest.approx(2 * norm(x, y).mean() - norm(x, x).mean() - norm(y, y).mean())
    k = lambda p, q: np.exp(-0.2 * norm(p, q) ** 2)
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert both["mmd2"] == pytest.approx(off(k(x, x)) + off(k(y, y)) - 2 * k(x, y).mean())
    assert multivariate.wasserstein_test(base, far, "a", 40).first()["drift"]
    row = multivariate.bootstrap_psi(base, far, "a", 50).first()
    assert row["lo"] < row["hi"]
    latent = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 4))
    a = spark.createDataFrame((latent + 0.05 * rng.normal(size=latent.shape)).tolist(), "a double, b double, c double, d double")
    b = spark.createDataFrame((latent + 0.05 * rng.normal(size=latent.shape) + np.array([2, -2, 2, 1])).tolist(), a.schema)
    assert multivariate.PcaReconstruction(a.columns, 2).detect(a, b).first()["drift"]
    assert not multivariate.PcaReconstruction(a.columns, 2).detect(a, a).first()["drift"]
    assert multivariate.classifier_test(base, far, ["a", "b", "c"], 3).first()["statistic"] > 0.8
    with pytest.raises(NotEnoughDataError):
        multivariate.two_sample_test(base.limit(1), far)


def test_monitoring(spark):
    rng = np.random.default_rng(2)
    p = rng.random(3000)
    df = spark.createDataFrame([(float(s), int(u < s)) for s, u in zip(p, rng.random(3000), strict=True)], "p double, y int")
    assert monitoring.expected_calibration_error(df, "y", "p").first()["ece"] < 0.05
    monitoring.check_binary(df, "y", "p")
    with pytest.raises(ValidationError):
        monitoring.check_binary(df.withColumn("p", F.col("p") + 1), "y", "p")
    one = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (2, 2)], "y int, z int")
    row = monitoring.classification_metrics(one, "y", "z").first()
    assert (row["accuracy"], row["recall"]) == pytest.approx((0.75, 2.5 / 3))
    a, b = one.select(F.lit(0.9).alias("accuracy"), F.lit(1.0).alias("mae")).limit(1), one.select(F.lit(0.7).alias("accuracy"), F.lit(0.9).alias("mae")).limit(1)
    assert {r["metric"]: r["drift"] for r in monitoring.degradation(a, b, ["accuracy", "mae"]).collect()} == {"accuracy": True, "mae": False}


def test_adaptation_and_windows(spark):
    t = adaptation.Trigger(2, cooldown=1)
    assert [t.should_retrain(d) for d in (True, True, True, True, True)] == [False, True, False, True, False]
    m = adaptation.Trigger(99, "acc", 0.1)
    assert [m.should_retrain(False, {"acc": x}) for x in (0.9, 0.85, 0.79)] == [False, False, True]
    df = spark.createDataFrame([(i,) for i in range(10)], "t long")
    assert sorted(r["t"] for r in windows.newest(df, "t", 3).collect()) == [7, 8, 9]
    with pytest.raises(ValidationError):
        windows.sliding("t", "k", 0)


def test_efficacy(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), "x" if a > 0 else "y", float(2 * a + e)) for a, e in zip(rng.normal(size=120), rng.normal(0, 0.1, 120), strict=True)]
    df = spark.createDataFrame(rows, "a double, c string, t double")
    got = {(r["trained_on"], r["metric"]): r["value"] for r in efficacy.evaluate(df, df, "t", ["c"], ["a", "t"], trees=5).collect()}
    assert got[("reference", "r2")] > 0.6 and ("current", "mape") in got
    got = {(r["trained_on"], r["metric"]): r["value"] for r in efficacy.evaluate(df, df, "c", ["c"], ["a"], trees=5).collect()}
    assert got[("current", "accuracy")] > 0.9


def test_legacy_numeric_edges(spark):
    assert legacy.numeric_metrics(frame(spark, [1.0]), frame(spark, [1.0, 2.0]), ["v"]).count() == 0
    assert np.isnan(legacy.numeric_metrics(frame(spark, [1.0, 1.0]), frame(spark, [1.0, 2.0]), ["v"]).first()["js_distance"])


def test_report(spark):
    rows = Univariate("psi").fit(normal(spark, 0)).detect_features(normal(spark, 2))
    assert report.to_dict(rows)["max_severity"] == "high"
    assert "| v | psi | yes | high |" in report.to_markdown(rows) and "<table>" in report.to_html(rows)
    heard = []
    report.notify(rows, type("Sink", (), {"send": lambda self, x: heard.append(x)})())
    assert heard[0]["v"]["severity"] == "high"
    assert report.plot_shares(frame(spark, ["a", "b"], kind="string"), frame(spark, ["a"], kind="string"), "v").count() == 2
    assert report.plot_quantiles(normal(spark, 0), normal(spark, 1), "v", 10).count() == 11


def test_two_sample_test_sees_all_rows(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2100, 2)), rng.normal(0.1, 1, (2050, 2))
    sides = [spark.createDataFrame(v.tolist(), "a double, b double") for v in (x, y)]
    z = np.vstack([x, y])
    d2 = ((z[:, None] - z[None]) ** 2).sum(-1)
    xx, xy, yy = d2[:2100, :2100], d2[:2100, 2100:], d2[2100:, 2100:]
    energy = 2 * np.sqrt(xy).mean() - np.sqrt(xx).mean() - np.sqrt(yy).mean()
    upper = d2[np.triu_indices(len(d2), 1)]
    k = lambda m: np.exp(-m / (2 * np.median(upper)))
    off = lambda m: (k(m).sum() - len(m)) / (len(m) * (len(m) - 1))
    for method, expected in (("energy", energy), ("mmd", off(xx) + off(yy) - 2 * k(xy).mean())):
        assert multivariate.two_sample_test(*sides, method, permutations=5, block=1500).first()["statistic"] == pytest.approx(expected, abs=1e-9)


def test_embeddings_keep_all_dimensions(spark):
    from driftspan.plans import catalogue

    assert len(catalogue._embeddings(spark, "/root/testdata/sf0.001")[2]) == 64
