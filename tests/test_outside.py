import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspan import benchmark, cli
from driftspan.errors import NotEnoughDataError, ValidationError
from driftspan.facade import Config, DriftMonitor, Unified
from driftspan.operators import online as O
from driftspan.operators.detectors import Univariate
from driftspan.sources import alerts
from driftspan.sources.baselines import BaselineStore
from driftspan.sources.files import json_messages, read_table
from driftspan.streaming.monitor import StreamMonitor, online


def frame(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "x double")


def test_baselines(spark, tmp_path):
    store = BaselineStore(spark, str(tmp_path / "b"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for fmt in ("parquet", "csv"):
        meta = store.save(df, "n", f"1{fmt}", owner="me", fmt=fmt)
        assert meta["row_count"] == 2 and store.metadata("n", f"1{fmt}")["owner"] == "me"
        assert sorted(map(tuple, store.load("n", f"1{fmt}").collect())) == sorted(map(tuple, df.collect()))
    assert [r["version"] for r in store.list("n").collect()] == ["1csv", "1parquet"]
    df.limit(1).write.mode("overwrite").parquet(store.metadata("n", "1parquet")["path"])
    with pytest.raises(ValidationError):
        store.load("n", "1parquet")
    store.delete("n", "1parquet")
    with pytest.raises(FileNotFoundError):
        store.load("n", "1parquet")
    with pytest.raises(ValidationError):
        store.save(df, "a/b", "1")


def test_messages(spark):
    rows = spark.createDataFrame([('{"x": 1}',), ('[{"x": 2}, {"x": 3}]',), ("{",)], "value string")
    got = [(r["x"], r["_bad"]) for r in json_messages(rows, "x double").collect()]
    assert got == [(1.0, False), (2.0, False), (3.0, False), (None, True)]


def test_alerts():
    sent, result = [], {"a": {"drift": True}, "b": {"drift": False}}

    class Keep:
        def send(self, r):
            sent.append(r)

    alerts.Composite([Keep(), alerts.ColumnFilter(Keep(), ["b"]), alerts.ColumnFilter(Keep(), ["a"])]).send(result)
    assert sent == [result, {"a": {"drift": True}}]
    tries = []

    def flaky(url, payload, timeout):
        tries.append(payload)
        if len(tries) < 3:
            raise OSError

    alerts.Slack("u", max_retries=3, wait=0, transport=flaky).send(result)
    assert len(tries) == 3 and tries[0]["text"].endswith(": a")


@pytest.mark.parametrize(("kind", "size"), [("fixed", 5), ("sliding", 4), ("ewma", 5)])
def test_stream_baselines(spark, tmp_path, kind, size):
    m = StreamMonitor(spark, str(tmp_path), Univariate("psi", bins=2), baseline=kind, sliding_batches=2)
    m.set_baseline(frame(spark, range(5)))
    batches = [[10, 11], [20, 21], [30, 31]]
    for i, b in enumerate(batches):
        first = m.process(frame(spark, b), i)
        assert m.process(frame(spark, b), i) == first  # delivered again
    base = m._baseline(3)
    assert base.count() == size
    if kind == "sliding":
        assert sorted(r["x"] for r in base.collect()) == [20, 21, 30, 31]
    assert m.scores().count() == 3


def test_stream_schema_and_threshold(spark, tmp_path):
    m = StreamMonitor(spark, str(tmp_path / "a"))
    m.set_baseline(frame(spark, range(5)).withColumn("z", F.lit(1.0)))
    with pytest.raises(ValidationError):
        m.process(frame(spark, range(3)), 0)
    m.schema = "drop"
    assert [r["feature"] for r in m.process(frame(spark, range(3)), 0)] == ["x"]
    t = StreamMonitor(spark, str(tmp_path / "b"), Univariate("psi", threshold=50.0, bins=2), adaptive_threshold=True, min_samples=2, quantile=1.0)
    t.set_baseline(frame(spark, range(100)))
    for i in range(3):
        t.process(frame(spark, range(100)), i)
    assert t.process(frame(spark, range(80, 100)), 3)[0]["drift"]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = frame(spark, rng.normal(0, 1, 200))
    for i in range(4):
        frame(spark, rng.normal(i, 1, 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    heard = []
    m = StreamMonitor(spark, str(tmp_path / "s"), window_size=2, on_drift=heard.append)
    m.set_baseline(base)
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    m.run(stream, str(tmp_path / "c")).awaitTermination()
    got = sorted((r["window"], round(r["score"], 9)) for r in m.scores().collect())
    expected = [(w, round(m.compare(m._parts(w)).first()["score"], 9)) for w in range(2)]
    assert got == expected and len(heard) == sum(score > 0.2 for _, score in expected) >= 1


def test_stateful_detectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, 60), rng.normal(3, 0.3, 40)])
    for k in range(4):
        spark.createDataFrame([("k", i, float(x[i])) for i in range(25 * k, 25 * k + 25)], "k string, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, i long, v double").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = online(stream, "cusum", "v", "i", "k").writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r["i"] for r in spark.table("alarms").where("drift").orderBy("i").collect()]
    assert got == O.run_online(O.Cusum(), x)


def test_config_and_cli(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "c.toml").write_text('method = "ks"\nalpha = 0.01\n')
    assert Config.from_file(str(tmp_path / "c.toml")).alpha == 0.01
    monkeypatch.setenv("DRIFTSPAN_METHOD", "js")
    assert Config.from_env().method == "js"
    with pytest.raises(ValidationError):
        Config.of({"nope": 1})
    for name, values in (("a", range(200)), ("b", range(150, 350))):
        frame(spark, values).coalesce(1).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    args = ["--baseline", str(tmp_path / "a.csv"), "--current", str(tmp_path / "b.csv")]
    assert cli.main(["check", *args, "--strategy", "kll", "--fail-on-drift"], spark) == 1
    assert json.loads(capsys.readouterr().out)["n_drifting"] == 1
    assert cli.main(["report", *args, "--format", "markdown"], spark) == 1
    assert cli.main(["check", *args, "--columns", "nope"], spark) == 2
    assert cli.main(["check", *args, "--method", "ensemble"], spark) == 0
    assert read_table(spark, str(tmp_path / "a.csv")).count() == 200


def test_facade(spark):
    a, b = frame(spark, np.random.default_rng(0).normal(0, 1, 150)), frame(spark, np.random.default_rng(1).normal(1, 1, 150))
    told = []
    for method in ("psi", "ks", "mmd", "wasserstein"):
        row = Unified(method, n_permutations=30, record=lambda e, v: told.append(e), bootstrap_samples=20).detect(a, b, ["x"]).first()
        assert row["drift"]
    assert "latency_ms" in told
    with pytest.raises(NotEnoughDataError):
        Unified().detect(a.limit(1), b, ["x"])
    model = DriftMonitor().fit(a)
    assert model.transform(b).count() == 150 and model.last.first()["drift"]


def test_benchmark_rates(spark):
    for method, name, lo, hi in (("ks", "no_drift", 0, 0.35), ("cvm", "mean_shift", 0.5, 1), ("psi", "mean_shift", 0.5, 1)):
        rows = benchmark.trials(spark, method, name, 120, 16, 7).collect()
        assert len(rows) == 16 and lo <= sum(r["drift"] for r in rows) / 16 <= hi
    found = benchmark.massive_psi(spark, 300_000, sample=20_000)
    assert found["delta"] <= 0.2


def test_parity_and_phases(spark, tmp_path):
    assert all(r["within"] for r in benchmark.parity(spark, small=500, large=2000).collect())
    rates = benchmark.stream_phases(spark, str(tmp_path), 6)
    assert rates["middle"] == 1.0 and rates["early"] <= 0.5 and rates["late"] <= 0.5
