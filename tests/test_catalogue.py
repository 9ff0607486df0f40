import duckdb
import numpy as np
import pytest
from oracle import differences

from driftspan.functions.pvalues import ks_exact
from driftspan.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql_gives_the_same_rows(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", catalogue.QUERIES[name], catalogue.SQL[name]) == ""


SMALL = "/root/testdata/sf0.001"


def sides(table, columns, before):
    """Rows of both sides as arrays."""
    rows = lambda where: duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{table}.parquet' WHERE {where}").fetchall()
    return tuple(np.array([r[0] for r in rows(w)], float) for w in (before, f"NOT ({before})"))


def gap(a, b):
    """The values, and the absolute gaps of the shares up to each."""
    grid = np.unique(np.concatenate([a, b]))
    return grid, np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b))


def test_every_query_has_a_comparison():
    own = "bootstrap_ci_psi c2st energy_permutation kswin merged_sketches ml_efficacy mmd_permutation pca_reconstruction permutation_wasserstein".split()
    assert sorted(set(catalogue.QUERIES) - set(catalogue.SQL)) == own


@pytest.mark.parametrize(("name", "same"), [("mmd_permutation", "mmd_statistic"), ("energy_permutation", "energy_statistic"), ("permutation_wasserstein", None), ("c2st", None)])
def test_permutation_queries(spark, name, same):
    row = catalogue.QUERIES[name](spark, SMALL).first()
    assert row["n_permutations"] == 200 and row["drift"] == (row["statistic"] > row["threshold"])
    assert (row["p_value"] * 201) == pytest.approx(round(row["p_value"] * 201), abs=1e-3) and 1 / 201 - 1e-6 <= row["p_value"] <= 1
    if same:
        assert row["statistic"] == catalogue.QUERIES[same](spark, SMALL).first()["statistic"]
    elif name == "permutation_wasserstein":
        grid, apart = gap(*sides("events", "value", "ts < TIMESTAMP '2024-01-16'"))
        assert row["statistic"] == pytest.approx((apart[:-1] * np.diff(grid)).sum(), abs=1e-5)
    else:
        assert 0.3 < row["statistic"] < 0.7 and not row["drift"]  # even and odd rows of one table


def test_bootstrap_query(spark):
    row = catalogue.QUERIES["bootstrap_ci_psi"](spark, SMALL).first()
    psi = catalogue.QUERIES["psi_quantile"](spark, SMALL).first()["psi"]
    assert row["level"] == 0.95 and 0 <= row["lo"] < row["hi"] and row["lo"] < 2 * psi and psi < row["hi"]


def test_pca_query(spark):
    x, y = sides("embeddings", "embedding", "vec_id % 2 = 0")
    row = catalogue.QUERIES["pca_reconstruction"](spark, SMALL).first()
    mean = x.mean(0)
    _, spread, axes = np.linalg.svd(x - mean, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(spread**2) / (spread**2).sum(), 0.9) + 1)
    errors = [(((z - mean) - (z - mean) @ axes[:k].T @ axes[:k]) ** 2).sum(1) for z in (x, y)]
    assert row["n_components"] == k and row["statistic"] == pytest.approx(gap(*errors)[1].max(), abs=0.01)


def test_kswin_query(spark):
    rows = duckdb.sql(f"SELECT event_type, list(value ORDER BY event_id), list(event_id ORDER BY event_id) FROM '{SMALL}/events.parquet' GROUP BY 1").fetchall()
    expected = set()
    for kind, values, ids in rows:
        window, tests = [], 0
        for x, i in zip(values, ids, strict=True):
            window = [*window, x][-100:]
            if len(window) < 100:
                continue
            tests += 1
            drawn = np.random.default_rng([42, tests]).choice(np.array(window[:70]), 30)
            p = ks_exact(30, 30, float(gap(drawn, np.array(window[70:]))[1].max()))
            if p < 0.005:
                expected.add((kind, i, round(p, 6)))
                window = window[70:]
    assert {tuple(r) for r in catalogue.QUERIES["kswin"](spark, SMALL).select("event_type", "event_id", "score").collect()} == expected != set()


def test_sketch_query(spark):
    rows = sorted(catalogue.QUERIES["merged_sketches"](spark, SMALL).collect(), key=lambda r: r["share"])
    values = np.array([r[0] for r in duckdb.sql(f"SELECT value FROM '{SMALL}/events.parquet' WHERE ts < TIMESTAMP '2024-01-16'").fetchall()])
    assert len(rows) == 11 and all(r["within"] for r in rows)
    for r in rows:
        low, high = (values < r["v"] - 1e-6).mean(), (values <= r["v"] + 1e-6).mean()
        assert low - 0.0104 <= r["share"] <= high + 0.0104


def test_efficacy_query(spark):
    rows = catalogue.QUERIES["ml_efficacy"](spark, SMALL).collect()
    assert len(rows) == len({(r["trained_on"], r["metric"]) for r in rows}) == 8 and all(0 <= r["value"] <= 1 for r in rows)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r["method"] for r in rows} == {"psi", "js", "ks", "wasserstein"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
