"""All-pairs statistics: equal rows counted once, disk by the rows and not by their square, exact medians."""

import numpy as np
import pytest

from driftspan.operators import multivariate
from driftspan.plans import catalogue


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def far(p, q):
    return np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1))


def plain(x, y, gamma):
    """energy and mmd2 of points with counts: (points, counts) a side."""
    mean = lambda k, a, b: (a @ k @ b) / (a.sum() * b.sum())
    off = lambda k, a: (a @ k @ a - a.sum()) / (a.sum() * (a.sum() - 1))
    (p, a), (q, b) = x, y
    k = lambda u, v: np.exp(-gamma * far(u, v) ** 2)
    return 2 * mean(far(p, q), a, b) - mean(far(p, p), a, a) - mean(far(q, q), b, b), off(k(p, p), a) + off(k(q, q), b) - 2 * mean(k(p, q), a, b)


def repeated(spark, seed, low):
    """90,000 rows of few points far from 0, and the points with their counts."""
    points = np.random.default_rng(seed).integers(low, low + 9, (45, 2)).astype(float)
    points = np.unique(points, axis=0)
    df = spark.createDataFrame(points.tolist(), "a double, b double")
    return df.crossJoin(spark.range(2000)).select("a", "b"), (points, np.full(len(points), 2000.0))


def test_energy_counts_equal_rows_once(spark):
    (a, x), (b, y) = repeated(spark, 1, 10**9), repeated(spark, 2, 10**9 + 3)
    before = shuffled(spark)
    row = multivariate.pair_statistics(a, b, ["a", "b"], 0.01, methods=("energy",)).first()
    assert row["energy"] == pytest.approx(plain(x, y, 0.01)[0], abs=1e-9) and row["mmd2"] is None
    assert shuffled(spark) - before < 2e5


def test_mmd_counts_equal_rows_once(spark):
    (a, x), (b, y) = repeated(spark, 3, 10**9), repeated(spark, 4, 10**9 + 2)
    before = shuffled(spark)
    row = multivariate.pair_statistics(a, b, ["a", "b"], 0.01, methods=("mmd",)).first()
    assert row["mmd2"] == pytest.approx(plain(x, y, 0.01)[1], abs=1e-9) and row["energy"] is None
    assert shuffled(spark) - before < 2e5


def sides(spark, seed, n=1500, m=1300, width=40):
    rng = np.random.default_rng(seed)
    both = rng.normal(0, 1, (n, width)), rng.normal(0.03, 1, (m, width))
    names = [f"c{i}" for i in range(width)]
    return [spark.createDataFrame(v.tolist(), ", ".join(f"{c} double" for c in names)) for v in both], names


def labelled(frames, names, permutations, seed=42):
    """All rows in the order of their numbers, and whether each counts as the reference's: as seen, and by permutation."""
    rows = multivariate._numbered_rows(*frames, [multivariate._vector(f, names) for f in frames], seed).orderBy("position").toPandas()
    n, total = int((rows["side"] == 0).sum()), len(rows)
    return np.stack(rows["x"]), np.stack([rows["side"] == 0, *(multivariate.permuted(np.arange(total), total, seed, k) < n for k in range(permutations))])


def null_row(k, labels, method):
    """statistic, p-value and threshold of a kernel matrix."""
    def one(a):
        parts = k[a][:, a], k[a][:, ~a], k[~a][:, ~a]
        if method == "energy":
            return 2 * parts[1].mean() - parts[0].mean() - parts[2].mean()
        off = lambda p: (p.sum() - np.trace(p)) / (len(p) * (len(p) - 1))
        return off(parts[0]) + off(parts[2]) - 2 * parts[1].mean()

    seen, *null = (one(a) for a in labels)
    return seen, (1 + sum(t >= seen - 1e-12 for t in null)) / (1 + len(null)), np.quantile(null, 0.95)


def held_to_plain(spark, method, permutations):
    """A test in many blocks gives what one matrix does, and shuffles the rows a few times, not once a block."""
    frames, names = sides(spark, 7)
    x, labels = labelled(frames, names, permutations)
    d = far(x, x)
    k = d if method == "energy" else np.exp(-d * d / (2 * np.median(d[np.triu_indices(len(d), 1)] ** 2)))
    before = shuffled(spark)
    row = multivariate.two_sample_test(*frames, method, names, permutations, block=100).first()
    written = shuffled(spark) - before
    assert (row["statistic"], row["p_value"], row["threshold"]) == pytest.approx(null_row(k, labels, method), abs=1e-9)
    assert written < 6 * x.nbytes  # 28 blocks


def test_mmd_permutations_read_blocks_where_they_lie(spark):
    held_to_plain(spark, "mmd", 20)


def test_energy_permutations_read_blocks_where_they_lie(spark):
    held_to_plain(spark, "energy", 20)


@pytest.mark.parametrize("kind", ["normal", "ties", "apart", "equal"])
@pytest.mark.parametrize(("steps", "few"), [(2**13, 2**18), (8, 16)])
def test_median_of_all_pairs(spark, monkeypatch, kind, steps, few):
    """gamma by the median of the positive squared distances, whatever the passes: counted rows, ties, middle values far apart."""
    monkeypatch.setattr(multivariate, "STEPS", steps)
    monkeypatch.setattr(multivariate, "FEW", few)
    rng = np.random.default_rng(8)
    x = {"normal": rng.normal(size=(700, 6)), "ties": rng.integers(0, 3, (700, 2)).astype(float), "apart": np.array([[0.0], [1.0], [1000.0], [1000.0]]), "equal": np.ones((9, 2))}[kind]
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(np.column_stack([np.arange(len(x)) % 2, x]).tolist(), ", ".join(f"{c} double" for c in ["s", *names]))
    row = multivariate.pair_statistics(df.where("s = 0"), df.where("s = 1"), names, block=150, methods=("mmd",)).first()
    d2 = (far(x, x) ** 2)[np.triu_indices(len(x), 1)]
    expected = 1 / (2 * np.median(d2[d2 > 1e-12])) if kind != "equal" else 1.0
    assert row["gamma"] == pytest.approx(expected, rel=1e-12)


def test_mmd_statistic_shuffles_the_rows_only(spark):
    held_to_plain(spark, "mmd", 1)


def test_energy_statistic_shuffles_the_rows_only(spark):
    held_to_plain(spark, "energy", 1)
