"""Multivariate two-sample tests, permutation tests and bootstrap.

All-pairs statistics are quadratic and see all rows, in pairs of blocks of rows dealt over tasks; blocks are kept once, with the
permuted labels of their rows, and tasks read those they need, so disk grows with the rows and memory with a block. The one-dimensional permutation test and the bootstrap work
on histograms of distinct values instead and see all rows too.
"""

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.errors import NotEnoughDataError, require
from driftspan.functions.pvalues import ks_p
from driftspan.operators.binning import bin_edges, histograms
from driftspan.operators.distances import TINY, cdf_statistics
from driftspan.operators.monitoring import aucs
from driftspan.operators.pairs import numeric_columns, pairs, running_counts
from driftspan.operators.permuted import permuted
from driftspan.operators.series import numbered

SLICES = 32  # seeds of the draws follow the slices
TILE = (128, 1024)  # rows of two blocks whose distances are computed at once
STEPS = 2**13  # of a range of numbers, in a pass of the median of all pairs
FEW = 2**18  # numbers that are counted one by one
RESULT = "statistic double, p_value double, threshold double, drift boolean, n_permutations int"


def _check(permutations: int, alpha: float) -> None:
    require(permutations >= 1 and 0 < alpha < 1, "need at least one permutation and alpha between 0 and 1")


def null_test(spark: SparkSession, statistic: float, null: DataFrame, alpha: float) -> DataFrame:
    """One row from a relation of null statistics `t`: p = (1 + those at least as large) / (1 + all), threshold the 1 - alpha quantile."""
    as_large = F.sum((F.col("t") >= statistic - 1e-12).cast("int"))
    rows = null.agg(F.lit(statistic).alias("statistic"), ((1 + as_large) / (1 + F.count("*"))).alias("p_value"), F.percentile("t", F.lit(1 - alpha)).alias("threshold"), F.count("*").cast("int").alias("n_permutations"))
    return rows.withColumn("drift", F.col("statistic") > F.col("threshold")).select("statistic", "p_value", "threshold", "drift", "n_permutations")


def _both_sides(reference: DataFrame, current: DataFrame, vectors: Sequence[Column]) -> DataFrame:
    """(side, x): all rows without nulls or NaN."""
    sides = [df.select(F.lit(s).alias("side"), v.alias("x")) for s, (df, v) in enumerate(zip((reference, current), vectors, strict=True))]
    return sides[0].unionByName(sides[1]).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _numbered_rows(reference: DataFrame, current: DataFrame, vectors: Sequence[Column], seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(side, x, position): all rows without nulls or NaN, numbered from 1 in the order of a seeded hash; with keys, by side."""
    both = _both_sides(reference, current, vectors)
    return numbered(both.withColumn("h", F.xxhash64("x", F.lit(seed))), "h", keys, ("side", "x")).select("side", "x", "position")


def _block_rows(points: int, width: int, cores: int) -> int:
    """Rows of a block: pairs of blocks for several rounds of tasks, and vectors of 8 MB at most."""
    least = max(12, math.ceil((8 * cores) ** 0.5))
    return min(max(1024, -(-points // least)), 16384, max(1, 2**20 // max(1, width)))


def _blocks(points: DataFrame, ties: Sequence[str], count: int, block: int, sizes: tuple[int, int], permutations: int, seed: int) -> DataFrame:
    """(block, x: vectors, r: reference rows by point and labels, n: rows by point) as bytes, a block a partition, from (x, r, n).

    With permutations a point is a row and r holds bits: its own label and that of each permutation.
    """
    numbers = numbered(points.withColumn("h", F.xxhash64("x", F.lit(seed))), "h", (), ties).select((F.col("position") - 1).alias("i"), "x", "r", "n")
    total = sum(sizes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).sort_by("i")
            i, r, n = (rows[c].to_numpy() for c in ("i", "r", "n"))
            x = rows["x"].combine_chunks().flatten().to_numpy()
            if permutations:
                r = np.packbits(np.stack([r > 0, *(permuted(i, total, seed, k) < sizes[0] for k in range(permutations))], 1), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i[0] // block]), *(pa.array([v.tobytes()], pa.large_binary()).cast(pa.binary()) for v in (x, r, n))], ["block", "x", "r", "n"])

    return numbers.repartitionById(count, F.expr(f"cast(i div {block} as int)")).mapInArrow(pack, "block long, x binary, r binary, n binary")


def _pairs_of_blocks(blocks: DataFrame, columns: Sequence[str], count: int) -> DataFrame:
    """Each of `count` blocks with itself and with half of the others, each pair once. Tasks read the blocks where they are kept: nothing is
    copied or shuffled, and as there are so many tasks to a core, what they have added up is bounded too."""
    a, b = (blocks.select(*(F.col(c).alias(f"{c}{s}") for c in ("block", *columns))) for s in "ab")
    ahead = f"2 * pmod(blockb - blocka, {count})"  # round a circle, so that each block has as many
    both = a.join(b.hint("shuffle_replicate_nl"), F.expr(f"{ahead} < {count} or {ahead} = {count} and blocka < blockb"))
    return both.coalesce(16 * blocks.sparkSession.sparkContext.defaultParallelism)


def _read(batches: Iterator[pa.RecordBatch], columns: str, width: int) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """Pairs of blocks: whether both are the same, and the columns of each by name and side."""
    for batch in batches:
        for i in range(batch.num_rows):
            found = {c: np.frombuffer(batch.column(c)[i].as_buffer(), float if c[0] == "x" else np.uint8 if c[0] == "r" else np.int64) for c in (x + s for x in columns for s in "ab")}
            yield batch.column("blocka")[i].as_py() == batch.column("blockb")[i].as_py(), {c: v.reshape(-1, width) if c[0] == "x" else v for c, v in found.items()}


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """The squared distances of a's rows to b's, in parts that stay in a processor's cache, and as much room, both used again for the next part. Equal rows have 0.

    Few columns are subtracted; for more, products of centred rows are, and what these leave without enough digits is subtracted.
    """
    width = a.shape[1]
    centre = a.mean(0)
    a, b = a - centre, b - centre
    na, nb = (a * a).sum(1), (b * b).sum(1)
    rooms = np.empty((2, TILE[0] * TILE[1]))
    for q in (slice(j, min(j + TILE[1], len(b))) for j in range(0, len(b), TILE[1])):
        turned = np.ascontiguousarray((b[q] if width <= 4 else -2 * b[q]).T)
        for p in (slice(i, min(i + TILE[0], len(a))) for i in range(0, len(a), TILE[0])):
            shape = p.stop - p.start, q.stop - q.start
            d2, room = (r[: shape[0] * shape[1]].reshape(shape) for r in rooms)
            if width <= 4:
                d2[:] = 0
                for k in range(width):
                    np.subtract(a[p, k, None], turned[k], out=room)
                    d2 += np.multiply(room, room, out=room)
            else:
                np.matmul(a[p], turned, out=d2)
                d2 += np.add(na[p, None], nb[q], out=room)
                close = d2 < np.multiply(room, 1e-6, out=room)
                if close.any():
                    rows, others = np.nonzero(close)
                    for s in (slice(t, t + 16384) for t in range(0, len(rows), 16384)):
                        d2[rows[s], others[s]] = ((a[p][rows[s]] - b[q][others[s]]) ** 2).sum(1)
            yield p, q, d2, room


def _around_median(width: int, share: float):
    """(lo, hi): squared distances at `share` below and above the median within each run of 1024 rows of a block."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for value in batch.column("x"):
                x = np.frombuffer(value.as_buffer()).reshape(-1, width)
                for own in (x[i : i + 1024] for i in range(0, len(x), 1024)):
                    d2 = np.concatenate([np.zeros(0), *(d[d > 0] for _, _, d, _ in _tiles(own, own))])
                    if len(d2):
                        out.append(np.quantile(d2, [0.5 - share, 0.5 + share]))
        lo, hi = np.array(out).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])

    return look


def _counts_within(pairs: DataFrame, width: int, first: int, last: int, shift: int) -> tuple[int, int, pd.DataFrame]:
    """Ordered pairs of rows with equal rows, with squared distances below the number of the bits `first`, and (key, n) of those
    from it up to `last` by steps of 2**shift: without a shift each number is a step, and there should be few."""
    lo, hi = np.array([first, last], np.uint64).view(float)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, dense, kept = {-2: 0, -1: 0}, np.zeros(STEPS if shift else 0, np.int64), []
        for same, of in _read(batches, "xn", width):
            single = max(of["na"].max(), of["nb"].max()) == 1
            times = 1 if same else 2  # a pair of other blocks stands for both orders
            for p, q, d2, _ in _tiles(of["xa"], of["xb"]):
                rows = None if single else np.multiply.outer(of["na"][p], of["nb"][q])
                for key, found in ((-2, d2 == 0), (-1, d2 < lo)):
                    sums[key] += times * int(np.count_nonzero(found) if single else rows[found].sum())
                inside = (d2 >= lo) & (d2 <= hi)
                keys = (d2[inside].view(np.uint64) - np.uint64(first)) >> np.uint64(shift)
                n = np.full(len(keys), times) if single else times * rows[inside]
                if shift:
                    dense += np.bincount(keys.astype(np.int64), n, STEPS).astype(np.int64)
                elif len(keys):
                    kept.append((keys, n))
        if kept:
            found, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in kept])).astype(np.int64)
        else:
            found = np.flatnonzero(dense)
            n = dense[found]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found.astype(np.int64), list(sums))), pa.array(np.append(n, list(sums.values())))], ["key", "n"])

    counts = pairs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")  # at most STEPS or FEW and two
    equal, below = (int(counts["n"][counts["key"] == key].sum()) for key in (-2, -1))
    return equal, below, counts[counts["key"] >= 0]


def _median_d2(blocks: DataFrame, count: int, width: int, total: int) -> float | None:
    """The exact median of the positive squared distances of all pairs; None if there is none.

    Passes count the bits of the numbers within a range, and all below it. The first range lies around the medians within runs
    of rows and the next is the step that has the rank, so that two passes are the rule; a range without the rank is left for
    what lies below or above it.
    """
    pairs, top = _pairs_of_blocks(blocks, "xn", count), int(np.array(np.inf).view(np.uint64))
    first, last, few = 1, top, total * total <= FEW
    if not few:
        around = blocks.select("x").mapInArrow(_around_median(width, 0.002 + total**-0.5), "lo double, hi double").agg(F.avg("lo"), F.avg("hi")).first()
        if around[0]:
            first, last = (int(v) for v in np.array(around, float).view(np.uint64))
    found, counts = [], None
    for middle in (1, 0):
        while True:
            if counts is None:
                shift = 0 if few else max(0, (last - first + 1).bit_length() - STEPS.bit_length() + 1)
                equal, below, counts = _counts_within(pairs, width, first, last, shift)
                upto = np.cumsum(counts["n"].to_numpy())
                if equal == total * total:
                    return None
                below -= equal
            rank = (total * total - equal - middle) // 2 - below
            if rank < 0:
                first, last, few, counts = 1, first - 1, False, None
            elif not len(upto) or rank >= upto[-1]:
                first, last, few, counts = last + 1, top, False, None
            else:
                at = int(np.searchsorted(upto, rank, "right"))
                key, n = (int(v) for v in counts.iloc[at])
                if not shift:
                    found.append(first + key)
                    break
                first = first + (key << shift)
                last, few, counts = min(last, first + (1 << shift) - 1), n <= FEW, None
    return float(np.array(found, np.uint64).view(float).mean())


def _pair_sums(reference: DataFrame, current: DataFrame, methods: Sequence[str], columns: Sequence[str], permutations: int, gamma: float | None, block: int | None, seed: int) -> tuple[dict[str, list[float]], float | None]:
    """For each method the statistic as seen and by permuted labels, from all pairs of all rows; and gamma, if mmd is one.

    Without permutations equal rows are one point with counts of both sides, so the work grows with the square of the
    different rows.
    """
    width = len(columns)
    vector = F.array(*(F.col(c).cast("double") for c in columns))
    rows = _both_sides(reference, current, [vector, vector]).select("side", "x", (1 - F.col("side")).cast("long").alias("r"), F.lit(1).cast("long").alias("n"))
    points, ties = (rows, ("side", "x")) if permutations else (rows.groupBy("x").agg(F.sum("r").alias("r"), F.sum("n").alias("n")), ("x",))
    sizes = points.agg(F.count("*").alias("points"), F.sum("r").alias("n"), F.sum("n").alias("total")).first()
    total, n = sizes["total"] or 0, sizes["n"] or 0
    m = total - n
    if min(n, m) < 2:
        raise NotEnoughDataError("two rows a side are needed")
    block = block or _block_rows(sizes["points"], width, reference.sparkSession.sparkContext.defaultParallelism)
    count = -(-sizes["points"] // block)
    blocks = _blocks(points, ties, count, block, (n, m), permutations, seed).cache()
    try:
        if "mmd" in methods and gamma is None:
            median = _median_d2(blocks, count, width, total)
            gamma = 1 / (2 * median) if median else 1.0

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {x: np.zeros((3, permutations + 1)) for x in methods}
            for same, of in _read(batches, "xrn", width):
                r, t = {}, {s: of[f"n{s}"].astype(float) for s in "ab"}
                for s in "ab":
                    own = of[f"r{s}"]
                    r[s] = (np.unpackbits(own.reshape(len(t[s]), -1), 1, permutations + 1) if permutations else own.view(np.int64)[:, None]).astype(float)
                both = np.column_stack([r["b"], t["b"]])
                back = {x: np.zeros(len(t["b"])) for x in methods}
                for p, q, d2, k in _tiles(of["xa"], of["xb"]):
                    for method in methods:
                        np.sqrt(d2, out=k) if method == "energy" else np.exp(np.multiply(d2, -gamma, out=k), out=k)
                        out, times = k @ both[q], 1 if same else 2
                        xx, touched, all_ = sums[method]
                        xx += times * np.einsum("ij,ij->j", r["a"][p], out[:, :-1])
                        touched += out[:, -1] @ r["a"][p]
                        all_ += times * (t["a"][p] @ out[:, -1])
                        if not same:
                            back[method][q] += t["a"][p] @ k
                for method in methods:
                    sums[method][1] += back[method] @ r["b"]
            for method, (xx, s, all_) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([method] * (permutations + 1)), pa.array(np.arange(permutations + 1)), *map(pa.array, (xx, s, all_))], ["method", "id", "xx", "s", "all"])

        summed = _pairs_of_blocks(blocks, "xrn", count).mapInArrow(add, "method string, id long, xx double, s double, all double").groupBy("method", "id").agg(*(F.sum(c).alias(c) for c in ("xx", "s", "all"))).collect()  # a row a permutation
    finally:
        blocks.unpersist()
    found: dict[str, list[float]] = {x: [0.0] * (permutations + 1) for x in methods}
    for row in summed:
        alone = row["method"] == "mmd"  # a row is no pair with itself, which its kernel of 1 was added for
        xx, s, all_ = (row[c] - alone * k for c, k in (("xx", n), ("s", n), ("all", total)))
        xy, yy = s - xx, all_ - 2 * s + xx
        within = (n * (n - 1), m * (m - 1)) if alone else (n * n, m * m)
        value = xx / within[0] + yy / within[1] - 2 * xy / (n * m)
        found[row["method"]][row["id"]] = value if alone else -value
    return found, gamma


def pair_statistics(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, gamma: float | None = None, block: int | None = None, methods: Sequence[str] = ("energy", "mmd")) -> DataFrame:
    """energy (twice the mean distance across less those within, rows with themselves included), mmd2 (unbiased, RBF) and
    gamma, over all pairs of all rows; null for what is not among methods. gamma is by the exact median of all pairs if not given; 1 if no two rows differ."""
    require(gamma is None or gamma > 0, "gamma must be positive")
    found, gamma = _pair_sums(reference, current, methods, list(columns or numeric_columns(reference)), 0, gamma, block, 0)
    return reference.sparkSession.createDataFrame([(*(found.get(x, [None])[0] for x in ("energy", "mmd")), gamma)], "energy double, mmd2 double, gamma double")


def two_sample_test(reference: DataFrame, current: DataFrame, method: str = "mmd", columns: Sequence[str] | None = None, permutations: int = 200, alpha: float = 0.05, gamma: float | None = None, block: int | None = None, seed: int = 42) -> DataFrame:
    """statistic, p_value, threshold, drift of mmd (unbiased, RBF) or energy (V-statistic) by permuted labels.

    All pairs of all rows count: each task takes the distances of two blocks of rows and adds up what they give to every
    permutation. A block has `block` rows, by default by their number, width and the cores. gamma is by the exact median of all pairs if not given. At least two rows a side are needed.
    """
    _check(permutations, alpha)
    require(method in ("mmd", "energy"), "method must be mmd or energy")
    require(gamma is None or gamma > 0, "gamma must be positive")
    found, _ = _pair_sums(reference, current, (method,), list(columns or numeric_columns(reference)), permutations, gamma, block, seed)
    seen, *null = found[method]
    return null_test(reference.sparkSession, seen, reference.sparkSession.createDataFrame([(t,) for t in null], "t double"), alpha)


def _drawn_totals(sizes: np.ndarray, draw: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `draw` rows, taken without putting back, fall to each slice. From 10**9 rows on, a slice's draw is normal with the exact mean and variance."""
    out, left, rows = np.zeros(len(sizes), np.int64), draw, int(sizes.sum())
    for i, size in enumerate(map(int, sizes)):
        rest = rows - size
        if rows < 10**9:
            out[i] = rng.hypergeometric(size, rest, left) if left else 0
        else:
            spread = (left * (size / rows) * (rest / rows) * (rows - left) / (rows - 1)) ** 0.5
            out[i] = np.clip(round(rng.normal(left * (size / rows), spread)), max(0, left - rest), min(size, left))
        left, rows = left - out[i], rest
    return out


def _redrawn_wasserstein(relation: DataFrame, times: int, seed: int, replace: bool, slices: int) -> DataFrame:
    """(id, t): Wasserstein distances of redrawn samples: rows of both dealt anew to sides of the same sizes, or, with `replace`,
    each side's rows drawn from itself with replacement.

    Values keep counts; the driver draws what falls to each slice of the values, a task what falls to each value of its slice.
    """
    counts = running_counts(relation, slices=slices).where("r + c > 0")
    sizes = counts.groupBy("slice").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).orderBy("slice").collect()  # `slices` rows
    number = {r["slice"]: i for i, r in enumerate(sizes)}
    r, c = (np.array([x[s] for x in sizes], np.int64) for s in "rc")
    n, m = int(r.sum()), int(c.sum())
    rngs = [np.random.default_rng([seed, i]) for i in range(times)]
    first = np.array([g.multinomial(n, r / n) if replace else _drawn_totals(r + c, n, g) for g in rngs])
    second = np.array([g.multinomial(m, c / m) for g in rngs]) if replace else (r + c) - first

    def part(key: tuple, table: pa.Table) -> pa.Table:
        at, table = number[key[0].as_py()], table.sort_by("v")
        own, other, v = (table[x].to_numpy() for x in "rcv")
        width = np.nan_to_num(table["next"].fill_null(np.nan).to_numpy() - v)
        out = np.zeros(times)
        for i in range(times):
            rng, (x, y) = np.random.default_rng([seed, i, at]), (first[i, at], second[i, at])
            if replace:
                a, b = (rng.multinomial(k, s / s.sum()) if k else np.zeros(len(s), np.int64) for k, s in ((x, own), (y, other)))
            else:
                both = (own + other).astype(np.int64)
                a = rng.multivariate_hypergeometric(both, x, method="marginals")
                b = both - a
            gap = np.abs((first[i, :at].sum() + np.cumsum(a)) / n - (second[i, :at].sum() + np.cumsum(b)) / m)
            out[i] = (gap * width).sum()
        return pa.table({"id": pa.array(np.arange(times)), "t": pa.array(out)})

    return counts.select("slice", "v", "r", "c", "next").groupBy("slice").applyInArrow(part, "id long, t double").groupBy("id").agg(F.sum("t").alias("t"))


def wasserstein_test(reference: DataFrame, current: DataFrame, column: str, permutations: int = 200, alpha: float = 0.05, seed: int = 42, slices: int = SLICES) -> DataFrame:
    """Permutation test of the Wasserstein distance over all rows: a permutation draws how many rows of each distinct value the
    reference gets, so both sides keep their sizes and no row is copied."""
    _check(permutations, alpha)
    relation = pairs(reference, current, [column])
    first = cdf_statistics(relation).first()
    if first is None or min(first["n"], first["m"]) < 2:
        raise NotEnoughDataError("two rows a side are needed")
    null = _redrawn_wasserstein(relation, permutations, seed, False, slices).select("t")
    return null_test(reference.sparkSession, first["wasserstein"], null, alpha)


def bootstrap(reference: DataFrame, current: DataFrame, column: str, method: str = "psi", samples: int = 200, level: float = 0.95, bins: int = 10, seed: int = 42, slices: int = SLICES) -> DataFrame:
    """lo, hi, level: percentile interval of psi, js or wasserstein under resampling of both sides, by multinomial draws of the counts
    of bins, or of distinct values; no row is touched again."""
    require(samples >= 1 and 0 < level < 1, "need at least one sample and a level between 0 and 1")
    require(method in ("psi", "js", "wasserstein"), "method must be psi, js or wasserstein")
    relation, spark = pairs(reference, current, [column]), reference.sparkSession
    if method == "wasserstein":
        drawn = _redrawn_wasserstein(relation, samples, seed, True, slices)
    else:
        shares = histograms(relation, bin_edges(relation, bins)).orderBy("bin").collect()  # a row a bin
        p, q = (np.array([r[x] for r in shares]) for x in "pq")
        sizes = [int(shares[0][x]) for x in "nm"]

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for i in batch["id"]:
                    rng = np.random.default_rng([seed, int(i)])
                    a, b = (rng.multinomial(k, s / s.sum()) / k for k, s in zip(sizes, (p, q), strict=True))
                    least = 1e-6 if method == "psi" else TINY
                    a, b = (np.where(s <= 0, least, s) if method == "psi" else np.maximum(s, least) for s in (a, b))
                    if method == "psi":
                        out.append(float(((b - a) * np.log(b / a)).sum()))
                    else:
                        a, b = a / a.sum(), b / b.sum()
                        out.append(float((a * np.log(2 * a / (a + b)) + b * np.log(2 * b / (a + b))).sum() / 2))
                yield pd.DataFrame({"t": out})

        drawn = spark.range(0, samples, 1, 4).mapInPandas(draw, "t double")
    tail = (1 - level) / 2
    return drawn.agg(F.percentile("t", F.lit(tail)).alias("lo"), F.percentile("t", F.lit(1 - tail)).alias("hi"), F.lit(level).alias("level"))


def bootstrap_psi(reference: DataFrame, current: DataFrame, column: str, samples: int = 200, level: float = 0.95, bins: int = 10, seed: int = 42) -> DataFrame:
    """bootstrap() of psi."""
    return bootstrap(reference, current, column, "psi", samples, level, bins, seed)


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if len(columns) == 1 and df.schema[columns[0]].dataType.simpleString().startswith("array"):
        return df.select(array_to_vector(F.col(columns[0]).cast("array<double>")).alias("x"))
    return VectorAssembler(inputCols=list(columns), outputCol="x", handleInvalid="skip").transform(df).select("x")


def _vector(df: DataFrame, columns: Sequence[str]) -> Column:
    if len(columns) == 1 and df.schema[columns[0]].dataType.simpleString().startswith("array"):
        return F.col(columns[0]).cast("array<double>")
    return F.array(*(F.col(c).cast("double") for c in columns))


def _memory_step(grad: np.ndarray, solve, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Limited-memory BFGS directions of many models at once (rows of grad), from their last steps and changes of gradient."""
    q, kept = grad.copy(), []
    for s, y in zip(reversed(steps), reversed(changes), strict=True):
        sy = (s * y).sum(1, keepdims=True)
        rho = np.where(sy > 1e-12, 1 / np.maximum(sy, 1e-12), 0.0)  # a step without curvature counts for nothing
        alpha = rho * (s * q).sum(1, keepdims=True)
        q -= alpha * y
        kept.append((rho, alpha))
    r = solve(q)
    for (s, y), (rho, alpha) in zip(zip(steps, changes, strict=True), reversed(kept), strict=True):
        r += s * (alpha - rho * (y * r).sum(1, keepdims=True))
    return -r


@dataclass(frozen=True)
class _Deal:
    """Labels and splits of all models: 0 as seen, i the i-th permutation. Sizes are exact: `held` rows of each side are held out."""

    sizes: tuple[int, int]
    held: tuple[int, int]
    permutations: int
    seed: int

    def parts(self, side: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label, held out) by row and model."""
        (n, m), (tn, tm) = self.sizes, self.held
        own = np.where(side == 0, permuted(np.minimum(position, n) - 1, n, self.seed, 0, 0), permuted(np.minimum(position, m) - 1, m, self.seed, 0, 1) + n)
        at = position - 1 + n * side
        places = np.stack([own, *(permuted(at, n + m, self.seed, i, 2) for i in range(1, self.permutations + 1))], 1)
        label = places >= n
        return label, np.where(label, places - n < tm, places < tn)


def _with_parts(deal: _Deal):
    """(x, label, held): a bit a model."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [pa.array([r.tobytes() for r in np.packbits(p, 1)], pa.binary()) for p in deal.parts(batch.column("side").to_numpy(), batch.column("position").to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column("x"), *bits], ["x", "label", "held"])

    return add


def _bits(column: pa.Array, count: int) -> np.ndarray:
    """(rows, models) of bits."""
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), 1, count).astype(bool)


def _gradients(weights: np.ndarray):
    """(model, place, value): gradient of the log loss over a task's rows that are not held out; the loss at the last place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), weights.shape[1] + 1))
        for batch in batches:
            x = _design(batch)
            label, used = _bits(batch.column("label"), len(weights)), ~_bits(batch.column("held"), len(weights))
            margin = x @ weights.T
            total[:, :-1] += ((1 / (1 + np.exp(-margin)) - label) * used).T @ x
            total[:, -1] += ((np.logaddexp(0, margin) - label * margin) * used).sum(0)
        model, place = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total.ravel())], ["model", "place", "value"])

    return add


def _design(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors with a 1 for the intercept."""
    x = batch.column("x")
    flat = x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, 0))
    return np.hstack([flat, np.ones((len(x), 1))])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, value): sums of products of a task's vectors and a 1."""
    total = 0
    for batch in batches:
        x = _design(batch)
        total = total + x.T @ x
    if not np.isscalar(total):
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])


def _fit_all(rows: DataFrame, deal: _Deal, penalty: float, tolerance: float, rounds: int) -> np.ndarray:
    """Coefficients, the intercept last, of all models by model: a pass over rows a round, whatever the number of models.

    The log loss plus penalty / 2 times the squared coefficients, the intercept free. Rounds start from the curvature that
    labels without meaning have, and remember the last steps; a model whose loss rose goes back and takes half the way. It ends when no gradient is
    above tolerance a row, or after `rounds`.
    """
    n, m = deal.sizes
    summed = rows.select("x").mapInArrow(_products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    width = int(summed["i"].max()) + 1
    products = np.zeros((width, width))
    products[summed["i"], summed["j"]] = summed["value"]
    free = np.append(np.ones(width - 1), 0.0)
    share, train = n / (n + m), 1 - sum(deal.held) / (n + m)
    curve = products * share * (1 - share) * train + np.diag(penalty * free + 1e-9)
    inverse = np.linalg.inv(curve)
    solve = lambda g: g @ inverse
    count = (n + m) * train

    def measured(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = rows.mapInArrow(_gradients(w), "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).toPandas()
        out = np.zeros((len(w), width + 1))
        out[found["model"], found["place"]] = found["value"]
        return out[:, :-1] + penalty * free * w, out[:, -1] + penalty / 2 * (free * w * w).sum(1)

    best = np.zeros((deal.permutations + 1, width))
    grad, loss = measured(best)
    steps, changes = [], []
    step = -solve(grad)
    for _ in range(rounds):
        if np.abs(grad).max() <= tolerance * count:
            break
        new = best + step
        new_grad, new_loss = measured(new)
        worse = (new_loss > loss + 1e-9 * np.abs(loss))[:, None]
        moved, change = np.where(worse, 0.0, step), np.where(worse, 0.0, new_grad - grad)
        best, loss = best + moved, np.where(worse[:, 0], loss, new_loss)
        grad = np.where(worse, grad, new_grad)
        steps, changes = [*steps, moved][-8:], [*changes, change][-8:]
        step = np.where(worse, step / 2, _memory_step(grad, solve, steps, changes))
    return best


def _scores(weights: np.ndarray):
    """(feature: the model, v: score, r, c): a task's held-out rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, held = _bits(batch.column("label"), len(weights)), _bits(batch.column("held"), len(weights))
            row, model = np.nonzero(held)
            v, y = (_design(batch) @ weights.T)[row, model], label[row, model].astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(v), pa.array(y), pa.array(1 - y)], ["feature", "v", "r", "c"])

    return score


def classifier_test(reference: DataFrame, current: DataFrame, columns: Sequence[str], permutations: int = 200, alpha: float = 0.05, test_size: float = 0.3, seed: int = 42, penalty: float = 1.0, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """statistic (ROC-AUC of a logistic regression telling the sides apart on held-out rows), and its permutation test.

    Every permutation deals all rows anew to sides of the same sizes and fits and scores anew; test_size of each side is held out, both to a
    row. All models are fitted at once: a round is one pass over the rows that adds up all gradients. Rows are numbered, and a
    keyed permutation of the numbers gives labels and splits, so equal rows may differ in them and no task holds more than
    its rows and the coefficients. Rows with nulls or NaN take no part.
    """
    _check(permutations, alpha)
    require(0 < test_size < 1, "test_size must lie between 0 and 1")
    spark = reference.sparkSession
    numbers = _numbered_rows(reference, current, [_vector(df, columns) for df in (reference, current)], seed, ["side"])
    counts = {r["side"]: r["last"] for r in numbers.groupBy("side").agg(F.max("position").alias("last")).collect()}
    sizes = (counts.get(0, 0), counts.get(1, 0))
    if min(sizes) < 2:
        raise NotEnoughDataError("two rows a side are needed")
    deal = _Deal(sizes, tuple(min(k - 1, max(1, round(k * test_size))) for k in sizes), permutations, seed)
    rows = numbers.mapInArrow(_with_parts(deal), "x array<double>, label binary, held binary").cache()
    try:
        weights = _fit_all(rows, deal, penalty, tolerance, rounds)
        scored = rows.mapInArrow(_scores(weights), "feature long, v double, r double, c double")
        found = {r["feature"]: r["auc"] for r in aucs(scored).collect()}  # a row a model
    finally:
        rows.unpersist()
    seen = found.pop(0)
    return null_test(spark, seen, spark.createDataFrame([(t,) for t in found.values()], "t double"), alpha)


@dataclass
class PcaReconstruction:
    """KS test between the reconstruction errors of reference and current rows under components fitted to the reference."""

    columns: Sequence[str]
    n_components: int | None = None
    variance: float = 0.9
    alpha: float = 0.05
    standardize: bool = False

    def detect(self, reference: DataFrame, current: DataFrame) -> DataFrame:
        """statistic, p_value, drift, n_components. Rows are centred first: projections of uncentred rows mean nothing."""
        sides = [_assembled(df, self.columns) for df in (reference, current)]
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=self.standardize).fit(sides[0])
        sides = [scaler.transform(df).select("z") for df in sides]
        width = sides[0].select(Summarizer.count(F.col("z")).alias("n"), Summarizer.mean(F.col("z")).alias("m")).first()
        require(len(width["m"]) >= 2, "at least two features are needed")
        if width["n"] < 2:
            raise NotEnoughDataError("two reference rows are needed")
        full = PCA(k=len(width["m"]), inputCol="z", outputCol="y").fit(sides[0])
        explained = np.cumsum(full.explainedVariance.toArray())
        k = self.n_components or int(np.searchsorted(explained, self.variance - 1e-12) + 1)
        require(1 <= k <= len(width["m"]), "n_components must be from 1 to the number of features")
        square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
        kept = F.slice(vector_to_array("y"), 1, k)  # components are orthonormal: the error is what the kept ones leave over
        errors = [full.transform(df).select(F.greatest(F.lit(0.0), square(vector_to_array("z")) - square(kept)).alias("error")) for df in sides]
        rows = cdf_statistics(pairs(*errors, ["error"]))
        p = ks_p(F.col("n"), F.col("m"), F.col("ks"))
        return rows.select(F.col("ks").alias("statistic"), p.alias("p_value")).withColumns({"drift": F.col("p_value") < self.alpha, "n_components": F.lit(k)})
