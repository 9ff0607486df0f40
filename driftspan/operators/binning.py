"""Histograms of both samples over bins that the reference alone defines."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.errors import require
from driftspan.operators.pairs import few, running_counts, value_counts

STRATEGIES = ("quantile", "uniform", "approx", "kll")
LITERAL = 16  # features whose edges are written into the expression

Edges = DataFrame | dict[str, list[float]]


def exact_quantiles(counts: DataFrame, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, raw): the interpolated quantiles of the rows that r counts, in the order of rising shares.

    counts has a row a value, as value_counts gives it, with r above 0. Values are selected by their running counts: no task
    holds or sorts a whole feature. The quantile of a share s lies at position (n - 1) s among the sorted rows, between the
    rows before and after it.
    """
    by = [*keys, "feature"]
    rows = running_counts(counts, keys, counted=True)
    place = lambda s: (F.col("n") - 1) * F.lit(s)
    lower = lambda s: F.floor(place(s))
    value = lambda s: F.when(F.ceil(place(s)) == lower(s), F.col("v")).otherwise((F.ceil(place(s)) - place(s)) * F.col("v") + (place(s) - lower(s)) * F.when(lower(s) + 1 < F.col("cr"), F.col("v")).otherwise(F.col("next")))
    inside = lambda s: (F.col("cr") - F.col("r") <= lower(s)) & (lower(s) < F.col("cr"))
    found = rows.select(*by, F.array_compact(F.array(*(F.when(inside(s), value(s)) for s in shares))).alias("found")).where("size(found) > 0")
    return found.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("raw"))  # a number a share


def bin_edges(relation: DataFrame, bins: int = 10, strategy: str = "quantile", accuracy: int = 400, keys: Sequence[str] = (), counted: bool = False) -> DataFrame:
    """(keys..., feature, edges): increasing distinct edges from the reference rows (r = 1) of pairs().

    counted: relation has a row a value, as value_counts gives it; sketches want rows.

    quantile: exact, interpolated. approx, kll: sketches of bounded size, from one pass.
    uniform: equal widths. A constant reference has the two edges v and v + 1.
    """
    require(bins >= 1, "bins must be at least 1")
    require(strategy in STRATEGIES, f"strategy must be one of {', '.join(STRATEGIES)}")
    require(not counted or strategy in ("quantile", "uniform"), "sketches are of rows, not of counts")
    reference = relation.where("r > 0").groupBy(*keys, "feature")
    if strategy == "uniform":
        rows = reference.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        raw = F.concat(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins), F.array("hi"))
    elif strategy == "kll":
        rows = reference.agg(F.kll_sketch_agg_double("v", F.lit(min(max(accuracy, 8), 65535))).alias("sketch"))
        raw = F.array(*(F.expr(f"kll_sketch_get_quantile_double(sketch, {i / bins}D)") for i in range(bins + 1)))
    else:
        shares = [i / bins for i in range(bins + 1)]
        if strategy == "quantile":
            rows = exact_quantiles((relation if counted else value_counts(relation, keys)).where("r > 0"), shares, keys)
        else:
            rows = reference.agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), accuracy).alias("raw"))
        raw = F.col("raw")
    distinct = F.array_sort(F.array_distinct(raw))
    return rows.select(*keys, "feature", distinct.alias("edges")).withColumn("edges", F.when(F.size("edges") < 2, F.array(F.col("edges")[0], F.col("edges")[0] + 1)).otherwise(F.col("edges")))


def bin_of(v: Column, edges: Column) -> Column:
    """Number of the half-open bin; values beyond the ends are in the first or last bin, the last is closed."""
    inner = F.slice(edges, F.lit(2), F.size(edges) - 2)
    return F.size(F.filter(inner, lambda e: v >= e))


def known_edges(edges: DataFrame) -> Edges:
    """The edges themselves, by feature, if there are at most LITERAL features, else `edges`: comparisons with numbers cost a
    third of a join, and a row a feature is all the driver gets."""
    rows = edges.limit(LITERAL + 1).collect()
    return {r["feature"]: list(r["edges"]) for r in rows} if len(rows) <= LITERAL else edges


def _with_bins(relation: DataFrame, edges: Edges, keys: Sequence[str]) -> DataFrame:
    """relation with bin and bins; rows of features without edges are left out."""
    if isinstance(edges, DataFrame):
        return relation.join(few(edges, keys), [*keys, "feature"]).withColumns({"bin": bin_of(F.col("v"), F.col("edges")), "bins": F.size("edges") - 1})
    bin_, bins = F.lit(None).cast("int"), F.lit(None).cast("int")
    for feature, e in edges.items():
        number = sum(((F.col("v") >= x).cast("int") for x in e[1:-1]), F.lit(0))
        bin_, bins = F.when(F.col("feature") == feature, number).otherwise(bin_), F.when(F.col("feature") == feature, len(e) - 1).otherwise(bins)
    return relation.withColumns({"bin": bin_, "bins": bins}).where("bin is not null")


def histograms(relation: DataFrame, edges: Edges, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, bin, p, q, n, m): shares of the reference and the current rows in every bin, empty ones too, and both sizes.

    relation has rows, or counts by value; edges a row for each feature (and cohort), or, without keys, are given by feature.
    One aggregation over the data, no sort.
    """
    by = [*keys, "feature"]
    binned = _with_bins(relation, edges, keys)
    counted = binned.groupBy(*by, "bin").agg(F.max("bins").alias("bins"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    filled = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c"))))
    whole = counted.groupBy(*by).agg(F.max("bins").alias("bins"), filled.alias("found"), F.sum("r").alias("n"), F.sum("c").alias("m"))
    rows = whole.select(*by, F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "found", "n", "m")
    share = lambda x, total: F.coalesce(F.try_element_at("found", F.col("bin"))[x], F.lit(0.0)) / F.greatest(F.col(total), F.lit(1.0))
    return rows.select(*by, "bin", share("r", "n").alias("p"), share("c", "m").alias("q"), "n", "m")


def chunk_counts(chunks: DataFrame, edges: DataFrame, chunk: str) -> DataFrame:
    """(chunk, feature, bin, r, c): counts of each chunk in fixed bins; chunks may be counted at different times."""
    counted = chunks.join(few(edges), "feature").withColumn("bin", bin_of(F.col("v"), F.col("edges")))
    return counted.groupBy(chunk, "feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def merged_histograms(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """As histograms(), from chunk_counts() of any number of chunks. Counts are exact, so the result is that of one pass."""
    total = counts.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    spine = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    whole = Window.partitionBy("feature")
    filled = spine.join(total, ["feature", "bin"], "left").na.fill(0.0, ["r", "c"])
    return filled.select("feature", "bin", *((F.col(x) / F.greatest(F.sum(x).over(whole), F.lit(1.0))).alias(y) for x, y in (("r", "p"), ("c", "q"))))
