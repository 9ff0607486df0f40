"""Registered queries over the driver's tables, each beside the SQL that gives the same rows where SQL can."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.functions.pvalues import chi2_p_even
from driftspan.operators import adaptation, binning, changepoint, detectors, distances, efficacy, legacy, monitoring, multivariate, online, preprocessing, report, sketches, windows
from driftspan.operators.pairs import pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, the others as they are."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def split(df: DataFrame, before) -> tuple[DataFrame, DataFrame]:
    return df.where(before), df.where(~before)


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split(table(spark, sf_dir, "orders"), F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))


def lineitems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split(table(spark, sf_dir, "lineitem"), F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split(table(spark, sf_dir, "events"), F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality, p (a share from the text's length) and z (p > 0.3)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", "quality", "toxic", F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("p")).withColumn("z", (F.col("p") > 0.3).cast("int"))


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_pairs(source: str, before: str, columns: list[str], kind: str = "DOUBLE", keys: str = "") -> str:
    side = f"CASE WHEN {before} THEN 1.0 ELSE 0.0 END::DOUBLE"
    parts = [f"SELECT {keys} '{c}' AS feature, {c}::{kind} AS v, {side} AS r, (1.0 - {side})::DOUBLE AS c FROM {source}" for c in columns]
    return "pr AS (" + " UNION ALL ".join(parts) + ")"


S_ORDERS = _sql_pairs("orders", "o_orderdate < TIMESTAMP '1998-01-01'", ["o_totalprice"])
S_LINES = _sql_pairs("lineitem", "l_shipdate < TIMESTAMP '1998-01-01'", LINE)
S_EVENTS = _sql_pairs("events", "ts < TIMESTAMP '2024-01-16'", ["value"])
S_TYPES = _sql_pairs("events", "ts < TIMESTAMP '2024-01-16'", ["event_type"], "VARCHAR")
S_STATUS = _sql_pairs("orders", "o_orderdate < TIMESTAMP '1998-01-01'", ["o_orderpriority", "o_orderstatus"], "VARCHAR")
_TENTHS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
S_QUANTILES = f"e0 AS (SELECT feature, unnest(quantile_cont(v, {_TENTHS})) AS x FROM pr WHERE r > 0 GROUP BY feature), edges AS (SELECT feature, list_sort(list_distinct(list(x))) AS edges FROM e0 GROUP BY feature)"
S_WIDTHS = "lim AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM pr WHERE r > 0 GROUP BY feature), edges AS (SELECT feature, list_sort(list_distinct(list_append(list_transform(range(10), lambda i: lo + (hi - lo) * i / 10), hi))) AS edges FROM lim)"
S_SHARES = """hist AS (SELECT feature, bin, sum(r) AS r, sum(c) AS c FROM (SELECT pr.feature, r, c, len(list_filter(edges[2:len(edges) - 1], lambda e: v >= e)) AS bin FROM pr JOIN edges USING (feature)) GROUP BY ALL),
spine AS (SELECT feature, unnest(range(len(edges) - 1)) AS bin FROM edges),
filled AS (SELECT s.feature, s.bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM spine s LEFT JOIN hist h ON s.feature = h.feature AND s.bin = h.bin),
shares AS (SELECT feature, bin, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q FROM filled)"""
S_PSI = "psi AS (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM (SELECT feature, CASE WHEN p <= 0 THEN 1e-6 ELSE p END AS a, CASE WHEN q <= 0 THEN 1e-6 ELSE q END AS b FROM shares) GROUP BY feature)"
S_DIV = """k1 AS (SELECT feature, greatest(p, 1e-12) AS p, greatest(q, 1e-12) AS q FROM shares),
k2 AS (SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM k1),
k3 AS (SELECT *, (p + q) / 2 AS m FROM k2),
div AS (SELECT feature, sum(p * ln(p / q)) AS kl_pq, sum(q * ln(q / p)) AS kl_qp, greatest((sum(p * ln(p / m)) + sum(q * ln(q / m))) / 2, 0) AS js, sum(abs(p - q)) / 2 AS tvd FROM k3 GROUP BY feature)"""
S_CDF = """vc AS (SELECT feature, v, sum(r) AS r, sum(c) AS c FROM pr GROUP BY ALL),
cdf AS (SELECT *, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m, coalesce(lead(v) OVER (PARTITION BY feature ORDER BY v) - v, 0) AS dv FROM vc WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT *, cr + cc - r - c + (r + c + 1) / 2 - (cr - r) AS ra, cr + cc - r - c + (r + c + 1) / 2 - (cc - c) AS ca FROM cdf),
stats AS (SELECT feature, max(n) AS n, max(m) AS m, max(abs(cr / n - cc / m)) AS ks, sum(abs(cr / n - cc / m) * dv) AS wasserstein, 2 * sum(pow(cr / n - cc / m, 2) * dv) AS energy,
 sum(n * (r * ra * ra - ra * r * (r + 1) + r * (r + 1) * (2 * r + 1) / 6) + m * (c * ca * ca - ca * c * (c + 1) + c * (c + 1) * (2 * c + 1) / 6)) / (max(n) * max(m) * (max(n) + max(m))) - (4 * max(n) * max(m) - 1) / (6 * (max(n) + max(m))) AS cvm FROM ranked GROUP BY feature)"""
_TERMS = " + ".join(f"{'-' if k % 2 == 0 else ''}exp(z * {k * k})" for k in range(1, 11))
S_KSP = f"ksp AS (SELECT *, CASE WHEN -z < 0.06 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * ({_TERMS}))) END AS p FROM (SELECT *, -2 * n * m / (n + m) * ks * ks AS z FROM stats))"
S_CHI = """cc0 AS (SELECT feature, v, sum(r) AS r, sum(c) AS c FROM pr GROUP BY ALL),
cc1 AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m FROM cc0),
chi AS (SELECT feature, sum(pow(r - (r + c) * n / (n + m), 2) / ((r + c) * n / (n + m)) + pow(c - (r + c) * m / (n + m), 2) / ((r + c) * m / (n + m))) AS statistic, count(*) - 1 AS df, sum(abs(r / n - c / m)) / 2 AS tvd FROM cc1 GROUP BY feature)"""


def _bh(source: str, p: str = "p", group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"""bh0 AS (SELECT *, {p} * count(*) OVER ({part}) / count(*) OVER ({part} ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS step FROM {source}),
bh AS (SELECT *, least(1.0, min(step) OVER ({part} ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) AS adj FROM bh0)"""


@query(f"WITH {S_ORDERS}, {S_QUANTILES}, {S_SHARES}, {S_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.binned(pairs(*orders(spark, sf_dir), ["o_totalprice"])).select("feature", "psi"))


@query(f"WITH {S_ORDERS}, {S_WIDTHS}, {S_SHARES}, {S_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.binned(pairs(*orders(spark, sf_dir), ["o_totalprice"]), strategy="uniform").select("feature", "psi"))


@query(f"WITH {S_LINES}, {S_QUANTILES}, {S_SHARES}, {S_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.binned(pairs(*lineitems(spark, sf_dir), LINE)).select("feature", "psi"))


@query(f"WITH {S_LINES}, {S_QUANTILES}, {S_SHARES}, {S_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def chunked_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = pairs(*lineitems(spark, sf_dir), LINE).withColumn("chunk", F.spark_partition_id())
    edges = binning.bin_edges(relation)
    shares = binning.merged_histograms(binning.chunk_counts(relation, edges, "chunk"), edges)
    return rounded(shares.groupBy("feature").agg(distances.psi_of(F.col("p"), F.col("q")).alias("psi")))


@query(f"WITH {S_ORDERS}, {S_QUANTILES}, {S_SHARES} SELECT feature, bin::INTEGER AS bin, round(p, 6) AS p, round(q, 6) AS q FROM shares")
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = pairs(*orders(spark, sf_dir), ["o_totalprice"])
    return rounded(binning.histograms(relation, binning.bin_edges(relation)).select("feature", "bin", "p", "q"))


def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = pairs(*orders(spark, sf_dir), ["o_totalprice"])
    return distances.divergences(binning.histograms(relation, binning.bin_edges(relation)))


_DIV = f"WITH {S_ORDERS}, {S_QUANTILES}, {S_SHARES}, {S_DIV} SELECT feature,"


@query(f"{_DIV} round(kl_pq, 6) AS kl_pq, round(kl_qp, 6) AS kl_qp FROM div")
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_divergence(spark, sf_dir).select("feature", "kl_pq", "kl_qp"))


@query(f"{_DIV} round(js, 6) AS js FROM div")
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_divergence(spark, sf_dir).select("feature", "js"))


@query(f"{_DIV} round(sqrt(js / ln(2)), 6) AS js_distance FROM div")
def js_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_divergence(spark, sf_dir).select("feature", "js_distance"))


def _cdf(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return rounded(distances.cdf_statistics(pairs(*events(spark, sf_dir), ["value"])).select("feature", *columns))


@query(f"WITH {S_EVENTS}, {S_CDF} SELECT feature, n, m, round(ks, 6) AS ks FROM stats")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdf(spark, sf_dir, "n", "m", "ks")


@query(f"WITH {S_EVENTS}, {S_CDF}, {S_KSP} SELECT feature, round(p, 6) AS p_value FROM ksp")
def ks_asymptotic_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.statistics(*events(spark, sf_dir), "ks", ["value"], p_limit=True)
    return rounded(rows.select("feature", F.col("raw_p_value").alias("p_value")))


@query(f"WITH {S_EVENTS}, {S_CDF} SELECT feature, round(cvm, 6) AS cvm FROM stats")
def cvm_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdf(spark, sf_dir, "cvm")


@query(f"WITH {S_LINES}, {S_CDF} SELECT feature, round(wasserstein, 4) AS wasserstein FROM stats")
def wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.cdf_statistics(pairs(*lineitems(spark, sf_dir), LINE)).select("feature", "wasserstein"), 4)


@query(f"WITH {S_ORDERS}, {S_CDF} SELECT feature, round(wasserstein, 4) AS wasserstein, round(ks, 6) AS ks FROM stats")
def sliced_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distances.cdf_statistics(pairs(*orders(spark, sf_dir), ["o_totalprice"]), slices=8)
    return rows.select("feature", F.round("wasserstein", 4).alias("wasserstein"), F.round("ks", 6).alias("ks"))


@query(f"WITH {S_EVENTS}, {S_CDF} SELECT feature, round(energy, 6) AS energy FROM stats")
def energy_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdf(spark, sf_dir, "energy")


@query(f"WITH {S_TYPES}, {S_CHI} SELECT feature, round(statistic, 6) AS statistic, df::INTEGER AS df FROM chi")
def chi2_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.chi_square(pairs(*events(spark, sf_dir), ["event_type"], "string")).select("feature", "statistic", "df"))


@query(f"WITH {S_TYPES}, {S_CHI} SELECT feature, round(exp(-statistic / 2) * (1 + statistic / 2), 6) AS p_value FROM chi")
def chi2_p_even_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distances.chi_square(pairs(*events(spark, sf_dir), ["event_type"], "string"))
    return rounded(rows.select("feature", chi2_p_even(F.col("statistic"), 4).alias("p_value")))


@query(f"WITH {S_TYPES}, {S_CHI} SELECT feature, round(exp(-statistic / 2) * (1 + statistic / 2), 6) AS p_value FROM chi")
def chi2_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detectors.statistics(*events(spark, sf_dir), "chi2", ["event_type"]).select("feature", F.col("raw_p_value").alias("p_value")))


@query(f"WITH {S_STATUS}, {S_CHI} SELECT feature, round(tvd, 6) AS tvd FROM chi")
def tvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.chi_square(pairs(*orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus"], "string")).select("feature", "tvd"))


_PARTS = """few AS (SELECT p_partkey AS i, p_size::DOUBLE AS u, p_retailprice / 100 AS v, p_partkey % 2 AS side FROM part),
pd AS (SELECT a.side AS a, b.side AS b, a.i = b.i AS same, pow(a.u - b.u, 2) + pow(a.v - b.v, 2) AS d2 FROM few a CROSS JOIN few b)"""


def _parts(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """Distance between the sizes and prices of even and odd parts, all pairs."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 100).alias("price"))
    return multivariate.pair_statistics(*split(rows, F.col("p_partkey") % 2 == 0), ["p_size", "price"], 0.01, methods=(method,))


@query(f"""WITH {_PARTS}
SELECT round(2 * avg(CASE WHEN a = 0 AND b = 1 THEN sqrt(d2) END) - avg(CASE WHEN a = 0 AND b = 0 THEN sqrt(d2) END)
  - avg(CASE WHEN a = 1 AND b = 1 THEN sqrt(d2) END), 6) AS energy FROM pd""")
def energy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_parts(spark, sf_dir, "energy").select("energy"))


@query(f"""WITH {_PARTS}
SELECT round(avg(CASE WHEN a = 0 AND b = 0 AND NOT same THEN exp(-0.01 * d2) END) + avg(CASE WHEN a = 1 AND b = 1 AND NOT same THEN exp(-0.01 * d2) END)
  - 2 * avg(CASE WHEN a = 0 AND b = 1 THEN exp(-0.01 * d2) END), 6) AS mmd2 FROM pd""")
def mmd_fixed_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_parts(spark, sf_dir, "mmd").select("mmd2"))


@query(f"""WITH {S_STATUS}, l0 AS (SELECT feature, v, sum(r) AS r, sum(c) AS c FROM pr GROUP BY ALL),
l1 AS (SELECT *, (r + 1) / (sum(r) OVER w + count(*) OVER w) AS p, (c + 1) / (sum(c) OVER w + count(*) OVER w) AS q, sum(c) OVER w AS m FROM l0 WINDOW w AS (PARTITION BY feature)),
l2 AS (SELECT feature, sum(pow(c - p * m, 2) / (p * m)) AS chi_square, sum(q * ln(q / p)) AS kl_post_prior, sum(p * ln(p / q)) AS kl_prior_post, sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2) AS js_distance FROM l1 GROUP BY feature)
SELECT feature, round(chi_square, 6) AS chi_square, round(kl_post_prior, 6) AS kl_post_prior, round(kl_prior_post, 6) AS kl_prior_post, round(js_distance, 6) AS js_distance FROM l2""")
def legacy_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.categorical_metrics(*orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus"])
    return rounded(rows.select("feature", "chi_square", "kl_post_prior", "kl_prior_post", "js_distance"))


@query(f"""WITH {S_ORDERS}, {S_CDF}, sh AS (SELECT min(v) AS lo, max(v) AS hi, count(*) FILTER (r > 0) AS nr, count(*) FILTER (c > 0) AS nc, stddev_samp(v) FILTER (r > 0) AS sr, stddev_samp(v) FILTER (c > 0) AS sc FROM pr),
g AS (SELECT lo + (hi - lo) * i / 99 AS x, sr * pow(nr, -0.2) AS hr, sc * pow(nc, -0.2) AS hc FROM sh, (SELECT unnest(range(100)) AS i)),
d AS (SELECT x, sum(r * exp(-pow((x - v) / hr, 2) / 2)) AS p, sum(c * exp(-pow((x - v) / hc, 2) / 2)) AS q FROM g, pr GROUP BY x),
s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM d)
SELECT feature, round(ks, 6) AS ks, round(wasserstein, 6) AS wasserstein, (SELECT round(sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2), 6) FROM s) AS js_distance FROM stats""")
def legacy_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(legacy.numeric_metrics(*orders(spark, sf_dir), ["o_totalprice"]).select("feature", "ks", "wasserstein", "js_distance"))


@query(f"WITH {S_LINES}, {S_CDF}, {S_KSP}, {_bh('ksp')} SELECT feature, round(ks, 6) AS statistic, round(p, 6) AS raw_p_value, round(adj, 6) AS p_value, adj < 0.05 AS drift FROM bh")
def univariate_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = lineitems(spark, sf_dir)
    rows = detectors.Univariate("ks", p_limit=True, columns=LINE).fit(a).detect_features(b)
    return rounded(rows.select("feature", "statistic", "raw_p_value", "p_value", "drift"))


@query(f"WITH {S_LINES}, {S_CDF}, {S_KSP} SELECT feature, round(least(1.0, p * count(*) OVER ()), 6) AS p_value FROM ksp")
def univariate_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = lineitems(spark, sf_dir)
    return rounded(detectors.Univariate("ks", correction="bonferroni", p_limit=True, columns=LINE).fit(a).detect_features(b).select("feature", "p_value"))


@query(f"WITH {S_LINES}, {S_QUANTILES}, {S_SHARES}, {S_PSI} SELECT round(max(psi), 6) AS score, max(psi) > 0.2 AS drift, count(*) AS n_features FROM psi")
def univariate_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = lineitems(spark, sf_dir)
    return rounded(detectors.Univariate("psi", columns=LINE).fit(a).detect(b).select("score", "drift", "n_features"))


_MIXED = ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
S_MIXED = f"""WITH {_sql_pairs("orders", "o_orderdate < TIMESTAMP '1998-01-01'", ["o_custkey", "o_totalprice"])}, {S_CDF}, {S_KSP}, {S_STATUS.replace("pr AS", "ps AS", 1)}, {S_CHI.replace("FROM pr", "FROM ps")},
mx AS (SELECT feature, 'ks' AS method, ks AS statistic, p FROM ksp UNION ALL SELECT feature, 'chi2', statistic, CASE WHEN df = 2 THEN exp(-statistic / 2) ELSE exp(-statistic / 2) * (1 + statistic / 2) END FROM chi), {_bh('mx')}"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (df.select(*_MIXED) for df in orders(spark, sf_dir))
    return detectors.MixedType(p_limit=True).fit(a).detect_features(b)


@query(f"{S_MIXED} SELECT feature, method, round(statistic, 6) AS statistic, round(adj, 6) AS p_value, adj < 0.05 AS drift FROM bh")
def mixed_type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_mixed(spark, sf_dir).select("feature", "method", "statistic", "p_value", "drift"))


@query(f"{S_MIXED} SELECT count(*) AS n_total, coalesce(sum((adj < 0.05)::INT), 0)::BIGINT AS n_drifting, round(avg((adj < 0.05)::INT), 6) AS drift_rate, (['none', 'low', 'medium', 'high'])[max(CASE WHEN adj >= 0.05 THEN 1 WHEN adj / 0.05 <= 0.1 THEN 4 WHEN adj / 0.05 <= 0.5 THEN 3 ELSE 2 END)] AS max_severity FROM bh")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.summary(_mixed(spark, sf_dir)))


S_ENSEMBLE = f"""WITH {S_LINES}, {S_QUANTILES}, {S_SHARES}, {S_PSI}, {S_DIV}, {S_CDF}, {S_KSP},
en AS (SELECT feature, (psi > 0.2)::INT AS d, least(1.0, psi / 0.2) AS f FROM psi UNION ALL SELECT feature, (js > 0.1)::INT, least(1.0, js / 0.1) FROM div UNION ALL SELECT feature, (p < 0.05)::INT, 1 - p FROM ksp)"""


@query(f"{S_ENSEMBLE} SELECT feature, sum(d) >= 2 AS drift, sum(d)::INTEGER AS votes, 2 AS required_votes FROM en GROUP BY feature")
def ensemble_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.Ensemble(("psi", "js", "ks"), columns=LINE, p_limit=True).detect(*lineitems(spark, sf_dir)).select("feature", "drift", "votes", "required_votes")


@query(f"{S_ENSEMBLE} SELECT feature, avg(f) >= 0.5 AS drift, round(avg(f), 6) AS stack_score FROM en GROUP BY feature")
def ensemble_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detectors.Ensemble(("psi", "js", "ks"), "stacking", columns=LINE, p_limit=True).detect(*lineitems(spark, sf_dir)).select("feature", "drift", "stack_score"))


_SLICE = S_CDF.replace("feature", "o_orderpriority")


@query(f"WITH {_sql_pairs('orders', 'o_orderdate < TIMESTAMP ' + chr(39) + '1998-01-01' + chr(39), ['o_totalprice'], keys='o_orderpriority,').replace(chr(39) + 'o_totalprice' + chr(39) + ' AS feature, ', '')}, {_SLICE}, {S_KSP}, {_bh('ksp')} SELECT o_orderpriority, round(ks, 6) AS statistic, round(adj, 6) AS p_value FROM bh")
def slice_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = orders(spark, sf_dir)
    rows = detectors.Univariate("ks", p_limit=True, columns=["o_totalprice"]).fit(a).detect_features(b, ["o_orderpriority"], 20)
    return rounded(rows.select("o_orderpriority", "statistic", "p_value"))


@query("""WITH st AS (SELECT ts, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS side FROM events WHERE ts IS NOT NULL),
gp AS (SELECT side, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY side ORDER BY ts))) / 1e6 AS gap FROM st),
md AS (SELECT median(gap) AS ref FROM gp WHERE side = 0 AND gap IS NOT NULL),
aw AS (SELECT median(abs(gap - ref)) AS away FROM gp, md WHERE side = 1 AND gap IS NOT NULL),
hr AS (SELECT hour(ts) AS h, sum((side = 0)::INT) AS p, sum((side = 1)::INT) AS q FROM st GROUP BY h),
hs AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM hr),
jd AS (SELECT sqrt((sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS hour_score FROM hs)
SELECT round(away / (ref + 1e-9), 6) AS cadence_score, round(hour_score, 6) AS hour_score, round(0.6 * away / (ref + 1e-9) + 0.4 * hour_score, 6) AS score FROM md, aw, jd""")
def datetime_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detectors.datetime_drift(*events(spark, sf_dir), "ts").select("cadence_score", "hour_score", "score"))


@query("""WITH h AS (
  SELECT l_shipdate < TIMESTAMP '1998-01-01' AS early, CASE WHEN l_orderkey % 7 > 0 THEN l_quantity END AS quantity, CASE WHEN l_partkey % 11 > 0 THEN l_tax END AS tax FROM lineitem),
m AS (SELECT avg(quantity) AS quantity, avg(tax) AS tax FROM h WHERE early)
SELECT early, count(*) AS n, round(avg(coalesce(h.quantity, m.quantity)), 6) AS quantity, round(avg(coalesce(h.tax, m.tax)), 6) AS tax,
  round(var_pop(coalesce(h.quantity, m.quantity)), 6) AS quantity_variance FROM h, m GROUP BY early""")
def missing_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with holes, nulls in one column and NaN in another, filled by the means of the early side."""
    holed = [df.select(
        F.when(F.col("l_orderkey") % 7 > 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_partkey") % 11 > 0, F.col("l_tax")).otherwise(float("nan")).alias("tax"),
    ) for df in lineitems(spark, sf_dir)]
    early, late = (df.withColumn("early", F.lit(e)) for df, e in zip(preprocessing.missing_values(*holed, "impute"), (True, False), strict=True))
    rows = early.unionByName(late).groupBy("early")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg("quantity").alias("quantity"), F.avg("tax").alias("tax"), F.var_pop("quantity").alias("quantity_variance")))


@query("""WITH a AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE part)),
b AS (SELECT CASE WHEN c = 'p_brand' THEN 'p_label' ELSE c END AS c, CASE WHEN c = 'p_size' THEN 'VARCHAR' ELSE t END AS t FROM a)
SELECT coalesce(a.c, b.c) AS "column", CASE WHEN a.c IS NULL THEN 'extra' WHEN b.c IS NULL THEN 'missing' WHEN a.t = b.t THEN 'same' ELSE 'retyped' END AS status FROM a FULL JOIN b ON a.c = b.c""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts against the parts with a renamed and a retyped column."""
    part = table(spark, sf_dir, "part")
    return preprocessing.schema_diff(part, part.withColumnRenamed("p_brand", "p_label").withColumn("p_size", F.col("p_size").cast("string")))


_NUM = "nm AS (SELECT event_type, event_id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL)"
_RUN = "(PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
_FIRST = "SELECT event_type, n, event_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM al WHERE score > lim) WHERE k = 1"


def _alarm(rows: DataFrame) -> DataFrame:
    return rounded(online.first_alarm(rows, "event_type", "event_id").select("event_type", "n", "event_id", "score"))


@query(f"WITH {_NUM}, wu AS (SELECT event_type, avg(x) AS t, stddev_pop(x) AS s FROM nm WHERE n <= 30 GROUP BY event_type), al AS (SELECT nm.*, abs(x - t) AS score, 3 * s AS lim FROM nm JOIN wu USING (event_type) WHERE n > 30) {_FIRST}")
def shewhart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(online.shewhart(table(spark, sf_dir, "events"), "value", "event_id", "event_type"))


@query(f"WITH {_NUM}, s0 AS (SELECT *, sum(x - 50 - 5) OVER {_RUN} AS up, sum(50 - x - 5) OVER {_RUN} AS dn FROM nm), al AS (SELECT *, greatest(up - least(0, min(up) OVER {_RUN}), dn - least(0, min(dn) OVER {_RUN})) AS score, 300 AS lim FROM s0) {_FIRST}")
def cusum_first_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(online.cusum(table(spark, sf_dir, "events"), "value", "event_id", "event_type", 50.0, 5.0, 300.0))


@query(f"WITH {_NUM}, a0 AS (SELECT *, x - avg(x) OVER {_RUN} AS aw FROM nm), s0 AS (SELECT *, sum(aw - 0.005) OVER {_RUN} AS up, sum(aw + 0.005) OVER {_RUN} AS dn FROM a0), al AS (SELECT *, greatest(up - least(0, min(up) OVER {_RUN}), greatest(0, max(dn) OVER {_RUN}) - dn) AS score, 500 AS lim FROM s0) {_FIRST}")
def page_hinkley_first_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(online.page_hinkley(table(spark, sf_dir, "events"), "value", "event_id", "event_type", threshold=500.0))


_ERR = "nm AS (SELECT event_type, event_id, (value > 90)::INT::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL)"


@query(f"""WITH {_ERR}, p0 AS (SELECT *, avg(x) OVER {_RUN} AS p FROM nm), p1 AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p0),
b0 AS (SELECT *, min(CASE WHEN n >= 30 THEN struct_pack(t := p + s, k := -n, p := p, s := s) END) OVER {_RUN} AS best FROM p1), al AS (SELECT *, p + s AS score, best.p + 2.0 * best.s AS lim FROM b0) {_FIRST}""")
def ddm_first_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(online.ddm(table(spark, sf_dir, "events"), (F.col("value") > 90).cast("int"), "event_id", "event_type", drift_level=2.0))


@query(f"""WITH {_ERR}, e0 AS (SELECT *, (n - lag(n) OVER (PARTITION BY event_type ORDER BY event_id))::DOUBLE AS gap, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS errors FROM nm WHERE x >= 0.5),
e1 AS (SELECT *, CASE WHEN gap IS NULL THEN 0 ELSE avg(gap) OVER {_RUN} + 2 * stddev_pop(gap) OVER {_RUN} END AS lim FROM e0), al AS (SELECT event_type, event_id, n, lim AS sc, 0.9 * max(CASE WHEN errors >= 30 THEN lim END) OVER {_RUN} AS top FROM e1)
SELECT event_type, n, event_id, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM al WHERE sc < top) WHERE k = 1""")
def eddm_first_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alarm(online.eddm(table(spark, sf_dir, "events"), (F.col("value") > 90).cast("int"), "event_id", "event_type"))


@query(f"""WITH {_NUM}, w AS (SELECT event_type, event_id, n - 1 AS t, count(*) OVER (PARTITION BY event_type) AS size, avg(x) OVER l AS a, avg(x) OVER r AS b, var_pop(x) OVER l AS va, var_pop(x) OVER r AS vb FROM nm WINDOW l AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT event_type, event_id, t, round(abs(a - b) / (sqrt((va + vb) / 2) + 1e-12), 6) AS stat FROM w WHERE t >= 30 AND t <= size - 30""")
def window_mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(changepoint.window_gaps(table(spark, sf_dir, "events"), "value", "event_id", "event_type"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def sliding_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").select("event_id", F.avg("value").over(windows.sliding("event_id", "event_type", 10)).alias("mean")))


@query("SELECT event_type, block, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT event_type, value, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50)::BIGINT AS block FROM events) GROUP BY ALL")
def tumbling_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("block", windows.block("event_id", "event_type", 50))
    return rounded(rows.groupBy("event_type", "block").agg(F.avg("value").alias("mean"), F.count("*").alias("n")))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS mean FROM events")
def expanding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").select("event_id", F.avg("value").over(windows.expanding("event_id", "event_type")).alias("mean")))


S_SCORED = "sc AS (SELECT l.doc_id, quality, toxic, least(1.0, n_chars / 5000)::DOUBLE AS p, (least(1.0, n_chars / 5000) > 0.3)::INT AS z FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(f"WITH {S_SCORED} SELECT round(avg(pow(p - quality, 2)), 6) AS brier FROM sc")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).agg(monitoring.brier("quality", "p").alias("brier")))


@query(f"WITH {S_SCORED} SELECT round(sum(n * abs(a - f)) / sum(n), 6) AS ece FROM (SELECT greatest(1, ceil(p * 10)) AS b, count(*) AS n, avg(quality) AS a, avg(p) AS f FROM sc GROUP BY b)")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.expected_calibration_error(scored(spark, sf_dir), "quality", "p"))


@query(f"""WITH {S_SCORED}, r0 AS (SELECT toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS n, avg(pow(p - quality, 2)) OVER (PARTITION BY toxic ORDER BY doc_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS cur FROM sc),
r1 AS (SELECT *, max(CASE WHEN n = 20 THEN cur END) OVER (PARTITION BY toxic) AS ref FROM r0)
SELECT toxic, doc_id, round(cur, 6) AS "current", round(ref, 6) AS reference, coalesce(n >= 20 AND cur > ref + 0.05, false) AS drift FROM r1""")
def rolling_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.rolling(scored(spark, sf_dir), F.pow(F.col("p") - F.col("quality"), 2), "doc_id", "toxic", 20, 0.05))


@query(f"""WITH {S_SCORED}, k AS (SELECT unnest([0, 1]) AS cls), pc AS (SELECT cls, sum((quality = cls AND z = cls)::INT) AS tp, sum((quality = cls)::INT) AS ac, sum((z = cls)::INT) AS sa FROM sc, k GROUP BY cls HAVING ac + sa > 0)
SELECT round(sum(tp) / sum(ac), 6) AS accuracy, round(avg(CASE WHEN sa > 0 THEN tp / sa ELSE 0 END), 6) AS "precision", round(avg(CASE WHEN ac > 0 THEN tp / ac ELSE 0 END), 6) AS recall, round(avg(CASE WHEN ac + sa > 0 THEN 2 * tp / (ac + sa) ELSE 0 END), 6) AS f1 FROM pc""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.classification_metrics(scored(spark, sf_dir), "quality", "z"))


@query(f"WITH {S_SCORED}, g AS (SELECT p, sum((quality = 1)::INT) AS po, sum((quality = 0)::INT) AS ne FROM sc GROUP BY p), h AS (SELECT *, coalesce(sum(ne) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(po * (below + ne / 2)) / (sum(po) * sum(ne)), 6) AS auc FROM h")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.auc(scored(spark, sf_dir), "quality", "p"))


@query("SELECT round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(sqrt(avg(pow(l_extendedprice - l_quantity * 1500, 2))), 4) AS rmse FROM lineitem")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return rounded(monitoring.regression_metrics(rows, "l_extendedprice", "guess"), 4)


@query(f"WITH {S_SCORED}, a AS (SELECT toxic, doc_id, p, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS n FROM sc), b AS (SELECT toxic, quality, row_number() OVER (PARTITION BY toxic ORDER BY doc_id DESC) AS n FROM sc WHERE doc_id % 3 > 0) SELECT a.toxic, a.doc_id, round(p, 6) AS p, quality FROM a LEFT JOIN b ON a.toxic = b.toxic AND a.n = b.n")
def delayed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    labels = rows.where("doc_id % 3 > 0").select("toxic", "quality", (-F.col("doc_id")).alias("arrived"))
    return rounded(monitoring.delayed_labels(rows.select("toxic", "doc_id", "p"), labels, "doc_id", "arrived", "toxic").select("toxic", "doc_id", "p", "quality"))


S_LABELLED = f"""{S_SCORED},
pa AS (SELECT toxic, p, z, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS i FROM sc),
la AS (SELECT toxic, quality AS y, -doc_id AS arrived, row_number() OVER (PARTITION BY toxic ORDER BY -doc_id) AS i FROM sc WHERE doc_id % 3 > 0),
s AS (SELECT toxic, arrived, i, p, z, y FROM pa JOIN la USING (toxic, i))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored, where two rows of three get a label, in an order of their own: the n-th label goes to the n-th prediction."""
    rows = scored(spark, sf_dir)
    labels = rows.where("doc_id % 3 > 0").select("toxic", "quality", (-F.col("doc_id")).alias("arrived"))
    return monitoring.delayed_labels(rows.select("toxic", "doc_id", "p", "z"), labels, "doc_id", "arrived", "toxic")


_MONITORED = ("accuracy", "precision", "recall", "f1", "auc")


@query(f"""WITH {S_LABELLED},
cells AS (
  SELECT e.toxic, e.i, cls, sum((x.y = cls AND x.z = cls)::INT) AS tp, sum((x.y = cls)::INT) AS ac, sum((x.z = cls)::INT) AS sa
  FROM s e JOIN s x ON x.toxic = e.toxic AND x.i BETWEEN e.i - 49 AND e.i, (SELECT unnest([0, 1]) AS cls) GROUP BY ALL HAVING ac + sa > 0),
f AS (
  SELECT toxic, i, sum(tp) / sum(ac) AS accuracy, avg(CASE WHEN sa > 0 THEN tp / sa ELSE 0 END) AS "precision",
    avg(CASE WHEN ac > 0 THEN tp / ac ELSE 0 END) AS recall, avg(2 * tp / (ac + sa)) AS f1 FROM cells GROUP BY toxic, i),
u AS (
  SELECT e.toxic, e.i, avg(CASE WHEN x.p > o.p THEN 1.0 WHEN x.p = o.p THEN 0.5 ELSE 0.0 END) AS auc
  FROM s e JOIN s x ON x.toxic = e.toxic AND x.i BETWEEN e.i - 49 AND e.i AND x.y = 1
  JOIN s o ON o.toxic = e.toxic AND o.i BETWEEN e.i - 49 AND e.i AND o.y = 0 GROUP BY ALL),
m AS (SELECT f.*, auc, arrived FROM f JOIN s USING (toxic, i) LEFT JOIN u USING (toxic, i)),
r AS (SELECT toxic, {", ".join(f'"{x}" AS reference_{x}' for x in _MONITORED)} FROM m WHERE i = 50),
d AS (SELECT *, {", ".join(f'CASE WHEN i >= 50 THEN reference_{x} - "{x}" END AS d_{x}' for x in _MONITORED)} FROM m LEFT JOIN r USING (toxic))
SELECT toxic, arrived, i AS position, least(i, 50) AS n, {", ".join(f'round("{x}", 6) AS "{x}"' for x in _MONITORED)},
  {", ".join(f"round(reference_{x}, 6) AS reference_{x}" for x in _MONITORED)}, round(greatest(0.0, {", ".join(f"coalesce(d_{x}, 0.0)" for x in _MONITORED)}), 6) AS change,
  concat_ws(',', {", ".join(f"CASE WHEN d_{x} > 0.05 THEN '{x}' END" for x in _MONITORED)}) AS degraded, coalesce(greatest({", ".join(f"d_{x}" for x in _MONITORED)}) > 0.05, false) AS drift FROM d""")
def performance_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitoring.performance_monitor(labelled(spark, sf_dir), "quality", "z", "arrived", ["toxic"], 50, _MONITORED, "p")
    return rounded(rows.withColumn("degraded", F.array_join("degraded", ",")))


@query(f"""WITH {S_LABELLED},
b AS (SELECT e.toxic, e.i, greatest(1, ceil(x.p * 10)) AS bin, sum(x.y - x.p) AS gap FROM s e JOIN s x ON x.toxic = e.toxic AND x.i BETWEEN e.i - 39 AND e.i GROUP BY ALL),
m AS (SELECT toxic, i, sum(abs(gap)) / least(i, 40) AS ece FROM b GROUP BY toxic, i),
r AS (SELECT toxic, ece AS reference_ece FROM m WHERE i = 40)
SELECT toxic, arrived, i AS position, least(i, 40) AS n, round(ece, 6) AS ece, round(reference_ece, 6) AS reference_ece,
  round(CASE WHEN i >= 40 THEN greatest(0.0, ece - reference_ece) ELSE 0.0 END, 6) AS change, coalesce(i >= 40 AND ece - reference_ece > 0.05, false) AS drift
FROM m JOIN s USING (toxic, i) LEFT JOIN r USING (toxic)""")
def rolling_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.calibration_monitor(labelled(spark, sf_dir), "quality", "p", "arrived", ["toxic"], 40).drop("degraded"))


@query(f"WITH {S_TYPES}, {S_CHI}, {S_EVENTS.replace('pr AS', 'pv AS', 1)}, {S_QUANTILES.replace('FROM pr', 'FROM pv')}, {S_SHARES.replace('FROM pr JOIN', 'FROM pv pr JOIN')}, {S_PSI} SELECT round(exp(-statistic / 2) * (1 + statistic / 2), 6) AS class_p, round(psi, 6) AS confidence_psi, exp(-statistic / 2) * (1 + statistic / 2) < 0.05 OR psi > 0.2 AS drift FROM chi, psi")
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.prediction_drift(*events(spark, sf_dir), "event_type", "value").select("class_p", "confidence_psi", "drift"))


@query(f"WITH {S_SCORED} SELECT doc_id, round(greatest(p, 1 - p), 6) AS confidence, round(-(greatest(p, 1e-12) * ln(greatest(p, 1e-12)) + greatest(1 - p, 1e-12) * ln(greatest(1 - p, 1e-12))), 6) AS entropy FROM sc")
def confidence_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, entropy = monitoring.confidence_entropy(F.array(1 - F.col("p"), F.col("p")))
    return rounded(scored(spark, sf_dir).select("doc_id", top.alias("confidence"), entropy.alias("entropy")))


@query("SELECT o_orderkey, round(pow(0.5, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) - 1) / 100.0), 6) AS weight FROM orders")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adaptation.recency_weights(table(spark, sf_dir, "orders"), "o_orderkey", 100.0, "o_orderpriority").select("o_orderkey", "weight"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 50")
def select_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptation.select_sliding(table(spark, sf_dir, "orders"), "o_orderkey", 50, "o_orderpriority").select("o_orderpriority", "o_orderkey")


@query(f"WITH {S_SCORED} SELECT round(avg((quality = z)::INT), 6) AS champion_score, round(avg((quality = 1)::INT), 6) AS challenger_score, round(avg((quality = 1)::INT) - avg((quality = z)::INT), 6) AS improvement, avg((quality = 1)::INT) - avg((quality = z)::INT) > 0.01 AS promote FROM sc")
def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adaptation.champion_challenger(scored(spark, sf_dir).withColumn("one", F.lit(1)), "quality", "z", "one", min_improvement=0.01))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) % 25 = 0 AS retrain FROM orders")
def periodic_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptation.periodic(table(spark, sf_dir, "orders"), "o_orderkey", 25, "o_orderpriority").select("o_orderkey", "retrain")


@query("SELECT event_type AS feature, coalesce(round(avg(value) FILTER (day(ts) < 11), 6), 0) AS d1, coalesce(round(avg(value) FILTER (day(ts) >= 11 AND day(ts) < 21), 6), 0) AS d2, coalesce(round(avg(value) FILTER (day(ts) >= 21), 6), 0) AS d3 FROM events GROUP BY event_type")
def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.when(F.dayofmonth("ts") < 11, "d1").when(F.dayofmonth("ts") < 21, "d2").otherwise("d3")
    history = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature"), third.alias("t")).agg(F.round(F.avg("value"), 6).alias("score"))
    return report.heatmap(history, "t")


@query(f"WITH {S_LINES}, {S_QUANTILES}, {S_SHARES}, {S_PSI} SELECT feature, round(psi, 6) AS score, CASE WHEN psi <= 0.0001 THEN 'none' WHEN psi / 0.0001 >= 3 THEN 'high' WHEN psi / 0.0001 >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM psi ORDER BY psi > 0.0001 DESC, psi DESC, feature LIMIT 2")
def top_drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = lineitems(spark, sf_dir)
    rows = detectors.Univariate("psi", threshold=0.0001, columns=LINE).fit(a).detect_features(b)
    return rounded(report.top_drifting(rows, 2).select("feature", "score", "severity"))


@query(f"WITH {S_STATUS}, {S_CHI} SELECT feature, v, round(r / n, 6) AS p, round(c / m, 6) AS q FROM cc1 WHERE feature = 'o_orderstatus'")
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.category_shares(pairs(*orders(spark, sf_dir), ["o_orderstatus"], "string")).select("feature", "v", "p", "q"))


S_CUSUM = f"""WITH RECURSIVE {_NUM.replace(" AS (", " AS MATERIALIZED (", 1)},
run AS (
  SELECT event_type, 0::BIGINT AS event_id, 0::BIGINT AS n, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS fired FROM nm WHERE n = 1
  UNION ALL
  SELECT event_type, event_id, n, up, dn, greatest(up, dn) > 300 FROM (
    SELECT nm.event_type, nm.event_id, nm.n, greatest(0.0, CASE WHEN fired THEN 0.0 ELSE up END + (x - 50) - 5) AS up, greatest(0.0, CASE WHEN fired THEN 0.0 ELSE dn END - (x - 50) - 5) AS dn
    FROM run JOIN nm ON nm.event_type = run.event_type AND nm.n = run.n + 1))
SELECT event_type, event_id, round(greatest(up, dn), 6) AS score FROM run WHERE fired"""

S_EWMA = f"""WITH RECURSIVE {_NUM.replace(" AS (", " AS MATERIALIZED (", 1)},
wu AS MATERIALIZED (SELECT event_type, avg(x) AS target, stddev_pop(x) AS sigma FROM nm WHERE n <= 30 GROUP BY event_type HAVING count(*) = 30),
run AS (
  SELECT event_type, 30::BIGINT AS n, target AS z FROM wu
  UNION ALL
  SELECT nm.event_type, nm.n, 0.2 * x + 0.8 * z FROM run JOIN nm ON nm.event_type = run.event_type AND nm.n = run.n + 1),
far AS (SELECT event_type, n, abs(z - target) AS score, 3 * sigma * sqrt(0.2 / 1.8) AS lim FROM run JOIN wu USING (event_type) WHERE n > 30)
SELECT event_type, event_id, round(coalesce(score, 0), 6) AS score, coalesce(score > lim, false) AS drift FROM nm LEFT JOIN far USING (event_type, n)"""

# Daily means, each series centred, and the squared error of every stretch from a up to b.
S_STRETCHES = """d0 AS (SELECT event_type, ts::DATE AS day, avg(value) AS mean FROM events GROUP BY ALL),
d1 AS (SELECT event_type, mean - avg(mean) OVER (PARTITION BY event_type) AS x, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d0 WHERE mean IS NOT NULL),
cost AS MATERIALIZED (SELECT e.event_type, s.i - 1 AS a, e.i AS b, sum(p.x * p.x) - pow(sum(p.x), 2) / count(*) AS cost FROM d1 s JOIN d1 e ON s.event_type = e.event_type AND s.i <= e.i JOIN d1 p ON p.event_type = s.event_type AND p.i BETWEEN s.i AND e.i GROUP BY ALL)"""

S_BINARY = f"""WITH RECURSIVE {S_STRETCHES},
gains AS (SELECT w.event_type, w.a, l.b AS cut, w.b, w.cost - l.cost - r.cost AS gain FROM cost w JOIN cost l ON l.event_type = w.event_type AND l.a = w.a JOIN cost r ON r.event_type = w.event_type AND r.a = l.b AND r.b = w.b WHERE l.b - w.a >= 2 AND w.b - l.b >= 2),
best AS MATERIALIZED (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY event_type, a, b ORDER BY gain DESC, cut) = 1),
open AS (
  SELECT event_type, 0::BIGINT AS a, max(b) AS b FROM cost GROUP BY event_type
  UNION ALL
  SELECT event_type, CASE WHEN side = 0 THEN a ELSE cut END, CASE WHEN side = 0 THEN cut ELSE b END FROM (SELECT open.event_type, open.a, open.b, cut FROM open JOIN best ON best.event_type = open.event_type AND best.a = open.a AND best.b = open.b WHERE gain > 100) CROSS JOIN (VALUES (0), (1)) AS t(side))
SELECT event_type, cut AS change_point, round(gain, 6) AS score FROM open JOIN best USING (event_type, a, b) WHERE gain > 100"""

# The least cost up to each end in turn, and where its last stretch began; then from the last end back.
S_PELT = f"""WITH RECURSIVE {S_STRETCHES},
ends AS MATERIALIZED (SELECT event_type, b, list(cost ORDER BY a) AS costs FROM cost GROUP BY ALL),
run AS (
  SELECT DISTINCT event_type, 0::BIGINT AS b, [-100.0::DOUBLE] AS best, [0::BIGINT] AS came FROM ends
  UNION ALL
  SELECT event_type, b, list_append(best, list_min(tried)), list_append(came, list_position(tried, list_min(tried))::BIGINT - 1) FROM (
    SELECT ends.event_type, ends.b, best, came, list_transform(range(1, ends.b + 1), lambda j: best[j] + costs[j] + 100) AS tried FROM run JOIN ends ON ends.event_type = run.event_type AND ends.b = run.b + 1)),
last AS MATERIALIZED (SELECT event_type, b, came FROM run QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY b DESC) = 1),
back AS (
  SELECT event_type, came[b + 1] AS cut, came FROM last
  UNION ALL
  SELECT event_type, came[cut + 1], came FROM back WHERE cut > 0)
SELECT event_type, cut AS change_point FROM back WHERE cut > 0"""


@query(S_CUSUM)
def cusum_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = online.fold(table(spark, sf_dir, "events"), lambda: online.Cusum(50.0, 5.0, 300.0), "value", "event_id", "event_type")
    return rounded(rows.where("drift").select("event_type", "event_id", "score"))


@query(S_EWMA)
def ewma_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(online.ewma(table(spark, sf_dir, "events"), "value", "event_id", "event_type").select("event_type", "event_id", "score", "drift"))


@query()
def kswin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = online.fold(table(spark, sf_dir, "events"), online.Kswin, "value", "event_id", "event_type")
    return rounded(rows.where("drift").select("event_type", "event_id", "score"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))


@query(S_BINARY)
def binary_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(changepoint.binary_segments(_daily(spark, sf_dir), "mean", "day", "event_type", 100.0))


@query(S_PELT)
def pelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoint.by_series(_daily(spark, sf_dir), lambda x: changepoint.pelt(x, 100.0), "mean", "day", "event_type").select("event_type", "change_point")


@query()
def permutation_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multivariate.wasserstein_test(*events(spark, sf_dir), "value"))


@query()
def bootstrap_ci_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multivariate.bootstrap_psi(*orders(spark, sf_dir), "o_totalprice"))


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.select(F.size("embedding")).first()
    names = [f"e{i}" for i in range(first[0] if first else 0)]
    wide = rows.select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)))
    return *split(wide, F.col("vec_id") % 2 == 0), names


S_VECTORS = """vectors AS (SELECT vec_id AS i, vec_id % 2 AS side, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
apart AS (SELECT a.side AS a, b.side AS b, a.i = b.i AS same, list_distance(a.x, b.x) AS d FROM vectors a CROSS JOIN vectors b)"""


@query(f"""WITH {S_VECTORS}, g AS (SELECT 1 / (2 * median(d * d)) AS gamma FROM apart WHERE d > 0)
SELECT round(avg(exp(-gamma * d * d)) FILTER (a = 0 AND b = 0 AND NOT same) + avg(exp(-gamma * d * d)) FILTER (a = 1 AND b = 1 AND NOT same) - 2 * avg(exp(-gamma * d * d)) FILTER (a = 0 AND b = 1), 6) AS statistic FROM apart, g""")
def mmd_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic of mmd_permutation: all rows and dimensions, gamma by the median of all pairs."""
    a, b, names = _embeddings(spark, sf_dir)
    return rounded(multivariate.two_sample_test(a, b, "mmd", names, permutations=1).select("statistic"))


@query(f"WITH {S_VECTORS} SELECT round(2 * avg(d) FILTER (a = 0 AND b = 1) - avg(d) FILTER (a = 0 AND b = 0) - avg(d) FILTER (a = 1 AND b = 1), 6) AS statistic FROM apart")
def energy_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic of energy_permutation: all rows and dimensions."""
    a, b, names = _embeddings(spark, sf_dir)
    return rounded(multivariate.two_sample_test(a, b, "energy", names, permutations=1).select("statistic"))


@query()
def mmd_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, names = _embeddings(spark, sf_dir)
    return rounded(multivariate.two_sample_test(a, b, "mmd", names))


@query()
def energy_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, names = _embeddings(spark, sf_dir)
    return rounded(multivariate.two_sample_test(a, b, "energy", names))


@query()
def c2st(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, names = _embeddings(spark, sf_dir)
    return rounded(multivariate.classifier_test(a, b, names))


@query()
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, names = _embeddings(spark, sf_dir)
    return rounded(multivariate.PcaReconstruction(names).detect(a, b))


@query()
def ml_efficacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = orders(spark, sf_dir)
    return rounded(efficacy.evaluate(a, b, "o_orderstatus", ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"], trees=5), 4)


_CLASSES = ("F", "O", "P")
_SHARES = """[CASE WHEN o_orderdate < TIMESTAMP '1995-03-17' THEN w ELSE (1 - w) / 2 END, CASE WHEN o_orderdate < TIMESTAMP '1995-03-17' THEN (1 - w) / 2 ELSE w END, (1 - w) / 2]"""
_REPORT = ("accuracy", "precision", "recall", "f1", "roc_auc")
_RATIOS = """coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS roc_auc"""


@query(f"""WITH b AS (SELECT o_orderstatus AS y, o_orderdate, (o_totalprice % 100) / 100 AS w, t AS side FROM orders, (SELECT unnest(['price', 'date']) AS t)),
s AS (SELECT side, y, {_SHARES} AS q, CASE WHEN side = 'price' THEN CASE WHEN w < 0.3 THEN 'F' WHEN w < 0.8 THEN 'O' ELSE 'P' END ELSE CASE WHEN o_orderdate < TIMESTAMP '1995-03-17' THEN 'F' ELSE 'O' END END AS z FROM b),
cl AS (SELECT unnest({list(_CLASSES)}) AS class, unnest([1, 2, 3]) AS i),
cells AS (SELECT side, class, sum((y = class AND z = class)::INT) AS tp, sum((y <> class AND z = class)::INT) AS fp, sum((y = class AND z <> class)::INT) AS fn, sum((y <> class AND z <> class)::INT) AS tn, sum((y = class)::INT) AS n, count(*) AS total FROM s, cl GROUP BY ALL),
long AS (SELECT side, class, q[i] AS v, (y = class)::INT AS r FROM s, cl UNION ALL SELECT side, '{efficacy.MICRO}', q[i], (y = class)::INT FROM s, cl),
ranks AS (SELECT *, sum(1 - r) OVER (PARTITION BY side, class ORDER BY v RANGE UNBOUNDED PRECEDING) - sum(1 - r) OVER (PARTITION BY side, class, v) / 2 AS below FROM long),
areas AS (SELECT side, class, sum(r * below) / (sum(r) * sum(1 - r)) AS score_auc FROM ranks GROUP BY ALL),
p AS (SELECT side, class, {_RATIOS}, tn, fp, fn, tp, n, score_auc, total FROM cells JOIN areas USING (side, class)),
added AS (SELECT side, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp, max(total) AS n FROM cells GROUP BY side),
micro AS (SELECT side, '{efficacy.MICRO}' AS class, {_RATIOS}, tn, fp, fn, tp, n FROM added),
everything AS (
  SELECT side, class, {", ".join(f'"{m}"' for m in _REPORT)}, tn, fp, fn, tp, n, score_auc FROM p
  UNION ALL SELECT side, class, recall, "precision", recall, f1, roc_auc, tn, fp, fn, tp, n, score_auc FROM micro JOIN areas USING (side, class)
  UNION ALL SELECT side, '{efficacy.MACRO}', {", ".join(f'avg("{m}")' for m in _REPORT)}, sum(tn), sum(fp), sum(fn), sum(tp), max(total), avg(score_auc) FROM p GROUP BY side
  UNION ALL SELECT side, '{efficacy.WEIGHTED}', {", ".join(f'sum("{m}" * n) / max(total)' for m in _REPORT)}, sum(tn), sum(fp), sum(fn), sum(tp), max(total), sum(score_auc * n) / max(total) FROM p GROUP BY side)
SELECT side, class, {", ".join(f'round("{m}", 6) AS "{m}"' for m in _REPORT)}, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, n::BIGINT AS n, round(score_auc, 6) AS score_auc FROM everything""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules that guess an order's status, by price and by date, held against it class by class."""
    w, early = F.col("w"), F.col("o_orderdate") < F.lit("1995-03-17").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").withColumn("w", (F.col("o_totalprice") % 100) / 100)
    shares = F.array(F.when(early, w).otherwise((1 - w) / 2), F.when(early, (1 - w) / 2).otherwise(w), (1 - w) / 2)
    by_price = F.when(w < 0.3, "F").when(w < 0.8, "O").otherwise("P")
    said = F.array(F.struct(F.lit("price").alias("side"), by_price.alias("z")), F.struct(F.lit("date").alias("side"), F.when(early, "F").otherwise("O").alias("z")))
    scored = rows.select("o_orderstatus", shares.alias("q"), F.explode(said).alias("x")).select("o_orderstatus", "q", "x.*")
    return rounded(efficacy.class_report(scored, "side", ["price", "date"], "o_orderstatus", "z", "q", _CLASSES))


S_COHORTS = _sql_pairs("events", "ts < TIMESTAMP '2024-01-16'", ["value"], keys="event_type,")


@query(f"""WITH {S_COHORTS},
e0 AS (SELECT 1 - grouping(event_type) AS level, event_type, unnest(quantile_cont(v, {_TENTHS})) AS x FROM pr WHERE r > 0 GROUP BY ROLLUP (event_type)),
edges AS (SELECT level, event_type, list_sort(list_distinct(list(x))) AS edges FROM e0 GROUP BY ALL),
hist AS (SELECT level, e.event_type, len(list_filter(edges[2:len(edges) - 1], lambda e: v >= e)) AS bin, sum(r) AS r, sum(c) AS c FROM pr JOIN edges e ON level = 0 OR pr.event_type = e.event_type GROUP BY ALL),
spine AS (SELECT level, event_type, unnest(range(len(edges) - 1)) AS bin FROM edges),
f AS (SELECT s.level, s.event_type, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM spine s LEFT JOIN hist h ON s.level = h.level AND s.event_type IS NOT DISTINCT FROM h.event_type AND s.bin = h.bin),
q AS (SELECT *, sum(r) OVER w AS n, sum(c) OVER w AS m FROM f WINDOW w AS (PARTITION BY level, event_type)),
z AS (SELECT level, event_type, n, m, CASE WHEN r = 0 THEN 1e-6 ELSE r / n END AS a, CASE WHEN c = 0 THEN 1e-6 ELSE c / m END AS b FROM q)
SELECT level::INT AS level, event_type, 'value' AS feature, round(sum((b - a) * ln(b / a)), 6) AS statistic, n, m FROM z GROUP BY ALL""")
def rollup_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI of all events and of each type, from one count of the values."""
    return rounded(detectors.rollup(*events(spark, sf_dir), "psi", ["event_type"], ["value"]).drop("raw_p_value"))


@query(f"""WITH {_sql_pairs("orders", "o_orderdate < TIMESTAMP '1998-01-01'", ["o_totalprice"], keys="o_orderpriority, o_orderstatus,")},
lv AS (SELECT level, CASE WHEN level > 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN level > 1 THEN o_orderstatus END AS o_orderstatus, v, sum(r) AS r, sum(c) AS c FROM pr, range(3) AS t(level) GROUP BY ALL),
run AS (SELECT *, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER g AS n, sum(c) OVER g AS m FROM lv WINDOW w AS (PARTITION BY level, o_orderpriority, o_orderstatus ORDER BY v), g AS (PARTITION BY level, o_orderpriority, o_orderstatus))
SELECT level::INT AS level, o_orderpriority, o_orderstatus, 'o_totalprice' AS feature, round(max(abs(cr / n - cc / m)), 6) AS statistic, n, m FROM run GROUP BY ALL""")
def rollup_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KS statistics of all orders, by priority, and by priority and status."""
    return rounded(detectors.rollup(*orders(spark, sf_dir), "ks", ["o_orderpriority", "o_orderstatus"], ["o_totalprice"]).drop("raw_p_value"))


@query()
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenths of the first half month's values from daily sketches, and whether their exact ranks keep the sketch's bound."""
    rows = table(spark, sf_dir, "events").select(F.lit("value").alias("feature"), F.col("value").cast("double").alias("v"), F.to_date("ts").alias("day"))
    half = F.lit("2024-01-15").cast("date")
    whole = sketches.merged(sketches.sketch_chunks(rows, "day"), last=half)
    found = sketches.rank_errors(sketches.sketch_quantiles(whole, [i / 10 for i in range(11)]), rows.where(F.col("day") <= half))
    return rounded(found.withColumn("within", F.col("error") <= sketches.rank_bound(400)))


# Each batch is a feature of its own, beside the whole baseline.
S_BATCHES = """pr AS (SELECT t.i::VARCHAR AS feature, value AS v, 1.0::DOUBLE AS r, 0.0::DOUBLE AS c FROM events CROSS JOIN range(4) AS t(i) WHERE ts < TIMESTAMP '2024-01-16' AND value IS NOT NULL
 UNION ALL SELECT (event_id % 4)::VARCHAR, value, 0.0, 1.0 FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND value IS NOT NULL)"""


@query(f"WITH {S_BATCHES}, {S_QUANTILES}, {S_SHARES}, {S_PSI} SELECT feature::BIGINT AS \"window\", 'value' AS feature, round(psi, 6) AS score, psi > 0.2 AS drift FROM psi")
def stream_psi_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI of four batches of events, replayed in order of event_id, against the first half month."""
    from uuid import uuid4

    from driftspan.streaming.monitor import StreamMonitor

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", "/tmp/driftspan")
    monitor = StreamMonitor(spark, f"{shared}/stream-{uuid4().hex}", detectors.Univariate("psi", columns=["value"]))
    base, rest = events(spark, sf_dir)
    monitor.set_baseline(base.select("value"))
    for i in range(4):
        monitor.process(rest.where(F.col("event_id") % 4 == i).select("value"), i)
    return rounded(monitor.scores())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI, divergences and distances of lineitem's numbers before and after 1998, with severities."""
    a, b = lineitems(spark, sf_dir)
    parts = [detectors.Univariate(m, columns=LINE, threshold=t).fit(a).detect_features(b) for m, t in (("psi", None), ("js", None), ("ks", None), ("wasserstein", 100.0))]
    return report.with_severity(reduce(DataFrame.unionByName, parts))


