"""Severity, summaries and renderings of result rows."""

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("none", "low", "medium", "high")


def severity() -> Column:
    """Of a result row: none without drift, else by how far the score lies beyond its threshold."""
    ratio = F.col("score") / F.col("threshold")
    above = F.when(ratio >= 3, "high").when(ratio >= 1.5, "medium").otherwise("low")
    below = F.when(ratio <= 0.1, "high").when(ratio <= 0.5, "medium").otherwise("low")
    return F.when(~F.col("drift"), "none").when(F.col("threshold").isNull() | (F.col("threshold") == 0), "medium").when(F.col("comparator") == ">", above).otherwise(below)


def with_severity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", severity())


def summary(rows: DataFrame) -> DataFrame:
    """n_total, n_drifting, drift_rate, max_severity of result rows."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), severity())
    drifting = F.sum(F.col("drift").cast("int"))
    return rows.agg(F.count("*").alias("n_total"), F.coalesce(drifting, F.lit(0)).alias("n_drifting"), F.coalesce(drifting / F.count("*"), F.lit(0.0)).alias("drift_rate"), F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.max(level), F.lit(1)).cast("int")).alias("max_severity"))


def top_drifting(rows: DataFrame, limit: int) -> DataFrame:
    """The worst rows: drifting first, then by score, then by name."""
    return with_severity(rows).orderBy(F.desc("drift"), F.desc("score"), "feature").limit(limit)


def heatmap(history: DataFrame, time: str) -> DataFrame:
    """(feature, one column for each time) of scores, 0 where one is missing."""
    return history.groupBy("feature").pivot(time).agg(F.first("score")).na.fill(0.0)


def to_dict(rows: DataFrame) -> dict:
    """The report as plain data: schema_version, totals, items. A row for each check reaches the driver."""
    items = [r.asDict() for r in with_severity(rows).orderBy("feature").collect()]
    return {"schema_version": "1.0", **summary(rows).first().asDict(), "items": items}


def to_json(rows: DataFrame) -> str:
    return json.dumps(to_dict(rows), indent=2, default=str)


def notify(rows: DataFrame, sink) -> None:
    """Sends the rows, by feature, to an alert sink if any drifts."""
    found = {r["feature"]: r.asDict() for r in with_severity(rows).collect()}
    if any(r["drift"] for r in found.values()):
        sink.send(found)


def _number(x) -> str:
    return "-" if x is None else f"{x:.4g}"


def to_markdown(rows: DataFrame, limit: int = 100) -> str:
    lines = ["| check | method | drift | severity | score | threshold |", "|---|---|---|---|---|---|"]
    for r in top_drifting(rows, limit).collect():
        lines.append(f"| {r['feature']} | {r['method']} | {'yes' if r['drift'] else 'no'} | {r['severity']} | {_number(r['score'])} | {_number(r['threshold'])} |")
    return "\n".join(lines) + "\n"


def to_html(rows: DataFrame, title: str = "Drift report", limit: int = 1000) -> str:
    cells = []
    for r in top_drifting(rows, limit).collect():
        values = (r["feature"], r["method"], "yes" if r["drift"] else "no", r["severity"], _number(r["score"]), _number(r["threshold"]))
        cells.append(f"<tr class='{r['severity']}'>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in values) + "</tr>")
    head = "".join(f"<th>{h}</th>" for h in ("check", "method", "drift", "severity", "score", "threshold"))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{''.join(cells)}</table></body></html>"


def plot_shares(reference: DataFrame, current: DataFrame, column: str, most: int = 20) -> DataFrame:
    """(v, p, q): what a bar chart of a category shows; empty beyond `most` categories."""
    from driftspan.operators.distances import category_shares
    from driftspan.operators.pairs import pairs

    shares = category_shares(pairs(reference, current, [column], "string"))
    few = shares.agg(F.count("*").alias("k")).where(F.col("k") <= most)
    return shares.crossJoin(F.broadcast(few)).select("v", "p", "q")


def plot_quantiles(reference: DataFrame, current: DataFrame, column: str, steps: int = 100) -> DataFrame:
    """(share, reference, current): quantiles of a number on both sides, what a quantile plot shows."""
    shares = F.array(*(F.lit(i / steps) for i in range(steps + 1)))
    one = lambda df, n: df.agg(F.percentile(F.col(column), shares).alias("x")).select(F.posexplode("x").alias("i", n))
    return one(reference, "reference").join(one(current, "current"), "i").select((F.col("i") / steps).alias("share"), "reference", "current")
