"""Command line: python -m driftspan.cli check | report | benchmark."""

import argparse
import csv
import json
import sys

from pyspark.sql import SparkSession

from driftspan import benchmark
from driftspan.errors import DriftspanError
from driftspan.facade import Config, run_check
from driftspan.operators import report
from driftspan.operators.detectors import MixedType
from driftspan.operators.preprocessing import select_columns
from driftspan.sources.baselines import BaselineStore
from driftspan.sources.files import read_table


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="driftspan")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "report"):
        p = commands.add_parser(name)
        p.add_argument("--baseline", required=True, help="a file, or name@version of a store")
        p.add_argument("--current", required=True)
        p.add_argument("--store", default="baselines")
        p.add_argument("--columns", default="", help="names separated by commas")
        p.add_argument("--format", choices=("json", "text", "markdown", "html"), default="json")
        p.add_argument("--output")
        p.add_argument("--fail-on-drift", action="store_true")
        p.add_argument("--config")
        for key in ("method", "threshold", "correction", "alpha", "bins", "strategy", "n_permutations", "ensemble_methods", "vote_mode", "min_votes", "stack_threshold"):
            p.add_argument(f"--{key.replace('_', '-')}", default=None)
    p = commands.add_parser("benchmark")
    p.add_argument("--methods", default="ks,psi")
    p.add_argument("--trials", type=int, default=5)
    p.add_argument("--size", type=int, default=300)
    p.add_argument("--format", choices=("json", "csv"), default="json")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: no drift or not asked to fail on it; 1: drift; 2: bad input."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftspan").getOrCreate()
    try:
        if args.command == "benchmark":
            rows = [row for method in args.methods.split(",") for row in benchmark.summaries(spark, method, args.size, args.trials)]
            if args.format == "csv":
                out = csv.DictWriter(sys.stdout, list(rows[0]))
                out.writeheader()
                out.writerows(rows)
            else:
                print("\n".join(map(json.dumps, rows)))
            return 0
        name, at, version = args.baseline.partition("@")
        reference = BaselineStore(spark, args.store).load(name, version) if at else read_table(spark, args.baseline)
        current = read_table(spark, args.current)
        columns = [c for c in args.columns.split(",") if c]
        if args.command == "report":
            rows = MixedType().fit(select_columns(reference, columns)).detect_features(select_columns(current, columns))
        else:
            base = vars(Config.from_file(args.config) if args.config else Config())
            given = {k: getattr(args, k) for k in base if getattr(args, k) is not None}
            rows = run_check(reference, current, Config.of({**base, **given}), columns or None)
    except DriftspanError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    found = [r.asDict() for r in rows.orderBy("feature").collect()]
    if "score" in rows.columns and args.format in ("markdown", "html", "json"):
        text = {"markdown": report.to_markdown, "html": report.to_html, "json": report.to_json}[args.format](rows)
    else:
        text = "\n".join(json.dumps(r, default=str) for r in found)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return int(args.fail_on_drift and any(r["drift"] for r in found)) if args.command == "check" else int(any(r["drift"] for r in found))


if __name__ == "__main__":
    sys.exit(main())
