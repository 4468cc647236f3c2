"""Command line: diff, graph-diff, run-diff, verify, validate, ingest."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from rippletrace import api
from rippletrace.operators import report as R
from rippletrace.sources.artifacts import write_pretty

#: Exit codes of a comparison.
EXIT = {"no_impact": 0, "impacted": 1, "non_executable": 2}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rippletrace")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("diff")
    for name in ("--from-spec", "--to-spec"):
        d.add_argument(name, required=True)
    for name in ("--from-registry", "--to-registry", "--from-bindings", "--to-bindings", "--output-dir"):
        d.add_argument(name)
    d.add_argument("--mode", choices=("core", "full", "all-details"), default="full")
    for name in ("graph-diff", "run-diff"):
        g = sub.add_parser(name)
        g.add_argument("--bundles-a", required=True)
        g.add_argument("--bundles-b", required=True)
        g.add_argument("--out", required=True)
    v = sub.add_parser("verify")
    v.add_argument("what", choices=("report", "spec", "registry", "bindings", "bundle"))
    v.add_argument("path")
    for name in ("--spec", "--from-spec", "--to-spec", "--from-registry", "--to-registry", "--bindings", "--raw-schema"):
        v.add_argument(name)
    i = sub.add_parser("ingest")
    i.add_argument("bundles")
    i.add_argument("--out", required=True)
    return p


def _frames(frames: dict[str, Any], out: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{out}/{name}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rippletrace").getOrCreate()
    try:
        if args.command == "diff":
            given = (args.from_spec, args.to_spec, args.from_registry, args.to_registry, args.to_bindings)
            if args.mode == "all-details":
                report = api.diff_all_details(spark, *given)
                text, status = None, report["run_status"]
            else:
                core = api.diff(spark, *given, detail=args.mode)
                report = R.core_report(core) if args.mode == "core" else R.full_report(core)
                text, status = R.markdown(core), report["run_status"]
            if args.output_dir:
                Path(args.output_dir).mkdir(parents=True, exist_ok=True)
                write_pretty(report, f"{args.output_dir}/impact.json")
                if text is not None:
                    Path(args.output_dir, "impact.md").write_text(text, encoding="utf-8")
            else:
                print(text if text is not None else json.dumps(report, indent=2))
            return EXIT[status]
        if args.command == "graph-diff":
            _frames(api.graph_diff_bundles(spark, args.bundles_a, args.bundles_b), args.out)
            return 0
        if args.command == "run-diff":
            from rippletrace.operators.run_diff import run_diff
            from rippletrace.sources.bundles import files

            a, b = files(spark, args.bundles_a), files(spark, args.bundles_b)
            pairs = lambda f: f.select("bundle").distinct().selectExpr("bundle", "bundle AS pair_id")
            _frames(run_diff(a, b, pairs(a), pairs(b)), args.out)
            return 0
        if args.command == "ingest":
            _frames(api.ingest_bundles(spark, args.bundles), args.out)
            return 0
        if args.what == "report":
            found = api.doctor(spark, Path(args.path), args.from_spec, args.to_spec, args.from_registry, args.to_registry, args.bindings)
        elif args.what == "spec":
            found = api.validate(spark, args.path, args.from_registry, args.bindings, args.raw_schema)
        elif args.what == "registry":
            bad = api.verify_registry(spark, args.path)
            found = {"ok": not bad, "errors": bad}
        elif args.what == "bindings":
            found = api.validate(spark, args.spec, None, args.path, args.raw_schema, ambiguity="error")
        else:
            bad = [r.asDict() for r in api.verify_bundles(spark, args.path).collect()]
            found = {"ok": not bad, "errors": bad}
        print(json.dumps(found, sort_keys=True, ensure_ascii=False))
        return 0 if found["ok"] else 1
    except (api.ArtifactError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
