"""Command line: run, eval, mcp (not implemented), version."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from trailhead import __version__
from trailhead.plans import scout
from trailhead.sources import render
from trailhead.sources import requests as rq


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("trailhead")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("version")
    r = sub.add_parser("run")
    r.add_argument("-r", "--request", default="")
    r.add_argument("-t", "--task", default="")
    r.add_argument("--repo", default=".")
    r.add_argument("--profile", default="")
    r.add_argument("-s", "--seed", action="append", default=[])
    r.add_argument("--focus-symbol", action="append", default=[])
    r.add_argument("--focus-check", action="append", default=[])
    r.add_argument("--depth", type=int, default=0)
    r.add_argument("--max-files", type=int, default=0)
    r.add_argument("-c", "--config", default="")
    r.add_argument("--rerank", action=argparse.BooleanOptionalAction, default=None)
    r.add_argument("-f", "--format", choices=["json", "markdown"], default="json")
    r.add_argument("-o", "--output", default="")
    r.add_argument("-q", "--quiet", action="store_true")
    r.add_argument("--color", action=argparse.BooleanOptionalAction, default=None)
    sub.add_parser("mcp")
    e = sub.add_parser("eval")
    e.add_argument("root")
    e.add_argument("-f", "--format", choices=["text", "json"], default="text")
    e.add_argument("--sample", default=None)
    return p


def listed(values: list[str]) -> list[str]:
    """Repeated flags, and commas within one."""
    return [x.strip() for v in values for x in v.split(",") if x.strip()]


def request_of(a: argparse.Namespace) -> rq.Request:
    """From a file, or from flags; a budget only if a flag sets one."""
    if a.request:
        return rq.Request.load(a.request)
    budget = rq.Budget(expand_depth=a.depth, max_output_files=a.max_files) if a.depth > 0 or a.max_files > 0 else None
    return rq.Request(a.task, os.path.abspath(a.repo), a.profile, listed(a.seed), listed(a.focus_symbol), listed(a.focus_check), budget)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(__version__)
        return 0
    if a.verb == "mcp":
        print("mcp is not implemented", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("trailhead").getOrCreate()
    if a.verb == "eval":
        summary, metrics = scout.evaluate_goldens(spark, a.root, sample=a.sample)
        tell = render.eval_json if a.format == "json" else render.eval_text
        print(tell(summary.first(), metrics.orderBy("sample_id").collect()))
        return 0
    request = request_of(a)
    config, read = rq.load_config(a.config, request.repo_root)
    if a.rerank is not None:
        config.runtime.enable_model_rerank = a.rerank
    progress = render.Progress(spark, a.quiet, a.color)
    for path in read:
        progress.say(f"configuration: {path}")
    progress.start("scouting")
    pack = scout.run(spark, request, config)
    render.emit(render.pack_json(pack) if a.format == "json" else render.Markdown().render(pack), a.output)
    progress.done("scouting")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
