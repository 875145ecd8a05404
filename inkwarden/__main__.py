"""python -m inkwarden: scan files, print verdicts, exit by what was found."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import rules
from .operators import exports
from .plans import report
from .plans.scanner import Scanner
from .policy import RISKS, SOURCES, Policy
from .rules import CLASSES
from .sources import files

USAGE, INTERNAL = 64, 70


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkwarden", description=__doc__)
    p.add_argument("targets", nargs="+", help="files, folders, or - for what stands on the standard input")
    p.add_argument("--source", choices=SOURCES, default="tool_response")
    p.add_argument("--threshold", choices=RISKS[1:], default="high")
    p.add_argument("--format", choices=("json", "text"), default="text")
    p.add_argument("--classes", nargs="*", choices=CLASSES, default=list(CLASSES))
    p.add_argument("--max-input-bytes", type=int, default=Policy.max_input_bytes)
    p.add_argument("--max-decode-depth", type=int, default=Policy.max_decode_depth)
    p.add_argument("--max-observations", type=int, default=Policy.max_observations)
    p.add_argument("--max-reasons", type=int, default=Policy.max_reasons)
    p.add_argument("--rules", action="append", default=[])
    p.add_argument("--disable-rule", action="append", default=[])
    p.add_argument("--export-policy")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = arguments().parse_args(argv)
    except SystemExit as end:
        return 0 if not end.code else USAGE
    try:
        ruleset = rules.load(args.rules, tuple(args.disable_rule))
        resources = exports.parse_policy(open(args.export_policy, encoding="utf-8").read()) if args.export_policy else ()
        policy = Policy.for_source(args.source, threshold=args.threshold, classes=tuple(args.classes), max_input_bytes=args.max_input_bytes, max_decode_depth=args.max_decode_depth, max_observations=args.max_observations, max_reasons=args.max_reasons)
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return USAGE
    spark = SparkSession.builder.appName("inkwarden").getOrCreate()
    paths, problems = files.plan([t for t in args.targets if t != "-"])
    kind = "path string, bytes long, text string, problem string"
    read = spark.createDataFrame([(p, None, None, why) for p, why in problems], kind)
    for path in paths:
        read = read.unionByName(files.read_paths(spark, path, policy.max_input_bytes))
    if "-" in args.targets:
        read = read.unionByName(files.told_apart(files.from_buffer(spark, sys.stdin.buffer.read()), policy.max_input_bytes))
    told = Scanner(ruleset, policy, resources).scan(read.where("problem IS NULL"), "path")
    gap = read.where("problem IS NOT NULL").select(F.col("path").alias("doc_id"), F.lit("inconclusive").alias("outcome"), F.lit(0).alias("score"), F.lit("none").alias("risk"), F.lit("inconclusive").alias("decision"), F.array(causes(F.col("problem"))).alias("incomplete"))
    told = told.unionByName(gap, allowMissingColumns=True)
    empty = lambda c: F.coalesce(c, F.array().cast(told.schema[c].dataType))
    told = told.withColumns({"reasons": empty("reasons"), "suppressed": empty("suppressed"), "reasons_truncated": F.coalesce("reasons_truncated", F.lit(False)), "ruleset": F.lit(ruleset.identity)}).orderBy("doc_id").cache()
    try:
        for part in report.json_parts(told) if args.format == "json" else report.text_parts(told):
            sys.stdout.write(part if args.format == "json" else part + "\n")
        sys.stdout.write("\n" if args.format == "json" else "")
        sys.stdout.flush()
    except BrokenPipeError:  # the reader has seen enough; what was found still decides the exit code
        sys.stdout = open(os.devnull, "w", encoding="utf-8")  # noqa: SIM115
    line, code = report.run_summary(told)
    if line:
        print(line, file=sys.stderr)
    return code


def causes(problem: Column) -> Column:
    """What a verdict calls the problem of a target."""
    return F.when(problem == "oversized", "max_input_bytes").when(problem == "not_text", "target_not_text").otherwise(problem)


if __name__ == "__main__":
    sys.exit(main())
