"""python -m jurata.cli: queries | run NAME SF_DIR | inspect FILE.xlsx | resume TABLES [--queue OUT --run RUN --retry-failed] | export TABLES RUN OUT | evaluate TABLES RUN MANIFEST SPLIT OUT

TABLES is a folder of Parquet tables: runs, records, results, attempts, campaigns, jobs, gold. Exit codes: 0 done, 2 wrong
arguments, 3 what was asked isn't possible now.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="jurata")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the registered queries")
    run = commands.add_parser("run", help="shows a query's result")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("--rows", type=int, default=20)
    inspect = commands.add_parser("inspect", help="prechecks a workbook")
    inspect.add_argument("file")
    inspect.add_argument("--sheet")
    resume = commands.add_parser("resume", help="what a resume of each run would do, and what may be done with it")
    resume.add_argument("tables")
    resume.add_argument("--queue", help="appends the jobs of accepted resumes (jobs) and their records (targets) below this folder")
    resume.add_argument("--run", help="only this run")
    resume.add_argument("--retry-failed", action="store_true", help="records whose budget is used up get a new one")
    export = commands.add_parser("export", help="publishes a run's workbook and JSON lines")
    for name in ("tables", "run", "out"):
        export.add_argument(name)
    evaluate = commands.add_parser("evaluate", help="scores a run against a split of the gold set")
    for name in ("tables", "run", "manifest", "split", "out"):
        evaluate.add_argument(name)
    args = parser.parse_args(argv)

    from . import registry

    if args.command == "queries":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "run":
        if args.name not in registry.queries():
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        registry.queries()[args.name](spark, args.sf_dir).show(args.rows, truncate=60)
        return 0
    if args.command in ("resume", "export", "evaluate"):
        return _stored(spark, args)
    from .sources import workbook
    from .sources.xlsx import XlsxDataSource

    spark.dataSource.register(XlsxDataSource)
    sheet = workbook.selected_sheet(spark.read.format("xlsx").option("mode", "catalog").load(args.file), args.sheet).first()["sheet"]
    if sheet is None:
        print("the sheet is ambiguous: name one with --sheet", file=sys.stderr)
        return 3
    report = workbook.precheck(spark.read.format("xlsx").option("sheet", sheet).load(args.file)).first()
    print(report.asDict())
    return 0 if report["status"] == "passed" else 3


def _stored(spark: SparkSession, args: argparse.Namespace) -> int:
    """Commands over stored tables."""
    from .operators import export as E
    from .operators import records as R
    from .plans import evaluate, publish

    table = lambda name: spark.read.parquet(f"{args.tables.rstrip('/')}/{name}.parquet")
    if args.command == "resume" and args.queue:
        return _queued(spark, args, table)
    if args.command == "resume":
        R.allowed_actions(table("runs"), table("records"), table("campaigns"), table("attempts"), table("jobs")).orderBy("run_id").show(1000, truncate=False)
        return 0
    run = table("runs").where(F.col("run_id") == args.run).first()
    if run is None:
        print(f"no run {args.run}", file=sys.stderr)
        return 2
    records = table("records").where(F.col("run_id") == args.run)
    try:
        if args.command == "export":
            own = records.select("record_key")
            of = lambda name: table(name).join(own, "record_key", "left_semi")
            print(publish.publish(E.snapshot(records, of("results"), of("attempts")), args.out, f"export-{args.run}", {"status": run["status"]}))
        else:
            report, _ = evaluate.run_evaluation(table("gold"), evaluate.read_manifest(spark, args.manifest), records, args.split, run["status"], args.out)
            print(report["display"])
    except (evaluate.Gate, FileExistsError, ValueError) as e:
        print(e, file=sys.stderr)
        return 3
    return 0


def _queued(spark: SparkSession, args: argparse.Namespace, table: Callable[[str], DataFrame]) -> int:
    """Puts resumes in the queue; what was accepted and what was refused is shown."""
    from .operators import records as R
    from .operators import requests as Q

    mine = lambda df: df if args.run is None else df.where(F.col("run_id") == args.run)
    plan = R.resume_plan(mine(table("records")), table("campaigns"), table("attempts"), retry_failed=args.retry_failed)
    outcomes = Q.resume_outcomes(plan, table("jobs")).cache()
    jobs, targets = Q.resume_jobs(plan, table("jobs"), F.lit(datetime.now(timezone.utc)), args.retry_failed)
    targets.write.mode("append").parquet(f"{args.queue.rstrip('/')}/targets")  # before the jobs: a job that is there has its records
    jobs.write.mode("append").parquet(f"{args.queue.rstrip('/')}/jobs")
    outcomes.orderBy("run_id").show(1000, truncate=False)
    return 3 if outcomes.where("outcome = 'accepted'").isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
