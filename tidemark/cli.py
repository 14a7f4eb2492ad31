"""Command line: check a snapshot, build and publish it, verify what is published.

Reports are JSON, on stdout or in a file, the same bytes in both.  A structured
failure ends with its own exit code and one line on stderr; any other exception
is a fault of the program and shows as such.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Callable
from pathlib import Path

from .errors import CODES, SnapshotError

EXIT_CODES = "exit codes:\n" + "\n".join(f"  {c:<26} {SnapshotError(c).exit_code}" for c in CODES)
#: Characters of an error's detail on stderr.
DETAIL = 2000


def emit(report: dict, out: str | None) -> None:
    text = json.dumps(report, ensure_ascii=False, indent=1, default=str) + "\n"
    if out is None:
        sys.stdout.write(text)
    else:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(text, encoding="utf-8")


def report(error: SnapshotError) -> int:
    print(f"[{error.code.value}] layer={error.layer} {error}", file=sys.stderr)
    if error.detail:
        print(json.dumps(error.detail, ensure_ascii=False, default=str)[:DETAIL], file=sys.stderr)
    return error.exit_code


def run(body: Callable[[], int]) -> int:
    try:
        return body()
    except SnapshotError as e:
        return report(e)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(spark, args, spec, staging):
    from .sources import snapshot
    from .sources.strict_csv import read_csv_strict

    if args.csv:
        return read_csv_strict(spark, args.csv, spec, staging), {"sourceKind": "csv", "source": args.csv}
    where = Path(args.zip)
    return snapshot.read_snapshot(spark, where.read_bytes(), spec), {"sourceKind": "zip", "source": args.zip, "sourceBytes": where.stat().st_size}


def check(args) -> int:
    from .plans.reports import schema_report
    from .plans.spec import TRIALS
    from .staging import Staging

    spark = _session()
    staging = Staging(spark)
    try:
        rows, source = _rows(spark, args, TRIALS, staging)
        emit(schema_report(TRIALS, rows.count(), args.prev_rows, **source), args.report)
    finally:
        staging.close()
    return 0


def build(args) -> int:
    from .operators import converge
    from .plans import artifacts, publish, reports
    from .plans.build import build as build_tables
    from .plans.spec import TRIALS
    from .staging import Staging

    spark = _session()
    staging = Staging(spark)
    date = args.date or dt.date.today()
    try:
        rows, source = _rows(spark, args, TRIALS, staging)
        rows = staging.table(rows, "raw")
        before = publish.read_manifest(spark, args.root)
        previous = args.prev_rows if args.prev_rows is not None else ((before or {}).get("counts") or {}).get("records")
        schema = reports.schema_report(TRIALS, rows.count(), previous, **source)
        try:
            tables = build_tables(rows, TRIALS, date, staging)
        except SnapshotError as e:
            if e.code.value == "IDENTITY_COLLISION":
                keyed = converge.build_records(rows, TRIALS, date).select("protocol", "norm", "hash")
                emit({"schema": schema, "collisions": reports.collision_report(reports.collisions(keyed, "protocol"))}, args.report)
            raise
        quality = reports.quality_report(tables, TRIALS, schema["verdict"], args.lists, **source)
        version, changed = artifacts.publish_artifacts(spark, args.root, tables, TRIALS, expect=(before or {}).get("datasetVersion"), facts={"buildDate": str(date)})
        manifest = publish.read_manifest(spark, args.root)
        size = reports.require_total({n: manifest["files"][n]["gzipBytes"] for n in ("trials-index", "stats")}, args.start_bytes) if args.start_bytes else None
        emit({"datasetVersion": version, "changed": changed, "schema": schema, "quality": quality, "start": size}, args.report)
    finally:
        staging.close()
    return 0


def verify(args) -> int:
    from .plans import artifacts

    violated, unevaluable, changed = artifacts.verify_artifacts(_session(), args.root)
    emit({"violated": violated, "unevaluable": unevaluable, "changed": changed}, args.report)
    # brotli sizes are never computed, so that rule alone may lack its ground
    if violated or set(unevaluable) - {"I8.brotliBytes"}:
        raise SnapshotError("INTEGRITY_DIGEST", violated=violated, unevaluable=unevaluable, changed=changed)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__, epilog=EXIT_CODES, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name, f in (("check", check), ("build", build), ("verify", verify)):
        own = commands.add_parser(name)
        own.set_defaults(body=f)
        own.add_argument("--report", help="file of the JSON report (default: stdout)")
        if name != "check":
            own.add_argument("--root", required=True, help="where versions are published")
        if name != "verify":
            source = own.add_mutually_exclusive_group(required=True)
            source.add_argument("--csv", help="CSV files, read in parallel")
            source.add_argument("--zip", help="one zipped snapshot on the driver's disk")
            own.add_argument("--prev-rows", type=int, help="rows of the snapshot before (default: those published)")
        if name == "build":
            own.add_argument("--date", type=dt.date.fromisoformat, help="day of the build (default: today)")
            own.add_argument("--lists", help="folder for the report's lists of entities")
            own.add_argument("--start-bytes", type=int, help="limit of the gzip sizes of what is read at the start")
    args = top.parse_args(argv)
    return run(lambda: args.body(args))


if __name__ == "__main__":
    sys.exit(main())
