"""Command line: ``python -m veilscan {scan,discover,mask} ...``.

scan      full scan of the parquet tables under a directory (column names),
          optional object roots (whole contents) and item tables (rows as JSON);
          prints the totals and writes findings/reports when --out is set
discover  register sources, classify them by name, print KPIs, write the report
mask      write a masked copy of a table (columns masked by their name profile)

On a cluster the session comes from spark-submit; locally a local session is
started.
"""

from __future__ import annotations

import argparse
import json
import os
import sys


def _session():
    from pyspark.sql import SparkSession

    from veilscan.session import ensure_checkpoint_dir, local_session

    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    if os.environ.get("SPARK_MASTER") or "spark.master" in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        s = SparkSession.builder.getOrCreate()
        ensure_checkpoint_dir(s)
        return s
    return local_session()


def _pairs(values):
    out = {}
    for v in values or []:
        name, _, path = v.partition("=")
        if not path:
            raise SystemExit(f"expected name=path, got {v!r}")
        out[name] = path
    return out


def _tables_under(spark, root: str) -> dict:
    from veilscan.sources.catalog import list_folder

    found = [(n, p) for n, p, folder in list_folder(spark, root) if folder or n.endswith(".parquet")]
    if not found:
        raise SystemExit(f"no tables under {root!r}")
    return {n.removesuffix(".parquet"): spark.read.parquet(p) for n, p in found if not n.startswith(("_", "."))}


def cmd_scan(args) -> int:
    from functools import reduce

    from veilscan.plans.scan import full_scan, scan_objects_under
    from veilscan.sources.sinks import write_findings, write_report

    spark = _session()
    tables = _tables_under(spark, args.tables) if args.tables else None
    objects = None
    if args.objects:
        parts = [scan_objects_under(spark, root, args.prefix) for root in args.objects]
        objects = reduce(lambda a, b: a.unionByName(b), parts)
    items = {n: spark.read.format(args.item_format).load(p) for n, p in _pairs(args.item).items()} or None
    res = full_scan(spark, tables=tables, databases=args.database or None, objects=objects, item_tables=items)
    totals = res.totals.first().asDict()
    if res.object_status is not None:  # one row for each of three states
        totals["object_status"] = {r["status"]: r["objects"] for r in res.object_status.collect()}
    print(json.dumps({"status": "completed", **totals}))
    if args.out:
        out = args.out.rstrip("/")
        write_findings(res.findings(), f"{out}/findings")
        write_findings(res.column_tags, f"{out}/column_tags")
        write_findings(res.registry, f"{out}/registry")
        write_findings(res.tables, f"{out}/tables")
        write_report(res.totals, f"{out}/totals")
        write_report(res.classification_summary, f"{out}/classification_summary")
    return 0


def cmd_discover(args) -> int:
    from veilscan.plans.scan import discovery_workflow

    spark = _session()
    res = discovery_workflow(spark, _pairs(args.file), _pairs(args.item), report_path=args.out, fmt=args.format)
    print(json.dumps(res.kpis.first().asDict()))
    return 0


def cmd_mask(args) -> int:
    from veilscan.functions.mask import masking_rule
    from veilscan.plans.scan import masked_copy

    spark = _session()
    df = spark.read.format(args.format).load(args.input)
    custom = {}
    for spec in args.rule or []:
        t, _, strategy = spec.partition("=")
        custom[t] = masking_rule(t, strategy)
    masked_copy(df, args.output, custom_rules=custom or None)
    print(json.dumps({"status": "written", "path": args.output}))
    return 0


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="python -m veilscan", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("scan", help="full scan")
    s.add_argument("--tables", help="directory of parquet tables (column-name scan)")
    s.add_argument("--database", action="append", help="catalog database to scan (repeatable)")
    s.add_argument("--objects", action="append", help="object root (repeatable)")
    s.add_argument("--prefix", default="")
    s.add_argument("--item", action="append", help="item table name=path (repeatable)")
    s.add_argument("--item-format", default="parquet")
    s.add_argument("--out", help="output folder for findings and reports")
    s.set_defaults(fn=cmd_scan)
    d = sub.add_parser("discover", help="register, classify by name, report")
    d.add_argument("--file", action="append", help="file source name=path (repeatable)")
    d.add_argument("--item", action="append", help="item source name=path (repeatable)")
    d.add_argument("--format", default="parquet")
    d.add_argument("--out", help="report folder")
    d.set_defaults(fn=cmd_discover)
    m = sub.add_parser("mask", help="write a masked copy")
    m.add_argument("input")
    m.add_argument("output")
    m.add_argument("--format", default="parquet")
    m.add_argument("--rule", action="append", help="TYPE=strategy override (repeatable)")
    m.set_defaults(fn=cmd_mask)
    args = p.parse_args(argv)
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
