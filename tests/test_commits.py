"""Reports with a commit: a run that dies leaves the last one readable; numbers are counted by the write."""

import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from veilscan.sources.commits import commit_report, committed_runs, last_run, read_report, write_part


def test_readers_follow_the_last_commit(spark, scratch):
    path = f"{scratch}/report"
    assert committed_runs(spark, path).count() == 0
    with pytest.raises(LookupError):
        read_report(spark, path, "kpis")
    first = commit_report(spark, path, {"kpis": spark.range(5), "rows": spark.range(10)}, {"rows": {"even": F.count_if(F.col("id") % 2 == 0)}}, "a")
    assert first == {"kpis": {"rows": 5}, "rows": {"rows": 10, "even": 5}}
    assert last_run(spark, path)["parts"] == first

    def fails(batches):
        raise RuntimeError("lost")
        yield from batches

    broken = spark.range(3).mapInArrow(fails, "id long")
    with pytest.raises(Exception, match="lost"):
        commit_report(spark, path, {"kpis": spark.range(50), "rows": broken}, run_id="b")
    # the part that run b finished is not seen
    assert read_report(spark, path, "kpis").count() == 5 and read_report(spark, path, "rows").count() == 10
    assert [r.run_id for r in committed_runs(spark, path).collect()] == ["a"]
    commit_report(spark, path, {"kpis": spark.range(7), "rows": spark.range(0)}, run_id="c")
    assert read_report(spark, path, "kpis").count() == 7 and read_report(spark, path, "rows").count() == 0
    assert read_report(spark, path, "kpis", "a").count() == 5
    with pytest.raises(LookupError):
        read_report(spark, path, "other")
    with pytest.raises(LookupError):
        read_report(spark, path, "kpis", "b")
    # a run id is used once
    with pytest.raises(Exception, match="(?i)exists"):
        commit_report(spark, path, {"kpis": spark.range(1)}, run_id="c")
    assert read_report(spark, path, "kpis").count() == 7


def test_numbers_of_an_empty_part(spark, scratch):
    assert write_part(spark.range(0), f"{scratch}/none", {"sum": F.sum("id")}) == {"rows": 0, "sum": 0}


def test_a_task_tried_again_counts_once(scratch):
    """In a session of its own, as retries are off in a plain local one."""
    program = f"""
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    from veilscan.sources.commits import commit_report, read_report
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
    def once(batches):
        task = TaskContext.get()
        for batch in batches:
            yield batch
        if task.partitionId() % 2 == 0 and task.attemptNumber() == 0:
            raise RuntimeError("lost after its last row")
    rows = spark.range(0, 1000, 1, 6).mapInArrow(once, "id long")
    n = commit_report(spark, "{scratch}/retried", {{"rows": rows}}, {{"rows": {{"odd": F.count_if(F.col("id") % 2 == 1)}}}})
    print("RESULT", n["rows"]["rows"], n["rows"]["odd"], read_report(spark, "{scratch}/retried", "rows").distinct().count())
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(program)], capture_output=True, text=True, timeout=300)
    assert "RESULT 1000 500 1000" in out.stdout, out.stderr[-2000:]


def test_totals_of_the_writes_are_those_of_a_pass(spark, scratch):
    from tests.conftest import SF_SMALL
    from veilscan.operators import findings as FD
    from veilscan.operators.reports import scan_totals
    from veilscan.plans import standins
    from veilscan.plans.scan import committed_scan, discovery_workflow
    from veilscan.session import read_table, read_tables
    from veilscan.sources.catalog import catalog_columns_from_frames

    catalog = catalog_columns_from_frames(spark, read_tables(spark, SF_SMALL), database="main")
    docs = read_table(spark, SF_SMALL, "documents")
    columns, items = FD.column_name_findings(catalog), FD.scan_items_json(docs, table_col="source")
    objects = FD.scan_objects(standins.document_objects(docs))
    (written,) = committed_scan(spark, f"{scratch}/scan", catalog, columns, objects, items).collect()
    assert written == scan_totals(catalog, columns, objects, items).first()
    statuses = spark.createDataFrame([("a", ["SSN"], "scanned"), ("b", [], "empty"), ("c", None, "unreadable")], "path string, pii_types array<string>, status string")
    (row,) = committed_scan(spark, f"{scratch}/statuses", catalog, columns, statuses).collect()
    assert (row.objects_with_pii, row.objects_scanned, row.objects_empty, row.objects_unreadable) == (1, 1, 1, 1)
    discovery_workflow(spark, {"user-a": f"{SF_SMALL}/customer.parquet"}, report_path=f"{scratch}/discovery", commit=True)
    assert read_report(spark, f"{scratch}/discovery", "kpis").first()["total_sources"] == 1
    assert set(last_run(spark, f"{scratch}/discovery")["parts"]) == {"kpis", "counts", "type_counts", "tag_keys", "catalog", "classified"}
