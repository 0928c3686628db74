"""Plan-shape checks: single regex evaluation, pruning, skew-safe sampling,
no cross joins or Python UDFs in any registered query."""

import pytest
from conftest import SF_MID

import __spark_entry__ as E
from veilscan.operators import findings as FD
from veilscan.plans.queries import QUERIES
from veilscan.session import read_table
from veilscan.sources.samples import sample_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_regex_evaluated_once(spark):
    docs = read_table(spark, SF_MID, "documents")
    plan = _plan(FD.content_findings(docs, "doc_id", "text"))
    from veilscan import rules
    from veilscan.functions.detect import java_regex

    for p in rules.CONTENT_PATTERNS.values():
        assert plan.count(java_regex(p) + ")") == 1, p
    assert plan.count(r"(?U)\d{3})") == 1


def test_scan_prunes_columns(spark):
    docs = read_table(spark, SF_MID, "documents")
    plan = _plan(FD.content_findings(docs, "doc_id", "text"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_grouped_sample_has_partial_group_limit(spark):
    ev = read_table(spark, SF_MID, "events")
    df = sample_rows(ev, 10, "event_id", group_cols=["event_type"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["scan_totals", "classification_summary"])
def test_documents_are_scanned_once(spark, name):
    plan = QUERIES[name](spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_or_python_udf(spark, name):
    df = E.queries()[name](spark, SF_MID)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + _plan(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Join Cross"):
        assert bad not in plan, bad
