"""Column statistics from Parquet footers."""

import re

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veilscan.operators import column_name_findings
from veilscan.plans.queries import QUERIES
from veilscan.session import TABLES, read_table, table_path
from veilscan.sources.footers import column_statistics


def as_rows(df):
    return {(r["table_name"], r["column_name"]): (r["rows"], r["table_rows"]) for r in df.collect()}


def test_statistics_equal_counts(spark):
    found = as_rows(column_statistics(spark, {t: table_path(SF_SMALL, t) for t in TABLES}))
    for t in TABLES:
        df = read_table(spark, SF_SMALL, t)
        counts = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(c).alias(c) for c in df.columns]).first()
        assert {c: found.pop((t, c)) for c in df.columns} == {c: (counts[c], counts["all"]) for c in df.columns}
    assert not found


def test_no_data_page_is_read(spark):
    flat = [t for t in TABLES if t != "embeddings"]
    plan = column_statistics(spark, {t: table_path(SF_SMALL, t) for t in flat})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT") == len(flat)
    assert "FileScan" not in plan
    for name in ("column_name_findings", "analyze_tables", "column_tags", "table_classes"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        read = re.findall(r"FileScan parquet.*?ReadSchema: (\S+)", plan)
        # the one nested column is counted by a scan of itself
        assert read in (["struct<embedding:array<float>>"], ["struct<>"]), name
        assert name != "column_name_findings" or plan.count("PushedAggregation: [COUNT") == len(TABLES)


def test_empty_nested_and_odd_columns(spark, scratch):
    shapes = {
        "empty": ([], "id bigint, email string"),
        "nulls": ([(1, None), (2, None)], "id bigint, email string"),
        "lists": ([(1, [1, None], None), (None, None, "x"), (3, [], None)], "id bigint, l array<int>, phone string"),
        "deep": (
            [((1, None), {"k": 1}, "a"), (None, None, None), ((None, 2), {}, "c")],
            "s struct<a:int,b:int>, m map<string,int>, `odd.na``me` string",
        ),
    }
    for name, (rows, shape) in shapes.items():
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{scratch}/{name}")
    # several files
    spark.createDataFrame([(3, "x")], "id bigint, email string").write.mode("append").parquet(f"{scratch}/nulls")
    stats = column_statistics(spark, {n: f"{scratch}/{n}" for n in shapes})
    assert as_rows(stats) == {
        ("empty", "id"): (0, 0), ("empty", "email"): (0, 0),
        ("nulls", "id"): (3, 3), ("nulls", "email"): (1, 3),
        ("lists", "id"): (2, 3), ("lists", "l"): (2, 3), ("lists", "phone"): (1, 3),
        ("deep", "s"): (2, 3), ("deep", "m"): (2, 3), ("deep", "odd.na`me"): (2, 3),
    }
    found = {(r["table_name"], r["column_name"]): r["pii_types"] for r in column_name_findings(stats).collect()}
    assert found["empty", "email"] == found["nulls", "email"] == ["EMAIL"] and found["lists", "phone"] == ["PHONE"]
