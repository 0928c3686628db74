"""The stored tag table: equal results, and only touched partitions rewritten."""

import os
import re

from pyspark.sql import functions as F

from veilscan.operators.tags import apply_tags
from veilscan.sources.tag_store import COLUMNS, create_tag_store, merged, store_session, stored_tags, upsert_tags

SHAPE = "database string, table_name string, column_name string, tag_key string, tag_value string, seq bigint"


def files_of(path):
    return {part: sorted(os.listdir(os.path.join(path, part))) for part in os.listdir(path) if part.startswith("part=")}


def as_set(df):
    return sorted(map(tuple, df.select("database", "table_name", "column_name", "tag_key", "tag_value", "seq").collect()), key=str)


def test_upserts_equal_one_pass(spark, scratch):
    spark.sql("DROP TABLE IF EXISTS tag_store_test")
    path = f"{scratch}/tags"
    create_tag_store(spark, "tag_store_test", path, parts=50, buckets=4)
    base = spark.range(4000).selectExpr(
        "'db' as database", "concat('t', id % 40) as table_name", "if(id % 7 = 0, null, concat('c', id % 400)) as column_name",
        "concat('k', id % 3) as tag_key", "concat('v', id % 11) as tag_value", "id % 5 as seq",
    )
    assert upsert_tags(spark, "tag_store_test", base)
    assert as_set(stored_tags(spark, "tag_store_test")) == as_set(apply_tags(base.limit(0), base.select(COLUMNS)))
    before = files_of(path)
    # older, equal and newer changes, several of one key, a new key, one without a key
    log = spark.createDataFrame(
        [("db", "t1", "c1", "k1", "old", -1), ("db", "t1", "c1", "k1", "new", 9), ("db", "t1", "c1", "k1", "newer", 10), ("db", None, None, "k9", None, 1),
         ("db", "t2", "c2", None, "x", 99)],
        SHAPE,
    )
    touched = upsert_tags(spark, "tag_store_test", log)
    after = files_of(path)
    assert 1 <= len(touched) <= 2
    assert {p for p in after if after[p] != before.get(p)} == {f"part={k}" for k in touched}
    kept = log.where("tag_key is not null")
    assert as_set(stored_tags(spark, "tag_store_test")) == as_set(apply_tags(base.limit(0), base.unionByName(kept)))
    upsert_tags(spark, "tag_store_test", log)
    assert as_set(stored_tags(spark, "tag_store_test")) == as_set(apply_tags(base.limit(0), base.unionByName(kept)))
    assert upsert_tags(spark, "tag_store_test", log.limit(0)) == []
    spark.sql("DROP TABLE tag_store_test")


def test_stored_side_is_not_shuffled(spark, scratch):
    spark.sql("DROP TABLE IF EXISTS tag_store_plan")
    create_tag_store(spark, "tag_store_plan", f"{scratch}/tags", parts=8, buckets=4)
    rows = spark.range(50000).selectExpr(
        "'db' as database", "concat('t', id) as table_name", "cast(null as string) as column_name", "concat('k', id % 2) as tag_key", "'v' as tag_value", "id as seq"
    )
    upsert_tags(spark, "tag_store_plan", rows)
    session = store_session(spark, "tag_store_plan")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found, _ = merged(session, "tag_store_plan", rows.where(F.col("seq") < 3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 4 out of 4" in plan and "Bucketed: true" in plan
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = len(re.match(r"[\s:+-]*", lines[scan])[0])
    above = [line for line in lines[:scan] if len(re.match(r"[\s:+-]*", line)[0]) < depth]
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in above[join:]), plan
    spark.sql("DROP TABLE tag_store_plan")
