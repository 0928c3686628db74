"""A batch registered against a far larger registry."""

import pytest
from pyspark.sql import functions as F

from veilscan.operators.registry import BITMAPS, batch_filter, may_hold, register_batch
from veilscan.operators.tags import register_resources


def names(spark, lo, hi, parts=4):
    return spark.range(lo, hi, 1, parts).select(F.concat(F.lit("res/"), "id").alias("resource"), F.lit(1).alias("bitmap"), F.lit(2).alias("known"))


@pytest.mark.parametrize("bitmaps", [1, 3, BITMAPS])
def test_batches_are_registered_like_by_a_join(spark, bitmaps):
    registry = names(spark, 0, 40000).unionByName(names(spark, 100, 200))
    # a third of the batch is one resource; one filter bitmap of 32,768 bits is far too small for it
    batch = names(spark, 39000, 60000).unionByName(names(spark, 5, 6).crossJoin(spark.range(9000)).drop("id"))
    batch = batch.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS resource, 1 AS bitmap, 2 AS known"))
    got = {r.resource: r.status for r in register_batch(registry, batch, bitmaps=bitmaps).collect()}
    whole = {r.resource: r.status for r in register_resources(registry.select("resource"), batch.select("resource").where("resource IS NOT NULL")).collect()}
    asked = {f"res/{i}" for i in [5, *range(39000, 60000)]}
    assert got == {r: s for r, s in whole.items() if r in asked} and len(got) == len(asked)


def test_few_rows_of_the_registry_pass(spark):
    registry, batch = names(spark, 0, 200000), names(spark, 199900, 200100)
    passed = may_hold(registry, batch_filter(batch))
    assert 100 <= passed.count() <= 110
    plan = register_batch(registry, batch)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    # the registry is tested where it is read: its side has a broadcast join and no shuffle join
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical and "Python" not in physical


def test_empty_sides(spark):
    registry, batch = names(spark, 0, 10), names(spark, 5, 8)
    assert register_batch(registry, batch.limit(0)).collect() == []
    assert {r.status for r in register_batch(registry.limit(0), batch).collect()} == {"registered"}
    assert register_batch(registry, batch).columns == ["resource", "status"]
