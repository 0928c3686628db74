"""Hot keys give whole, correct results; lineage cuts go to the shared folder."""

from pyspark.sql import functions as F

from veilscan.operators import findings as FD
from veilscan.operators import tags as TG
from veilscan.session import cut_lineage, ensure_checkpoint_dir


def test_hot_item_table_and_hot_document(spark):
    # One item table holds ~90% of the rows, one document holds ~half of all entities.
    rows = [(i, "hot" if i % 10 else f"t{i}", "x 123-45-6789" if i == 7 else "plain") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, src string, text string")
    got = {r["table_name"]: (r["item_count"], list(r["pii_types"])) for r in FD.scan_items_json(df, table_col="src").collect()}
    assert got == {"hot": (2700, ["SSN"])}

    ents = spark.createDataFrame(
        [(1, "PHONE", 0.1 + (i % 1000) / 2000.0) for i in range(4000)] + [(i, "EMAIL", 0.5) for i in range(2, 4002)],
        "doc_id long, type string, score double",
    )
    pat = spark.createDataFrame([(1, "SSN")], "doc_id long, pii_type string")
    out = {r["doc_id"]: (list(r["pii_types"]), dict(r["confidence"])) for r in FD.merge_entity_scores(pat, ents).collect()}
    assert out[1] == (["SSN", "PHONE"], {"SSN": 0.7, "PHONE": 0.1 + 999 / 2000.0})
    assert len(out) == 4001


def test_hot_tag_key_upsert(spark):
    log = spark.range(0, 50000).select(
        F.lit("d").alias("database"), F.lit("t").alias("table_name"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("column_name"),
        F.lit("PIIType").alias("tag_key"), (F.col("id") % 11).cast("string").alias("tag_value"), F.col("id").alias("seq"),
    )
    empty = log.limit(0)
    got = {r["column_name"]: (r["tag_value"], r["seq"]) for r in TG.apply_tags(empty, log).collect()}
    assert got["hot"] == (str(49998 % 11), 49998)
    assert len(got) == 8


def test_checkpoint_dir_from_session(spark, tmp_path):
    d = ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    cut = cut_lineage(df)
    assert cut.count() == 100
    assert "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString() or "ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
