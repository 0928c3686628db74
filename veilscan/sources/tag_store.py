"""C7 on a stored tag table: a change log rewrites only what it touches.

The table is partitioned by a hash of (resource, tag key) and bucketed by resource. An
upsert combines the change log to one row for each key, reads the partitions it touches (their
numbers, at most PARTS, are all that the driver sees), and joins them bucket by bucket: the change
log is shuffled, the stored rows are not. Dynamic partition overwrite replaces the touched
partitions when the write commits; until then, and if it fails, readers see the old ones.

The latest ``seq`` of a key wins, also over what is stored; of equal ones the largest value. A
change log applied again changes nothing. Null columns mean the whole table, null tables the
database. Changes without a tag key are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _quoted

#: partitions of a tag table, and buckets in each; at 10^10 tags a bucket file has some 10^4 rows
PARTS, BUCKETS = 256, 64
COLUMNS = ["database", "table_name", "column_name", "tag_key", "tag_value", "seq"]
_KEYS = ["resource", "tag_key"]


def _resource() -> Column:
    return F.to_json(F.struct("database", "table_name", "column_name"))


def _name(table: str) -> str:
    return ".".join(_quoted(part) for part in table.split("."))


def create_tag_store(spark: SparkSession, table: str, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> None:
    """An empty tag table ``table`` on ``path``, if there is none."""
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(table)} (resource STRING, database STRING, table_name STRING, column_name STRING, "
        "tag_key STRING, tag_value STRING, seq BIGINT, part INT) USING parquet "
        f"OPTIONS (parts '{parts}') PARTITIONED BY (part) CLUSTERED BY (resource) INTO {buckets} BUCKETS LOCATION '{place}'"
    )


def _parts(spark: SparkSession, table: str) -> int:
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {_name(table)}").where("col_name = 'Storage Properties'").first()
    return int(row["data_type"].split("parts=")[1].split("]")[0].split(",")[0])


def merged(spark: SparkSession, table: str, changes: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """The touched partitions with ``changes`` (COLUMNS) on top, and their numbers; None without changes."""
    latest = (
        changes.where(F.col("tag_key").isNotNull())
        .select(_resource().alias("resource"), *COLUMNS)
        .groupBy("resource", "database", "table_name", "column_name", "tag_key")
        .agg(F.max(F.struct(F.col("seq").alias("seq"), F.col("tag_value").alias("value"))).alias("new"))
        .withColumn("part", F.pmod(F.xxhash64(*_KEYS), F.lit(_parts(spark, table))).cast("int"))
    )
    touched = sorted(r["part"] for r in latest.select("part").distinct().collect())
    if not touched:
        return None
    stored = spark.table(_name(table)).where(F.col("part").isin(touched))
    stored = stored.select(*_KEYS, *[F.col(c).alias(f"old_{c}") for c in ("database", "table_name", "column_name", "part")], F.struct(
        F.col("seq").alias("seq"), F.col("tag_value").alias("value")
    ).alias("old"))
    both = stored.join(latest, _KEYS, "full_outer")
    # greatest() passes over a missing side
    both = both.withColumn("now", F.greatest("old", "new"))
    either = lambda c: F.when(F.col("new").isNull(), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
    rows = both.select(
        "resource", either("database"), either("table_name"), either("column_name"), "tag_key",
        F.col("now.value").alias("tag_value"), F.col("now.seq").alias("seq"), either("part"),
    )
    return rows, touched


def store_session(spark: SparkSession, table: str) -> SparkSession:
    """A session that replaces touched partitions only, and deals change logs out as the table's buckets are."""
    session = spark.newSession()
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {_name(table)}").where("col_name = 'Num Buckets'").first()
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    # with more, Spark would shuffle the stored rows as well
    session.conf.set("spark.sql.shuffle.partitions", row["data_type"])
    # rows of one resource lie in one bucket, which is enough for a join by resource and tag key
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return session


def upsert_tags(spark: SparkSession, table: str, changes: DataFrame) -> list[int]:
    """Apply ``changes`` to the tag table; the numbers of the partitions that were rewritten."""
    found = merged(store_session(spark, table), table, changes)
    if found is None:
        return []
    rows, touched = found
    rows.write.mode("overwrite").insertInto(_name(table))
    spark.catalog.refreshTable(_name(table))
    return touched


def stored_tags(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(_name(table)).select(COLUMNS)
