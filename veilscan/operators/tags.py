"""Classification roll-ups and governance tag tables.

Tag tables are long: ``(database, table_name, column_name, tag_key,
tag_value[, seq])``; ``column_name`` NULL means a table-level tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilscan import rules
from veilscan.functions import classify as C
from veilscan.functions import detect as D
from veilscan.session import local_frame

RESOURCE_KEYS = ["database", "table_name", "column_name"]
TAG_DEF_SCHEMA = StructType([StructField("tag_key", StringType()), StructField("tag_value", StringType())])


def _tag_entries(pairs: list[tuple[str, object]]):
    entries = F.array(*[F.struct(F.lit(k).alias("tag_key"), v.alias("tag_value")) for k, v in pairs])
    return F.inline(F.filter(entries, lambda e: e["tag_value"].isNotNull()))


def column_tags(findings: DataFrame, types_col: str = "pii_types", keys=RESOURCE_KEYS) -> DataFrame:
    """Tags per finding. With PII: PIIType (first type), DataClassification,
    AccessLevel, DataGovernance=PII_DETECTED, PIIClassification. Without PII the
    four defaults NONE / NO_RISK / PUBLIC / PUBLIC."""
    t = F.col(types_col)
    has = F.size(t) > 0
    cls = C.data_classification(t)
    pairs = [
        ("PIIType", C.primary_type(t)),
        ("DataClassification", cls),
        ("AccessLevel", C.access_level(cls)),
        ("DataGovernance", F.when(has, F.lit("PII_DETECTED")).otherwise(F.lit("PUBLIC"))),
        ("PIIClassification", F.when(has, C.pii_classification(cls))),
    ]
    return findings.select(*keys, _tag_entries(pairs))


def table_classification(findings: DataFrame, types_col: str = "pii_types", keys=("database", "table_name")) -> DataFrame:
    """Roll column findings up to tables: union of types (rule order),
    highest class, its access level, and column counts. One shuffle with
    per-flag partial aggregates: a table with millions of columns still
    ships one partial row per task."""
    keys = list(keys)
    t = F.col(types_col)
    types = rules.COLUMN_TYPES
    g = findings.groupBy(*keys).agg(
        *[F.max(F.array_contains(t, F.lit(x))).alias(f"__f{i}") for i, x in enumerate(types)],
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.size(t) > 0).alias("pii_columns"),
    )
    arr = F.array_compact(F.array(*[F.when(F.col(f"__f{i}"), F.lit(x)) for i, x in enumerate(types)]))
    out = g.select(*keys, arr.alias("pii_types"), "columns", "pii_columns")
    out = out.withColumn("data_classification", C.data_classification(F.col("pii_types")))
    return out.withColumn("access_level", C.access_level(F.col("data_classification")))


def classify_sources(catalog_results: DataFrame, name_col: str = "name") -> DataFrame:
    """D7 + C4 + C5: source-name profile. Output: source, type, database,
    pii_types (duplicates kept), risk_level (HIGH/MEDIUM/NO_RISK), tagged, and
    the four applied tags as a map. Only a cataloged source can be tagged:
    ``tagged`` is its ``status`` (input without one counts as cataloged), and
    a source that is not tagged has no tags."""
    n = F.col(name_col)
    types = D.source_types(n)
    status = F.coalesce(F.col("status") == rules.CATALOGED, F.lit(False))
    out = catalog_results.select(
        n.alias("source"),
        F.col("type"),
        F.col("database"),
        types.alias("pii_types"),
        (status if "status" in catalog_results.columns else F.lit(True)).alias("tagged"),
    )
    out = out.withColumn("risk_level", C.source_risk(F.col("pii_types")))
    tag_map = F.create_map(
        F.lit("DataClassification"), F.col("risk_level"),
        F.lit("AccessLevel"), C.access_level(F.col("risk_level")),
        F.lit("PIIType"), C.primary_type(F.col("pii_types")),
        F.lit("DataGovernance"), C.source_governance(F.col("pii_types"), F.col("risk_level")),
    )
    out = out.withColumn("tags", F.when(F.col("tagged"), tag_map))
    return out.select("source", "type", "database", "pii_types", "risk_level", "tagged", "tags")


def source_tags(classified: DataFrame) -> DataFrame:
    """C5 in long form: ``(database, table_name, column_name NULL, tag_key, tag_value)``."""
    return classified.select(
        F.col("database"),
        F.col("source").alias("table_name"),
        F.lit(None).cast("string").alias("column_name"),
        F.explode(F.col("tags")).alias("tag_key", "tag_value"),
    )


def tag_definitions(spark: SparkSession, definitions: dict[str, list[str]] | None = None) -> DataFrame:
    definitions = definitions or rules.COLUMN_TAG_DEFINITIONS
    rows = [(k, v) for k, vs in definitions.items() for v in vs]
    return local_frame(spark, rows, TAG_DEF_SCHEMA)


def ensure_tag_definitions(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add wanted (tag_key, tag_value) pairs not yet defined; present ones
    stay (idempotent). Returns the full definition table with a status."""
    keys = ["tag_key", "tag_value"]
    ex = existing.select(*keys).dropDuplicates(keys)
    new = wanted.select(*keys).dropDuplicates(keys).join(ex, keys, "left_anti")
    return ex.withColumn("status", F.lit("exists")).unionByName(new.withColumn("status", F.lit("created")))


def apply_tags(existing: DataFrame, new: DataFrame, keys=RESOURCE_KEYS, seq_col: str = "seq") -> DataFrame:
    """Keyed upsert of tag assignments, last write (highest ``seq``) wins
    per (resource, tag_key); ties go to the larger value, so the result is
    deterministic.

    ``max(struct(seq, value))`` is a partial aggregate: a resource retagged
    millions of times is combined map-side, never gathered into one task.
    """
    k = list(keys) + ["tag_key"]
    cols = k + ["tag_value", seq_col]
    u = existing.select(*cols).unionByName(new.select(*cols))
    latest = u.groupBy(*k).agg(F.max(F.struct(F.col(seq_col).alias("s"), F.col("tag_value").alias("v"))).alias("m"))
    return latest.select(*k, F.col("m.v").alias("tag_value"), F.col("m.s").alias(seq_col))


def register_resources(registry: DataFrame, new: DataFrame, col: str = "resource") -> DataFrame:
    """Idempotent registration. Returns every resource once with
    ``registered`` (new) or ``already_registered`` (present before)."""
    ex = registry.select(col).dropDuplicates([col])
    fresh = new.select(col).dropDuplicates([col]).join(ex, col, "left_anti")
    return ex.withColumn("status", F.lit("already_registered")).unionByName(
        fresh.withColumn("status", F.lit("registered"))
    )
