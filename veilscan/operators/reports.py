"""Reports: scan totals, classification summary, run counts, KPIs.

Every report is an aggregation over findings DataFrames; none is computed
on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan import rules


def _has_pii(types_col: str = "pii_types"):
    return F.coalesce(F.size(F.col(types_col)) > 0, F.lit(False))


def split_findings(findings: DataFrame, types_col: str = "pii_types") -> tuple[DataFrame, DataFrame]:
    """R2: (findings with PII, findings without)."""
    return findings.where(_has_pii(types_col)), findings.where(~_has_pii(types_col))


FINDING_COLUMNS = [
    ("source_type", "string"), ("database", "string"), ("table_name", "string"), ("column_name", "string"),
    ("column_type", "string"), ("object_path", "string"), ("size_bytes", "bigint"), ("item_count", "bigint"),
    ("pii_types", "array<string>"), ("confidence", "map<string,double>"), ("data_classification", "string"),
    ("access_level", "string"),
]


def _conform(df: DataFrame, source_type: str, renames: dict[str, str]) -> DataFrame:
    cols = []
    for name, typ in FINDING_COLUMNS:
        if name == "source_type":
            cols.append(F.lit(source_type).alias(name))
            continue
        src = renames.get(name, name)
        if src in df.columns:
            cols.append(F.col(src).cast(typ).alias(name))
        else:
            cols.append(F.lit(None).cast(typ).alias(name))
    return df.select(*cols)


def unified_findings(
    columns: DataFrame | None = None, objects: DataFrame | None = None, items: DataFrame | None = None
) -> DataFrame:
    """One finding schema over the three kinds (``FINDING_COLUMNS``):
    ``source_type`` is ``column``, ``object`` or ``item_table``; fields a
    kind does not have are NULL."""
    parts = []
    if columns is not None:
        parts.append(_conform(columns, "column", {}))
    if objects is not None:
        parts.append(_conform(objects, "object", {"object_path": "path"}))
    if items is not None:
        parts.append(_conform(items, "item_table", {}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_totals(
    catalog_tables: DataFrame,
    column_findings: DataFrame,
    object_findings: DataFrame | None = None,
    item_findings: DataFrame | None = None,
    content: DataFrame | None = None,
) -> DataFrame:
    """R1 as one row.

    ``total_sources`` = catalog tables + objects with PII + item tables with
    PII; ``pii_sources_found`` counts only objects and item tables;
    ``no_risk_columns_found`` counts columns only. ``catalog_tables`` is the
    table list (a table without columns still counts if the list has it).
    Objects and item tables are given as findings, or both counted as
    ``findings.totals_of_scan`` has them.
    """
    # Each input is aggregated on its own (its own map stage, so independent
    # scans run concurrently) and only the partial rows are unioned and summed.
    counters = ["total_tables", "total_columns", "pii_columns_found", "no_risk_columns_found",
                "objects_with_pii", "item_tables_with_pii"]

    def part(df: DataFrame, **aggs) -> DataFrame:
        row = df.agg(*[a.alias(k) for k, a in aggs.items()])
        return row.select(*[(F.coalesce(F.col(k), F.lit(0)) if k in aggs else F.lit(0)).cast("long").alias(k) for k in counters])

    has = _has_pii()
    parts = [
        part(catalog_tables.select("database", "table_name").distinct(), total_tables=F.count(F.lit(1))),
        part(column_findings, total_columns=F.count(F.lit(1)), pii_columns_found=F.count_if(has),
             no_risk_columns_found=F.count_if(~has)),
    ]
    if object_findings is not None:
        parts.append(part(object_findings, objects_with_pii=F.count_if(has)))
    if content is not None:
        sums = {name: F.sum(name) for name in ("objects_with_pii", "item_tables_with_pii")}
        parts.append(part(content, **sums))
    if item_findings is not None:
        parts.append(part(item_findings, item_tables_with_pii=F.count_if(has)))
    f = reduce(lambda x, y: x.unionByName(y), parts).agg(*[F.sum(k).cast("long").alias(k) for k in counters])
    return f.select(
        (F.col("total_tables") + F.col("objects_with_pii") + F.col("item_tables_with_pii")).alias("total_sources"),
        F.col("total_tables"),
        F.col("total_columns"),
        F.col("pii_columns_found"),
        F.col("no_risk_columns_found"),
        (F.col("objects_with_pii") + F.col("item_tables_with_pii")).alias("pii_sources_found"),
        F.col("total_tables").alias("glue_tables_scanned"),
        F.col("objects_with_pii"),
        F.col("item_tables_with_pii"),
    )


def classification_summary(findings: DataFrame) -> DataFrame:
    """R3 in long form: per classification and table the number of findings.

    The table is ``db.table`` for columns, the bare name for item tables and
    ``unknown`` for objects. Tables are rows, never gathered into a set."""
    table = (
        F.when(F.col("source_type") == "column", F.concat_ws(".", "database", "table_name"))
        .when(F.col("source_type") == "item_table", F.col("table_name"))
        .otherwise(F.lit("unknown"))
    )
    return findings.groupBy("data_classification", table.alias("table_name")).agg(F.count(F.lit(1)).alias("count"))


def classification_summary_of(
    columns: DataFrame | None = None, objects: DataFrame | None = None, items: DataFrame | None = None
) -> DataFrame:
    """R3 over the three finding kinds."""
    return classification_summary(unified_findings(columns, objects, items))


def classification_summary_once(columns: DataFrame, counted: DataFrame) -> DataFrame:
    """R3 from column findings and ``findings.classes_of_scan``."""
    rows = classification_summary_of(columns)
    return rows.unionByName(counted.select("data_classification", "table_name", "count"))


def run_counts(catalog_results: DataFrame, classified: DataFrame) -> DataFrame:
    """R4 as one row: sources by kind, cataloged / failed, per-risk counts,
    tagged resources, total classified. LOW is counted for parity but the
    source profile never yields it."""
    cat = catalog_results.select(
        F.lit("catalog").alias("kind"), F.col("type"), F.col("status"),
        F.lit(None).cast("string").alias("risk_level"), F.lit(None).cast("boolean").alias("tagged"),
    )
    cls = classified.select(
        F.lit("classified").alias("kind"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("status"), F.col("risk_level"), F.col("tagged").cast("boolean"),
    )
    is_cat = F.col("kind") == "catalog"
    is_cls = F.col("kind") == "classified"
    r = F.col("risk_level")
    return cat.unionByName(cls).agg(
        F.count_if(is_cat & (F.col("type") == "file")).alias("file_sources"),
        F.count_if(is_cat & (F.col("type") == "table")).alias("table_sources"),
        F.count_if(is_cat).alias("total_cataloged"),
        F.count_if(is_cat & (F.col("status") == rules.CATALOGED)).alias("successful"),
        F.count_if(is_cat & (F.col("status") == rules.CATALOG_ERROR)).alias("failed"),
        F.count_if(is_cls).alias("total_classified"),
        F.count_if(is_cls & (r == "HIGH")).alias("high_risk"),
        F.count_if(is_cls & (r == "MEDIUM")).alias("medium_risk"),
        F.count_if(is_cls & (r == "LOW")).alias("low_risk"),
        F.count_if(is_cls & (r == "NO_RISK")).alias("no_risk"),
        F.count_if(is_cls & F.coalesce(F.col("tagged"), F.lit(False))).alias("tagged_resources"),
    )


def kpis(counts: DataFrame) -> DataFrame:
    """R6 from R4: totals, PII sources (high + medium), compliance score
    ``min(100, tagged / max(1, pii) * 100)`` and uncataloged sources."""
    total = F.col("file_sources") + F.col("table_sources")
    pii = F.col("high_risk") + F.col("medium_risk")
    return counts.select(
        total.alias("total_sources"),
        F.col("successful").alias("cataloged_sources"),
        pii.alias("pii_sources"),
        F.col("high_risk").alias("high_risk_sources"),
        F.least(F.lit(100.0), F.col("tagged_resources") / F.greatest(F.lit(1), pii) * F.lit(100.0)).alias(
            "compliance_score"
        ),
        F.col("file_sources"),
        F.col("table_sources"),
        F.greatest(F.lit(0), total - F.col("successful")).alias("uncataloged"),
        F.col("high_risk"),
        F.col("medium_risk"),
        F.col("low_risk"),
    )


def pii_type_counts(classified: DataFrame, types_col: str = "pii_types") -> DataFrame:
    """Occurrences of each type over sources (duplicates in a source count)."""
    return (
        classified.select(F.explode(F.col(types_col)).alias("pii_type"))
        .groupBy("pii_type")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def tag_keys_used(classified: DataFrame, tags_col: str = "tags") -> DataFrame:
    """Distinct tag keys applied."""
    return classified.select(F.explode(F.map_keys(F.col(tags_col))).alias("tag_key")).distinct()


def workflow_summary(catalog_results: DataFrame, classified: DataFrame) -> DataFrame:
    """Sources, cataloged items, classified sources, HIGH sources."""
    c = run_counts(catalog_results, classified)
    return c.select(
        (F.col("file_sources") + F.col("table_sources")).alias("data_sources"),
        F.col("total_cataloged").alias("cataloged_items"),
        F.col("total_classified").alias("classified_sources"),
        F.col("high_risk").alias("high_risk_sources"),
    )


def type_summary(findings: DataFrame, group_col: str, types_col: str = "pii_types") -> DataFrame:
    """Per type: rows with it and distinct ``group_col`` values holding it."""
    return (
        findings.select(F.col(group_col), F.explode(F.col(types_col)).alias("pii_type"))
        .groupBy("pii_type")
        .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group_col).alias("groups"))
    )


def risk_breakdown(classified: DataFrame) -> DataFrame:
    """R4 + R6 at every level: classified sources counted by type and risk, by type, by risk, and
    in all, in one pass (``GROUPING SETS``).

    ``level`` names the columns that a row is grouped by (``total`` for none); the others are
    null there. ``share`` is the part of the level's sources (percent), ``tagged`` and
    ``with_pii`` count them. A null type or risk is a group of its own.
    """
    rows = classified.select("type", "risk_level", F.col("tagged").cast("boolean").alias("tagged"), (F.size("pii_types") > 0).alias("pii"))
    by, risk = F.col("type"), F.col("risk_level")
    counted = rows.groupingSets([[by, risk], [by], [risk], []], by, risk).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("sources"),
        F.count_if("tagged").alias("tagged"),
        F.count_if("pii").alias("with_pii"),
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("type,risk_level", "type", "risk_level", "total")]), (F.col("gid") + 1).cast("int"))
    # every level counts each source once
    whole = F.first("sources").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("gid")))
    return counted.select(
        level.alias("level"), "type", "risk_level", "sources", "tagged", "with_pii", F.round(100 * F.col("sources") / whole, 6).alias("share")
    ).where(F.col("sources") > 0)
