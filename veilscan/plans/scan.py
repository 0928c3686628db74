"""End-to-end scans composed from the operators.

* ``full_scan``          - catalog columns by name, objects by content, item
                           tables by serialised rows; tags and totals.
* ``discovery_workflow`` - register sources, classify them by name, tag them,
                           count and write the dashboard report.
* ``direct_object_scan`` / ``direct_item_scan`` - the direct content scans.

Steps are lazy DataFrames; registration, report sinks and (with
``materialize``) the checkpoint of the findings trigger work.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan import rules
from veilscan.functions import detect as D
from veilscan.functions import text as T
from veilscan.operators import findings as FD
from veilscan.operators import reports as R
from veilscan.operators import tags as TG
from veilscan.session import cut_lineage, local_frame
from veilscan.sources.catalog import (
    TABLES_SCHEMA,
    catalog_columns_from_frames,
    list_folder,
    read_catalog,
    register_sources,
)
from veilscan.sources.commits import commit_report
from veilscan.sources.objects import all_objects, object_findings, object_inventory, object_texts, scheme_of
from veilscan.sources.sinks import write_report
from veilscan.sources.windows import RANGED, WINDOW_BYTES, object_windows


OBJECT_STATUSES = ("scanned", "empty", "unreadable")


@dataclass
class ScanResult:
    catalog: DataFrame
    tables: DataFrame
    object_status: DataFrame | None
    column_findings: DataFrame
    object_findings: DataFrame | None
    item_findings: DataFrame | None
    column_tags: DataFrame
    table_classes: DataFrame
    totals: DataFrame
    classification_summary: DataFrame
    registry: DataFrame

    def findings(self) -> DataFrame:
        return R.unified_findings(self.column_findings, self.object_findings, self.item_findings)

    def split(self) -> tuple[DataFrame, DataFrame]:
        return R.split_findings(self.findings())


def full_scan(
    spark: SparkSession,
    tables: dict[str, DataFrame] | None = None,
    databases: list[str] | None = None,
    objects: DataFrame | None = None,
    item_tables: dict[str, DataFrame] | None = None,
    database: str = "default",
    materialize: bool = True,
    existing_registry: DataFrame | None = None,
) -> ScanResult:
    """The three-phase scan, over whole objects and all rows.

    With ``materialize`` the object and item findings are checkpointed once
    (reliably, in ``spark.checkpoint.dir``) and shared by all reports.
    ``registry`` lists the resources the scan registers (tables, table
    locations, objects with PII), merged into ``existing_registry``.

    Phase 1: column names of ``tables`` (DataFrames) or of the catalog
    ``databases``. Phase 2: ``objects``, either ``(path, size_bytes, text)`` or
    already scanned ``(path, size_bytes, pii_types, status)`` as
    ``scan_objects_under`` returns them; unreadable ones are counted in
    ``object_status``. Phase 3: every row of each item table serialised to JSON.
    """
    if tables is not None:
        catalog = catalog_columns_from_frames(spark, tables, database=database)
        listed = local_frame(spark, [(database, n, None, rules.CATALOGED, None) for n in tables], TABLES_SCHEMA)
    else:
        listed, catalog = read_catalog(spark, databases)
    cols = FD.column_name_findings(catalog)
    objs = status = None
    if objects is not None and "text" in objects.columns:
        objs = FD.scan_objects(objects)
    elif objects is not None:
        status = objects.groupBy("status").agg(F.count(F.lit(1)).alias("objects"))
        objs = FD.with_classification(objects.where(F.size("pii_types") > 0)).withColumn(
            "confidence", D.confidence_map(F.col("pii_types"), rules.PATTERN_CONFIDENCE)
        )
    items = FD.scan_item_tables(item_tables) if item_tables else None
    if materialize:
        # The content scans are the expensive part and every report below is
        # its own action; their findings (hit rows only) are written once to
        # the shared checkpoint folder so no report rescans the inputs.
        objs = cut_lineage(objs) if objs is not None else None
        status = cut_lineage(status) if status is not None else None
        items = cut_lineage(items) if items is not None else None
    findings = R.unified_findings(cols, objs, items)
    # Resources registered by the scan: every catalog table, each table
    # location, and each object with PII (idempotent against a registry).
    res = listed.where(F.col("table_name").isNotNull()).select(
        F.concat_ws(".", "database", "table_name").alias("resource")
    ).unionByName(
        listed.where(F.col("location").isNotNull()).select(F.col("location").alias("resource"))
    )
    if objs is not None:
        res = res.unionByName(objs.select(F.col("path").cast("string").alias("resource")))
    registry = TG.register_resources(
        existing_registry if existing_registry is not None else res.limit(0), res
    )
    return ScanResult(
        catalog=catalog,
        tables=listed,
        object_status=status,
        column_findings=cols,
        object_findings=objs,
        item_findings=items,
        column_tags=TG.column_tags(cols),
        table_classes=TG.table_classification(cols),
        totals=R.scan_totals(listed.where(F.col("table_name").isNotNull()), cols, objs, items),
        classification_summary=R.classification_summary_of(cols, objs, items),
        registry=registry,
    )


@dataclass
class ScanConfig:
    """Driver-side scan settings.

    ``databases``: catalog databases to scan (empty = all). ``object_paths``:
    file roots scanned as objects (all of them, not only the first);
    ``item_tables``: name -> path of tables scanned row by row.
    """

    databases: list[str] = field(default_factory=list)
    enable_object_discovery: bool = True
    enable_item_discovery: bool = True
    object_paths: list[str] = field(default_factory=list)
    object_prefix: str = ""
    item_tables: dict[str, str] = field(default_factory=dict)
    item_format: str = "parquet"
    materialize: bool = True


def scan_objects_under(
    spark: SparkSession, path: str, prefix: str = "", profile="content", glob: str | None = None, window_bytes: int = WINDOW_BYTES
) -> DataFrame:
    """Every object under ``path`` with its whole content scanned: the
    inventory's columns, ``pii_types``, ``status`` (``scanned``, ``empty`` or
    ``unreadable``) and ``error``.

    Objects of any size are matched in windows of ``window_bytes``, with the
    same types at every size. With patterns of one's own (which may span
    anything), or under a root that only Spark can read, each object is one text.
    """
    if isinstance(profile, dict) or scheme_of(path) not in RANGED:
        inventory = object_inventory(spark, path, prefix=prefix, glob=glob)
        found = object_findings(inventory, object_texts(spark, path, prefix, glob), profile)
        return found.drop("uri").withColumn("error", F.lit(None).cast("string"))
    inventory = all_objects(spark, path, prefix, glob)
    windows = object_windows(inventory, window_bytes)
    texts = windows.where("error IS NULL").select("path", F.col("content").cast("string").alias("text"))
    errors = windows.where("error IS NOT NULL").select("path", "error")
    return object_findings(inventory, texts, profile, "path", errors)


def committed_scan(
    spark: SparkSession,
    path: str,
    listed: DataFrame,
    columns: DataFrame,
    objects: DataFrame | None = None,
    items: DataFrame | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Write the findings of a scan as one committed run below ``path`` and return its totals.

    ``listed`` are the tables (``database, table_name``), the others findings of the three
    kinds; ``objects`` may hold all objects with their ``status``. Every number is counted by the
    job that writes the part, so neither the inputs nor the findings are read a second time. The
    totals have the columns of ``reports.scan_totals`` and ``objects_<status>`` if there are any.
    """
    has = F.coalesce(F.size("pii_types") > 0, F.lit(False))
    parts = {"tables": listed.select("database", "table_name").distinct(), "columns": columns}
    counters = {"columns": {"with_pii": F.count_if(has)}}
    statuses: list[str] = []
    if objects is not None:
        parts["objects"], counters["objects"] = objects, {"with_pii": F.count_if(has)}
        if "status" in objects.columns:
            statuses = list(OBJECT_STATUSES)
            counters["objects"] |= {f"objects_{s}": F.count_if(F.col("status") == s) for s in statuses}
    if items is not None:
        parts["items"], counters["items"] = items, {"with_pii": F.count_if(has)}
    seen = commit_report(spark, path, parts, counters, run_id)
    number = lambda part, name: seen.get(part, {}).get(name, 0)
    tables, objects_n, items_n = number("tables", "rows"), number("objects", "with_pii"), number("items", "with_pii")
    totals = {
        "total_sources": tables + objects_n + items_n,
        "total_tables": tables,
        "total_columns": number("columns", "rows"),
        "pii_columns_found": number("columns", "with_pii"),
        "no_risk_columns_found": number("columns", "rows") - number("columns", "with_pii"),
        "pii_sources_found": objects_n + items_n,
        "glue_tables_scanned": tables,
        "objects_with_pii": objects_n,
        "item_tables_with_pii": items_n,
        **{f"objects_{s}": number("objects", f"objects_{s}") for s in statuses},
    }
    return local_frame(spark, [tuple(totals.values())], ", ".join(f"{n} bigint" for n in totals))


def run_scan(spark: SparkSession, config: ScanConfig) -> ScanResult:
    """Catalog columns of ``config.databases``, all objects under every path
    of ``config.object_paths``, and every row of each item table."""
    objects = None
    if config.enable_object_discovery and config.object_paths:
        parts = [scan_objects_under(spark, p, config.object_prefix) for p in config.object_paths]
        objects = reduce(lambda a, b: a.unionByName(b), parts)
    items = None
    if config.enable_item_discovery and config.item_tables:
        items = {n: spark.read.format(config.item_format).load(p) for n, p in config.item_tables.items()}
    return full_scan(
        spark, databases=config.databases or None, objects=objects, item_tables=items, materialize=config.materialize
    )


@dataclass
class DiscoveryResult:
    catalog_results: DataFrame
    classified: DataFrame
    source_tags: DataFrame
    counts: DataFrame
    kpis: DataFrame
    type_counts: DataFrame
    report_path: str | None


def discovery_workflow(
    spark: SparkSession,
    file_sources: dict[str, str] | None = None,
    item_sources: dict[str, str] | None = None,
    report_path: str | None = None,
    fmt: str = "parquet",
    commit: bool = False,
) -> DiscoveryResult:
    """Register sources -> classify by name -> tag -> count -> KPIs -> report.

    With ``commit`` the report's parts are one committed run below ``report_path``
    (read them with ``sources.commits.read_report``); without, each part is a folder
    of JSON that is overwritten by itself."""
    cat = register_sources(spark, file_sources, item_sources, fmt=fmt)
    cls = TG.classify_sources(cat)
    counts = R.run_counts(cat, cls)
    k = R.kpis(counts)
    type_counts = R.pii_type_counts(cls)
    if report_path:
        parts = {
            "kpis": k,
            "counts": counts,
            "type_counts": type_counts,
            "tag_keys": R.tag_keys_used(cls),
            "catalog": cat,
            "classified": cls.select("source", "type", "database", "pii_types", "risk_level", "tagged", "tags"),
        }
        if commit:
            commit_report(spark, report_path, parts)
        else:
            for name, df in parts.items():
                write_report(df, f"{report_path}/{name}")
    return DiscoveryResult(cat, cls, TG.source_tags(cls), counts, k, type_counts, report_path)


def discovery_from_roots(
    spark: SparkSession, roots=(), report_path: str | None = None, fmt: str = "parquet"
) -> DiscoveryResult:
    """Discover the sub-folders of ``roots`` as file sources and run the
    discovery workflow on them. Only folder names are listed."""
    files = {name: path for root in roots for name, path, folder in list_folder(spark, root) if folder}
    return discovery_workflow(spark, files, None, report_path=report_path, fmt=fmt)


def direct_object_scan(spark: SparkSession, path: str) -> DataFrame:
    """Text objects with a .txt/.csv/.json suffix: the simple detector on their
    whole content; objects with hits as ``path, size_bytes, pii_types``."""
    found = scan_objects_under(spark, path, profile="simple").where(T.suffix_filter(F.col("path")))
    return found.where(F.size("pii_types") > 0).select("path", "size_bytes", "pii_types")


def scan_object_files(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Object scan over files: list, read every object whole, detect, classify.

    Objects with PII, and unreadable ones with status ``unreadable``."""
    found = scan_objects_under(spark, path, prefix)
    found = found.where((F.size("pii_types") > 0) | (F.col("status") == "unreadable"))
    out = found.withColumn("confidence", D.confidence_map(F.col("pii_types"), rules.PATTERN_CONFIDENCE))
    return FD.with_classification(out).withColumn("source_type", F.lit("object"))


def direct_item_scan(df: DataFrame, key_cols, table_name: str) -> DataFrame:
    """The simple detector on every string attribute of every row."""
    return FD.scan_string_attributes(df, key_cols, table_name)


def masked_copy(df: DataFrame, path: str, custom_rules=None, fmt: str = "parquet") -> str:
    """Write a masked copy of ``df`` (columns masked by their name profile)."""
    from veilscan.operators.masking import mask_table

    mask_table(df, custom_rules=custom_rules).write.mode("overwrite").format(fmt).save(path)
    return path


__all__ = [
    "ScanResult", "ScanConfig", "run_scan", "DiscoveryResult", "discovery_from_roots", "full_scan", "discovery_workflow",
    "committed_scan", "direct_object_scan", "scan_object_files", "scan_objects_under",
    "direct_item_scan", "masked_copy",
]
