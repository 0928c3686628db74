"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole test tables. Output columns are flat (types joined with
commas) so results can be compared with the DuckDB cross-check in
``veilscan.oracle``.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan import rules
from veilscan.functions import classify as C
from veilscan.functions import detect as D
from veilscan.functions.mask import mask_by_type, masking_rule
from veilscan.operators import findings as FD
from veilscan.operators import json_attributes as JA
from veilscan.operators import reports as R
from veilscan.operators import tags as TG
from veilscan.operators.masking import mask_table
from veilscan.operators.registry import register_batch
from veilscan.plans import standins
from veilscan.plans.scan import committed_scan, scan_objects_under
from veilscan.session import TABLES, ensure_checkpoint_dir, local_frame, read_table, read_tables, table_path
from veilscan.sources.catalog import catalog_columns, catalog_columns_from_frames, register_sources
from veilscan.sources.commits import commit_report, read_report
from veilscan.sources.footers import column_statistics
from veilscan.sources.objects import source_summary as _source_summary
from veilscan.sources.objects import tables_stats as _tables_stats
from veilscan.sources.samples import sample_rows
from veilscan.sources.tag_store import create_tag_store, upsert_tags

CATALOG_DB = "main"


def _flat(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, C.types_string("pii_types").alias("pii_types"), "data_classification", "access_level")


# --------------------------------------------------------------------------
# Content detection
# --------------------------------------------------------------------------


def content_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 -> C1 -> C2 over every document text."""
    docs = read_table(spark, sf_dir, "documents")
    return _flat(FD.content_findings(docs, "doc_id", "text"), ["doc_id"])


def content_findings_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 over every raw web page."""
    pages = read_table(spark, sf_dir, "pages")
    return _flat(FD.content_findings(pages, "page_id", "html"), ["page_id"])


def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 over every conversation turn (a clean control: no hits expected)."""
    conv = read_table(spark, sf_dir, "conversations")
    return _flat(FD.content_findings(conv, ["conv_id", "turn"], "text"), ["conv_id", "turn"])


def simple_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 (EMAIL, SSN, strict PHONE) over every document text."""
    docs = read_table(spark, sf_dir, "documents")
    return _flat(FD.content_findings(docs, "doc_id", "text", profile="simple"), ["doc_id"])


HEAD_BYTES, HEAD_CHARS, SAMPLE_ROWS = 1024, 1000, 10


def head_byte_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + D2: an explicit sample, the first 1024 UTF-8 bytes of each document."""
    docs = read_table(spark, sf_dir, "documents")
    return _flat(FD.head_byte_findings(docs, "doc_id", "text", HEAD_BYTES), ["doc_id"])


def head_char_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + D3: an explicit sample, the first 1000 characters of each document."""
    docs = read_table(spark, sf_dir, "documents")
    return _flat(FD.head_char_findings(docs, "doc_id", "text", HEAD_CHARS), ["doc_id"])


def object_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents viewed as objects (path, size, text); objects whose whole
    text holds PII."""
    objs = standins.document_objects(read_table(spark, sf_dir, "documents"))
    out = FD.scan_objects(objs)
    return out.select("path", "size_bytes", C.types_string("pii_types").alias("pii_types"), "data_classification")


def stored_object_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + D9: document texts written as text objects in a folder for each source, listed in tasks
    and read in windows; bytes, objects that could not be read, and types of each folder.

    A sign that no pattern takes ends each text, so that none matches into the next one."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/veilscan-objects/{uuid.uuid4().hex}"
    line = F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit("#"))
    docs = read_table(spark, sf_dir, "documents")
    named = F.coalesce(F.concat(F.lit("is-"), F.hex("source")), F.lit("none"))
    docs.select(named.alias("folder"), line.alias("value")).write.partitionBy("folder").text(root)
    folder = F.regexp_extract("path", "/folder=([^/]*)/[^/]*$", 1)
    found = scan_objects_under(spark, root).groupBy(folder.alias("folder"), "content_type").agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.count_if(F.col("status") == "unreadable").alias("unreadable"),
        F.array_compact(
            F.array(*[F.when(F.max(F.array_contains("pii_types", t)), F.lit(t)) for t in rules.CONTENT_TYPES])
        ).alias("pii_types"),
    )
    return found.select(
        F.when(F.col("folder") != "none", F.unhex(F.substring_index("folder", "-", -1)).cast("string")).alias("source"),
        "content_type", "size_bytes", "unreadable", C.types_string("pii_types").alias("pii_types"),
        C.data_classification("pii_types").alias("data_classification"),
    )


def finding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: documents as objects, with their types or none, split into findings
    with PII and without; counts of both by source."""
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("source", D.content_types("text", "content").alias("pii_types"))
    with_pii, without = R.split_findings(found)
    both = with_pii.select("source", F.lit(True).alias("has_pii")).unionByName(
        without.select("source", F.lit(False).alias("has_pii"))
    )
    return both.groupBy("source", "has_pii").agg(F.count(F.lit(1)).alias("documents"))


def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per content type: documents holding it and distinct sources."""
    docs = read_table(spark, sf_dir, "documents")
    f = FD.content_findings(docs, "doc_id", "text", keep_cols=["source"])
    return R.type_summary(f, "source").select(
        "pii_type", F.col("rows").alias("documents"), F.col("groups").alias("sources")
    )


def source_table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document row serialised to JSON and scanned; types unioned
    per ``source`` (each source is an item table)."""
    docs = read_table(spark, sf_dir, "documents")
    out = FD.scan_items_json(docs, table_col="source")
    return out.select("table_name", "item_count", C.types_string("pii_types").alias("pii_types"), "data_classification")


def string_attribute_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple detector on every string attribute of every page."""
    pages = read_table(spark, sf_dir, "pages")
    out = FD.scan_string_attributes(pages, "page_id", "pages")
    return out.select(
        "page_id", C.types_string("pii_types").alias("pii_types"), F.concat_ws(",", "attributes").alias("attributes")
    )


def column_content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content profile of every string column of every table: rows matching
    each type, per (table, column). Only columns with a hit are returned."""
    return FD.column_content_profile(read_tables(spark, sf_dir))


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern findings merged with recogniser entities (max score per type)."""
    docs = read_table(spark, sf_dir, "documents")
    pat = FD.content_findings_long(docs, "doc_id", "text")
    ents = standins.recogniser_entities(docs)
    out = FD.merge_entity_scores(pat, ents)
    return out.select(
        "doc_id",
        C.types_string("pii_types").alias("pii_types"),
        *[f"score_{t.lower()}" for t in rules.CONTENT_TYPES],
        "data_classification",
    )


# --------------------------------------------------------------------------
# Catalog: column-name profile, tags, roll-ups
# --------------------------------------------------------------------------


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute of the tables with the number of rows that have it, from the files' footers."""
    found = column_statistics(spark, {name: table_path(sf_dir, name) for name in TABLES})
    return found.drop("table_rows").withColumns(
        {"database": F.lit(CATALOG_DB), "location": F.lit(None).cast("string")}
    )


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_columns_from_frames(spark, read_tables(spark, sf_dir), database=CATALOG_DB)


def column_name_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + D1 + C1 + C2 over every attribute of the 14 tables, also those without a value."""
    f = FD.column_name_findings(_attributes(spark, sf_dir))
    return _flat(f, ["table_name", "column_name", "rows"])


def analyze_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 for every table over its attributes: is_pii, first type or N/A, confidence."""
    out = FD.analyze_table(_attributes(spark, sf_dir))
    return out.select("table_name", F.col("name").alias("column_name"), "is_pii", "pii_type", "confidence")


def column_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 over all attributes: 5 tags per PII column, 4 defaults per clean column."""
    f = FD.column_name_findings(_attributes(spark, sf_dir))
    return TG.column_tags(f).select("table_name", "column_name", "tag_key", "tag_value")


def table_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables rolled up from the findings of their attributes."""
    f = FD.column_name_findings(_attributes(spark, sf_dir))
    out = TG.table_classification(f)
    return out.select(
        "table_name", C.types_string("pii_types").alias("pii_types"), "columns", "pii_columns",
        "data_classification", "access_level",
    )


def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 -> S1: the given tables registered as external tables, walked back from the catalog, and
    each read by its catalog name; a second registration finds the same tables."""
    # tables of another folder have databases of their own, so nothing of theirs is replaced
    mark = f"{zlib.crc32(sf_dir.rstrip('/').encode()):08x}"
    registered = register_sources(spark, file_sources={f"{name}-{mark}": table_path(sf_dir, name) for name in TABLES})
    found = registered.where(F.col("status") == rules.CATALOGED)
    names = [(r["database"], r["table_name"]) for r in found.select("database", "table_name").collect()]
    columns = catalog_columns(spark, [db for db, _ in names])
    counted = [
        spark.table(f"{FD.quoted(db)}.{FD.quoted(table)}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("t"), "rows")
        for db, table in names
    ]
    rows = reduce(lambda a, b: a.unionByName(b), counted)
    return columns.join(rows, F.col("table_name") == F.col("t")).select(
        F.regexp_replace("table_name", f"_{mark}$", "").alias("table_name"), "column_name", "column_type", "ordinal", "rows"
    )


def _classified(spark: SparkSession, sf_dir: str):
    """Sources found in the data: every web host of the pages (as file sources)
    and every ``documents.source`` (as item tables), registered if any of
    their rows has a text; the rest could not be cataloged."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit("file").alias("type"), F.regexp_extract("url", HOST_PATTERN, 1).alias("name"),
        (F.length("html") > 0).alias("filled"),
    )
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("table").alias("type"), F.col("source").alias("name"), (F.length("text") > 0).alias("filled")
    )
    found = pages.unionByName(docs).where(F.col("name") != "").groupBy("type", "name").agg(F.max("filled").alias("filled"))
    file_db = F.concat(F.regexp_replace("name", "[^0-9A-Za-z_]", "_"), F.lit(rules.FILE_DATABASE_SUFFIX))
    cat = found.select(
        "type", "name",
        F.when(F.col("filled"), F.lit(rules.CATALOGED)).otherwise(F.lit(rules.CATALOG_ERROR)).alias("status"),
        F.when(F.col("type") == "file", file_db).otherwise(F.lit(rules.ITEM_TABLE_DATABASE)).alias("database"),
    )
    return cat, TG.classify_sources(cat)


HOST_PATTERN = r"^https?://([^/?#]+)"


def _host_sources(spark: SparkSession, sf_dir: str):
    """Every distinct web host in ``pages.url`` as a cataloged source."""
    pages = read_table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", HOST_PATTERN, 1).alias("name")).where(F.col("name") != "").distinct()
    cat = hosts.select(
        F.lit("file").alias("type"), "name", F.lit(rules.CATALOGED).alias("status"),
        F.concat(F.replace("name", F.lit("-"), F.lit("_")), F.lit(rules.FILE_DATABASE_SUFFIX)).alias("database"),
    )
    return cat, TG.classify_sources(cat)


def risk_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 + R6: sources by type, by risk, by both, and in all, from one pass."""
    _, cls = _classified(spark, sf_dir)
    return R.risk_breakdown(cls)


def page_host_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 + C4 + C5 over the web hosts of all pages (sources derived from data)."""
    _, cls = _host_sources(spark, sf_dir)
    return cls.select(
        "source",
        C.types_string("pii_types").alias("pii_types"),
        "risk_level",
        F.col("tags")["AccessLevel"].alias("access_level"),
        F.col("tags")["PIIType"].alias("pii_type"),
        F.col("tags")["DataGovernance"].alias("data_governance"),
    )


def page_host_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 -> R6 over the web-host sources."""
    cat, cls = _host_sources(spark, sf_dir)
    return R.kpis(R.run_counts(cat, cls))


def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 + C4 + C5: the source-name profile over all sources found in the data."""
    _, cls = _classified(spark, sf_dir)
    return cls.select(
        "source",
        C.types_string("pii_types").alias("pii_types"),
        "risk_level",
        F.col("tags")["AccessLevel"].alias("access_level"),
        F.col("tags")["PIIType"].alias("pii_type"),
        F.col("tags")["DataGovernance"].alias("data_governance"),
    )


def source_tag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 in long form: four tags per source."""
    _, cls = _classified(spark, sf_dir)
    return TG.source_tags(cls).select("table_name", "tag_key", "tag_value")


def discovery_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 -> R6 over all sources found in the data."""
    cat, cls = _classified(spark, sf_dir)
    return R.kpis(R.run_counts(cat, cls))


def pii_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type occurrences over classified sources."""
    _, cls = _classified(spark, sf_dir)
    return R.pii_type_counts(cls)


def tag_keys_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tag keys applied to sources."""
    _, cls = _classified(spark, sf_dir)
    return R.tag_keys_used(cls)


def workflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, cataloged, classified, HIGH sources."""
    cat, cls = _classified(spark, sf_dir)
    return R.workflow_summary(cat, cls)


def tag_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag pairs that the tag change log and the attributes' tags use,
    added to the source-profile vocabulary."""
    existing = TG.tag_definitions(spark, rules.SOURCE_TAG_DEFINITIONS)
    log = standins.tag_change_log(read_table(spark, sf_dir, "events")).select("tag_key", "tag_value")
    produced = TG.column_tags(FD.column_name_findings(_attributes(spark, sf_dir))).select("tag_key", "tag_value")
    return TG.ensure_tag_definitions(existing, log.unionByName(produced))


def tag_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column tags of the catalog scan, then a tag change log applied on
    top; latest assignment per (resource, tag key) wins."""
    f = FD.column_name_findings(_catalog(spark, sf_dir))
    existing = TG.column_tags(f).withColumn("seq", F.lit(0).cast("long"))
    log = standins.tag_change_log(read_table(spark, sf_dir, "events"))
    return TG.apply_tags(existing, log)


def stored_tag_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 on a stored table: the catalog's tags, then the change log in two halves, the later one
    first; each upsert rewrites only the partitions it touches."""
    mark = uuid.uuid4().hex
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/veilscan-tags/{mark}"
    table = f"veilscan_tags_{mark}"
    create_tag_store(spark, table, path, parts=16, buckets=8)
    f = FD.column_name_findings(_catalog(spark, sf_dir))
    log = standins.tag_change_log(read_table(spark, sf_dir, "events"))
    upsert_tags(spark, table, TG.column_tags(f).withColumn("seq", F.lit(0).cast("long")))
    for half in (1, 0):
        upsert_tags(spark, table, log.where(F.col("seq") % 2 == half))
    found = spark.read.parquet(path).select("database", "table_name", "column_name", "tag_key", "tag_value", "seq")
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return found


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables registered first, then tables again plus every document
    object path; each resource once with its status."""
    tables = local_frame(spark, [(f"{CATALOG_DB}.{n}",) for n in TABLES], "resource string")
    objs = standins.document_objects(read_table(spark, sf_dir, "documents")).select(F.col("path").alias("resource"))
    return TG.register_resources(tables, tables.unionByName(objs))


def _documents_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scanned once, as objects and as items of their sources."""
    return FD.scan_documents_once(read_table(spark, sf_dir, "documents"), "source", "text")


def registry_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of all events registered against the registry of customers, which is not shuffled."""
    known = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("user/"), "c_custkey").alias("resource"))
    seen = read_table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), "user_id").alias("resource"))
    return register_batch(known, seen)


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog columns, object findings and item-table findings totalled."""
    catalog = _catalog(spark, sf_dir)
    content = FD.totals_of_scan(_documents_once(spark, sf_dir))
    return R.scan_totals(catalog, FD.column_name_findings(catalog), content=content)


def _report_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/veilscan-report-{uuid.uuid4().hex}"


def committed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + R1: the findings of the whole scan written as one committed run, their totals counted by the writes."""
    catalog, docs = _catalog(spark, sf_dir), read_table(spark, sf_dir, "documents")
    return committed_scan(
        spark, _report_path(spark), catalog, FD.column_name_findings(catalog), FD.scan_objects(standins.document_objects(docs)),
        FD.scan_items_json(docs, table_col="source"),
    )


def committed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: content findings of documents and pages written as the parts of one committed run and
    read back through its manifest."""
    found = {"documents": (content_findings, "doc_id"), "pages": (content_findings_pages, "page_id")}
    path = _report_path(spark)
    commit_report(spark, path, {part: query(spark, sf_dir).withColumnRenamed(key, "id") for part, (query, key) in found.items()})
    parts = [read_report(spark, path, part).select(F.lit(part).alias("part"), "*") for part in found]
    return reduce(lambda a, b: a.unionByName(b), parts)


def event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 + D6 inside JSON text: every attribute path of the events' properties, with value types and hits."""
    out = JA.json_attributes(read_table(spark, sf_dir, "events"), "props")
    return out.select(
        "path", "value_type", F.col("values").alias("n_values"), F.col("hits").alias("n_hits"), C.types_string("pii_types").alias("pii_types"),
        C.types_string("name_types").alias("name_types"), "data_classification", "access_level",
    )


def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 over columns, objects and item tables together, one row per class and table."""
    counted = FD.classes_of_scan(_documents_once(spark, sf_dir))
    return R.classification_summary_once(FD.column_name_findings(_catalog(spark, sf_dir)), counted)


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (documents) and item tables (document sources) counted."""
    docs = read_table(spark, sf_dir, "documents")
    objs = standins.document_objects(docs)
    tables = docs.select("source").distinct()
    return _source_summary(objs, tables)


def row_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 10 events per event type by event id (the sample is the feature)."""
    ev = read_table(spark, sf_dir, "events")
    return sample_rows(ev, SAMPLE_ROWS, "event_id", group_cols=["event_type"]).select(
        "event_type", "event_id", "user_id", "value"
    )


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 for every table: item count, number of attributes and their names."""
    out = _tables_stats(read_tables(spark, sf_dir))
    return out.select("table_name", "item_count", F.size("attributes").cast("long").alias("attributes"),
                      F.concat_ws(",", F.transform("attributes", lambda a: a["name"])).alias("attribute_names"))


STORED_TEXTS = {"documents": "text", "pages": "html", "conversations": "text"}


def stored_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 of tables stored as text: lines, bytes of the files, and the attributes with their types."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/veilscan-texts/{uuid.uuid4().hex}"
    stored = {}
    for name, column in STORED_TEXTS.items():
        read_table(spark, sf_dir, name).select(F.coalesce(F.col(column), F.lit("")).alias(column)).write.text(f"{root}/{name}")
        stored[name] = spark.read.text(f"{root}/{name}", lineSep="\n").withColumnRenamed("value", column)
    attributes = F.transform("attributes", lambda a: F.concat(a["name"], F.lit(":"), a["type"]))
    return _tables_stats(stored).select("table_name", "item_count", "size_bytes", F.concat_ws(",", attributes).alias("attributes"))


# --------------------------------------------------------------------------
# Masking
# --------------------------------------------------------------------------


def masking_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + M9: every PII column of the person table masked by its first
    column-name type with the default rules."""
    ppl = standins.people(read_table(spark, sf_dir, "customer"))
    return _flat_contact(mask_table(ppl))


def _flat_contact(df: DataFrame) -> DataFrame:
    """The struct column's parts as columns of their own."""
    parts = [F.col("contact.email").alias("contact_email"), F.concat_ws(";", "contact.phones").alias("contact_phones"),
             F.col("contact.id").alias("contact_id")]
    return df.select(*[c for c in df.columns if c != "contact"], *parts)


def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 per row: one typed value per person and column, masked by its row's type."""
    ppl = standins.people(read_table(spark, sf_dir, "customer"))
    typed = {"email": "EMAIL", "phone": "PHONE", "ssn": "SSN", "credit_card_number": "CREDIT_CARD", "c_mktsegment": "SEGMENT"}
    cells = F.array(*[F.struct(F.lit(t).alias("pii_type"), F.col(c).alias("value")) for c, t in typed.items()])
    rows = ppl.select("c_custkey", F.inline(cells))
    return rows.select("c_custkey", "pii_type", mask_by_type("value", "pii_type").alias("masked"))


def masking_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6 + M8: custom rules covering each strategy (and a custom mask
    character) over the person table."""
    ppl = standins.people(read_table(spark, sf_dir, "customer"))
    custom = {
        "NAME": masking_rule("NAME", "full_mask"),
        "SALARY": masking_rule("SALARY", "hash"),
        "EMAIL": masking_rule("EMAIL", "tokenize"),
        "PHONE": masking_rule("PHONE", "format_preserve", replacement_char="#"),
        "CREDIT_CARD": masking_rule("CREDIT_CARD", "format_preserve"),
        "ADDRESS": masking_rule("ADDRESS", "format_preserve", replacement_char="$"),
        "DATE_OF_BIRTH": masking_rule("DATE_OF_BIRTH", "partial_mask", show_first=2, show_last=4),
        "AGE": masking_rule("AGE", "redact"),
    }
    return _flat_contact(mask_table(ppl, custom_rules=custom))


QUERIES = {
    "content_findings": content_findings,
    "content_findings_pages": content_findings_pages,
    "conversation_findings": conversation_findings,
    "simple_findings": simple_findings,
    "head_byte_findings": head_byte_findings,
    "head_char_findings": head_char_findings,
    "object_findings": object_findings,
    "stored_object_findings": stored_object_findings,
    "finding_split": finding_split,
    "type_summary": type_summary,
    "source_table_types": source_table_types,
    "string_attribute_findings": string_attribute_findings,
    "column_content_profile": column_content_profile,
    "entity_merge": entity_merge,
    "column_name_findings": column_name_findings,
    "analyze_tables": analyze_tables,
    "column_tags": column_tags,
    "table_classes": table_classes,
    "catalog_round_trip": catalog_round_trip,
    "risk_breakdown": risk_breakdown,
    "source_classes": source_classes,
    "page_host_classes": page_host_classes,
    "page_host_kpis": page_host_kpis,
    "source_tag_table": source_tag_table,
    "discovery_kpis": discovery_kpis,
    "pii_type_counts": pii_type_counts,
    "tag_keys_used": tag_keys_used,
    "workflow_summary": workflow_summary,
    "tag_definitions": tag_definitions,
    "tag_upsert": tag_upsert,
    "stored_tag_upsert": stored_tag_upsert,
    "registry": registry,
    "registry_batch": registry_batch,
    "scan_totals": scan_totals,
    "committed_totals": committed_totals,
    "committed_findings": committed_findings,
    "event_attributes": event_attributes,
    "classification_summary": classification_summary,
    "source_summary": source_summary,
    "row_samples": row_samples,
    "table_stats": table_stats,
    "stored_table_stats": stored_table_stats,
    "masking_default": masking_default,
    "masked_values": masked_values,
    "masking_strategies": masking_strategies,
}
