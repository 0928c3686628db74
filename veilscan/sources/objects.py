"""Object (file) sources: inventory, text reads, table statistics, summary."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions import detect as D
from veilscan.session import local_frame

from .catalog import list_folder
from .windows import RANGED, hidden, listed_objects

# Content types of the suffixes that scans meet most; all else is a byte stream.
CONTENT_TYPES = {
    "txt": "text/plain", "csv": "text/csv", "json": "application/json", "html": "text/html", "xml": "text/xml",
    "md": "text/markdown", "log": "text/plain", "parquet": "application/vnd.apache.parquet", "gz": "application/gzip",
}
INVENTORY_SCHEMA = "path string, size_bytes long, modified timestamp, uri string, content_type string, etag string"


def _local_part(path_col):
    """A file URI without scheme and authority (``file:/a/b`` -> ``/a/b``)."""
    return F.regexp_replace(path_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")


def _strip_scheme(path: str) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path)


def object_inventory(spark: SparkSession, path: str, prefix: str = "", glob: str | None = None) -> DataFrame:
    """Files under ``path``: ``path, size_bytes, modified, uri, content_type, etag``.

    Only metadata is selected, so the binaryFile source does not read file
    contents (ReadSchema has no ``content``). ``prefix`` is a string prefix of
    the object key relative to ``path`` (object-store semantics): it is turned
    into a listing glob, so only the matching subtree is listed, and then
    checked exactly. ``path`` is plain and ``uri`` its encoded form, by which
    Spark's readers name the same file. ``content_type`` follows from the
    suffix; ``etag`` stands for the object's version (size and time). Spark's
    listing leaves out files of no bytes; ``all_objects`` has them.
    """
    root = path.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    load_path = f"{root}/{prefix}*" if prefix else root
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    version = F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    try:
        listed = reader.load(load_path)
    except AnalysisException:
        if not prefix:
            raise
        return spark.createDataFrame([], INVENTORY_SCHEMA)
    df = listed.select(
        F.col("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        F.col("_metadata.file_path").alias("uri"),
        F.coalesce(F.try_element_at(kinds, suffix), F.lit("application/octet-stream")).alias("content_type"),
        F.md5(version.cast("binary")).alias("etag"),
    )
    if prefix:
        df = df.where(_local_part(F.col("path")).startswith(_strip_scheme(root) + "/" + prefix))
    return df


def _with_kinds(listed: DataFrame) -> DataFrame:
    """An inventory of ``path, size_bytes, modified``."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    version = F.concat_ws("-", F.col("size_bytes").cast("string"), F.unix_micros("modified").cast("string"))
    return listed.select(
        "path", "size_bytes", "modified",
        F.coalesce(F.try_element_at(kinds, suffix), F.lit("application/octet-stream")).alias("content_type"),
        F.md5(version.cast("binary")).alias("etag"),
    )


def all_objects(spark: SparkSession, path: str, prefix: str = "", glob: str | None = None) -> DataFrame:
    """Every file under ``path``, those of no bytes too: ``path, size_bytes, modified, content_type, etag``.

    The driver lists what lies directly under the root; each folder there is
    listed in a task. ``prefix`` and ``glob`` are as in ``object_inventory``,
    which also lists roots that only Spark can read (without empty files).
    """
    if scheme_of(path) not in RANGED:
        return object_inventory(spark, path, prefix, glob).drop("uri")
    root = path.rstrip("/")
    top, _, rest = prefix.partition("/")
    entries = [(name, place) for name, place, _ in list_folder(spark, root) if name.startswith(top) and not hidden(name)]
    if "/" in prefix:
        entries = [e for e in entries if e[0] == top]
    found = listed_objects(spark, [place for _, place in entries])
    if prefix:
        found = found.where(_local_part(F.col("path")).startswith(_strip_scheme(root) + "/" + prefix))
    if glob:
        pattern = re.compile(fnmatch.translate(glob)).pattern.replace(r"\Z", r"\z")
        found = found.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike("^" + pattern))
    return _with_kinds(found)


def scheme_of(path: str) -> str:
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", path)
    return found[1].lower() if found else "file"


def object_texts(spark: SparkSession, path: str, prefix: str = "", glob: str | None = None) -> DataFrame:
    """The contents of all files under ``path`` as ``uri, text``, each one text, through the session's file systems.

    Files that cannot be read have no row. ``object_windows`` reads objects of any size.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    reader = reader.option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    load_path = f"{path.rstrip('/')}/{prefix}*" if prefix else path
    whole = reader.text(load_path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))


def object_flags(texts: DataFrame, profile: str | dict[str, str] = "content", key: str = "uri") -> DataFrame:
    """Per object (``key``): one flag per type of the profile that any of its texts holds.

    Bytes that are no UTF-8 are dropped before matching, as a lenient decode does."""
    patterns = D.profile_patterns(profile)
    text = F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(
        F.replace(F.make_valid_utf8("text"), F.lit("\ufffd"), F.lit(""))
    )
    rows = texts.select(key, text.alias("text"))
    digits = None
    if D.needs_digit_run(patterns):
        rows = rows.select("*", D.has_digit_run(F.col("text")).alias("__digits"))
        digits = F.col("__digits")
    hits = D.content_hits("text", profile, digits)
    flags = rows.select(key, *[h.alias(f"__hit_{i}") for i, (_, h) in enumerate(hits)])
    return flags.groupBy(key).agg(*[F.max(f"__hit_{i}").alias(f"__hit_{i}") for i in range(len(hits))])


def object_findings(
    inventory: DataFrame, texts: DataFrame, profile: str | dict[str, str] = "content", key: str = "uri", errors: DataFrame | None = None
) -> DataFrame:
    """Every object of ``inventory`` with its types and how its scan went.

    ``texts`` are whole contents or windows of them by ``key``; ``errors``
    (``key, error``) says what could not be read. Adds ``pii_types`` (NULL if
    the object could not be read), ``status`` (``scanned``, ``empty`` or
    ``unreadable``) and, with ``errors``, ``error``."""
    patterns = D.profile_patterns(profile)
    flags = object_flags(texts, profile, key)
    types = F.array_compact(F.array(*[F.when(F.col(f"__hit_{i}"), F.lit(t)) for i, t in enumerate(patterns)]))
    # a text without a value for a flag (NULL) holds nothing; a missing row was not read
    read = flags.select(key, F.lit(True).alias("__read"), types.alias("pii_types"))
    found = inventory.join(read, key, "left")
    none = F.array().cast("array<string>")
    empty = F.col("size_bytes") == 0
    whole = F.coalesce(F.col("__read"), F.lit(False))
    more = []
    if errors is not None:
        found = found.join(errors.groupBy(key).agg(F.max("error").alias("__error")), key, "left")
        # a window that owns no byte has no row, so an object with rows and no error was read whole
        whole = whole & F.col("__error").isNull()
        more = [F.col("__error").alias("error")]
    return found.select(
        *inventory.columns,
        F.when(whole | empty, F.coalesce("pii_types", none)).alias("pii_types"),
        F.when(empty, F.lit("empty")).when(whole, F.lit("scanned")).otherwise(F.lit("unreadable")).alias("status"),
        *more,
    )


def table_stats(df: DataFrame, table_name: str) -> DataFrame:
    """S3 of one file-backed DataFrame (see ``tables_stats``)."""
    return tables_stats({table_name: df})


def tables_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """S3 of file-backed DataFrames, one row per table: item_count, size_bytes
    (sum of the distinct input files' sizes) and the attributes' names and
    types. Rows of all tables are counted per file, then per table, in one
    aggregation; a table without rows has a row as well."""
    rows, listed = [], []
    for name, df in tables.items():
        rows.append(df.select(F.lit(name).alias("table_name"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")))
        listed.append((name, [(f.name, f.dataType.simpleString()) for f in df.schema.fields]))
    counted = reduce(lambda a, b: a.unionByName(b), rows).groupBy("table_name", "f")
    per_file = counted.agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"))
    sums = per_file.groupBy("table_name").agg(F.sum("n").alias("item_count"), F.sum("s").alias("size_bytes"))
    attributes = F.create_map(*[
        x
        for name, fields in listed
        for x in (F.lit(name), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("type")) for c, t in fields]))
    ])
    names = local_frame(next(iter(tables.values())).sparkSession, [(n,) for n, _ in listed], "table_name string")
    return names.join(sums, "table_name", "left").select(
        "table_name",
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        attributes[F.col("table_name")].alias("attributes"),
    )


def source_summary(objects: DataFrame | None, item_tables: DataFrame | None) -> DataFrame:
    """Counts of objects, item tables and their total, as one row."""
    parts = []
    if objects is not None:
        parts.append(objects.select(F.lit("object").alias("kind")))
    if item_tables is not None:
        parts.append(item_tables.select(F.lit("table").alias("kind")))
    if not parts:
        raise ValueError("source_summary needs objects or item tables")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(
        F.count_if(F.col("kind") == "object").cast("long").alias("objects"),
        F.count_if(F.col("kind") == "table").cast("long").alias("item_tables"),
        F.count(F.lit(1)).cast("long").alias("total_sources"),
    )
