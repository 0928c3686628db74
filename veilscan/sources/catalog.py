"""S1 catalog columns and S7 source registration on Spark's catalog."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilscan import rules
from veilscan.session import local_frame

CATALOG_SCHEMA = StructType(
    [
        StructField("database", StringType()),
        StructField("table_name", StringType()),
        StructField("location", StringType()),
        StructField("column_name", StringType()),
        StructField("column_type", StringType()),
        StructField("ordinal", LongType()),
    ]
)

TABLES_SCHEMA = "database string, table_name string, location string, status string, error string"

REGISTRATION_SCHEMA = StructType(
    [
        StructField("type", StringType()),
        StructField("name", StringType()),
        StructField("status", StringType()),
        StructField("database", StringType()),
        StructField("table_name", StringType()),
        StructField("location", StringType()),
        StructField("error", StringType()),
    ]
)


def catalog_columns_from_frames(
    spark: SparkSession, tables: dict[str, DataFrame], database: str = "default", locations: dict | None = None
) -> DataFrame:
    """One row per (table, column) of the given DataFrames' schemas.

    Only schema metadata passes through the driver: its size is the number
    of columns, not rows.
    """
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            rows.append((database, name, (locations or {}).get(name), f.name, f.dataType.simpleString(), i))
    return local_frame(spark, rows, CATALOG_SCHEMA)


def _message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def catalog_tables(spark: SparkSession, databases: list[str] | None = None, parallelism: int = 8) -> DataFrame:
    """Every table of the listed databases (all if None) with its location and
    status: ``cataloged``, or ``error`` with the message for a table whose
    schema cannot be resolved and (without a table name) for a database that
    cannot be listed. Lookups run ``parallelism`` at a time; what passes
    through the driver is catalog metadata."""
    tables, _ = _read_catalog(spark, databases, parallelism)
    return local_frame(spark, tables, TABLES_SCHEMA)


def catalog_columns(
    spark: SparkSession, databases: list[str] | None = None, with_location: bool = False, parallelism: int = 8
) -> DataFrame:
    """Columns of every readable table in the listed databases (all if None);
    ``catalog_tables`` reports the ones that are not. ``with_location`` adds
    each table's storage location."""
    _, columns = _read_catalog(spark, databases, parallelism, with_location)
    return local_frame(spark, columns, CATALOG_SCHEMA)


def read_catalog(spark: SparkSession, databases: list[str] | None = None, parallelism: int = 8) -> tuple[DataFrame, DataFrame]:
    """``catalog_tables`` and ``catalog_columns`` with locations, from one walk of the catalog."""
    tables, columns = _read_catalog(spark, databases, parallelism)
    return local_frame(spark, tables, TABLES_SCHEMA), local_frame(spark, columns, CATALOG_SCHEMA)


def _read_catalog(spark, databases, parallelism: int, with_location: bool = True) -> tuple[list[tuple], list[tuple]]:
    from concurrent.futures import ThreadPoolExecutor

    cat = spark.catalog
    tables: list[tuple] = []
    found: list[tuple[str, str]] = []
    for db in databases if databases is not None else [d.name for d in cat.listDatabases()]:
        try:
            found += [(db, t.name) for t in cat.listTables(_quoted(db)) if not t.isTemporary]
        except Exception as e:  # noqa: BLE001 - reported in the table list
            tables.append((db, None, None, rules.CATALOG_ERROR, _message(e)))

    def read(name: tuple[str, str]):
        db, table = name
        try:
            columns = cat.listColumns(f"{_quoted(db)}.{_quoted(table)}")
            location = _table_location(spark, db, table) if with_location else None
            rows = [(db, table, location, c.name, c.dataType, i) for i, c in enumerate(columns)]
            return (db, table, location, rules.CATALOGED, None), rows
        except Exception as e:  # noqa: BLE001 - reported in the table list
            return (db, table, None, rules.CATALOG_ERROR, _message(e)), []

    columns: list[tuple] = []
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for table, rows in pool.map(read, found):
            tables.append(table)
            columns += rows
    return tables, columns


def catalog_partitions(spark: SparkSession, databases: list[str], parallelism: int = 8) -> DataFrame:
    """Partitions that the catalog knows of the partitioned tables of the listed databases:
    ``database, table_name, partition`` (as ``k=v/...``)."""
    from concurrent.futures import ThreadPoolExecutor

    names = [(db, t.name) for db in databases for t in spark.catalog.listTables(_quoted(db)) if not t.isTemporary]

    def read(name: tuple[str, str]) -> list[tuple]:
        full = ".".join(_quoted(part) for part in name)
        if not any(c.isPartition for c in spark.catalog.listColumns(full)):
            return []
        return [(*name, r["partition"]) for r in spark.sql(f"SHOW PARTITIONS {full}").collect()]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = [row for part in pool.map(read, names) for row in part]
    return local_frame(spark, rows, "database string, table_name string, partition string")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _table_location(spark: SparkSession, db: str, table: str) -> str | None:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(db)}.{_quoted(table)}")
    row = described.where("col_name = 'Location'").first()
    return row["data_type"] if row else None


def _ident(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def file_database_name(source_name: str) -> str:
    return _ident(source_name) + rules.FILE_DATABASE_SUFFIX


def register_sources(
    spark: SparkSession,
    file_sources: dict[str, str] | None = None,
    item_sources: dict[str, str] | None = None,
    fmt: str = "parquet",
    parallelism: int = 8,
) -> DataFrame:
    """Register each source as an external table on its path.

    File sources get a database ``<name>_db`` and a table named after the
    source (both with ``_`` for what is no letter or digit); item tables share
    one database. Status is ``cataloged`` or ``error`` with the message; one
    failure does not stop the rest. Nothing is ever dropped or replaced: a
    source whose table exists is cataloged if that table lies on the same path
    and an error otherwise, and sources that would share one table name are
    all errors but the first. Schemas are inferred by the data source
    (footer/metadata reads); independent sources are registered
    ``parallelism`` at a time. The partitions of a partitioned source are taken
    into the catalog, those added since an earlier registration too. Rows keep
    the input order.
    """
    from concurrent.futures import ThreadPoolExecutor

    def register(kind: str, name: str, path: str, db: str, first: str):
        table = _ident(name)
        full = f"{_quoted(db)}.{_quoted(table)}"
        try:
            if first != name:
                raise ValueError(f"table {full} belongs to source {first!r}")
            spark.read.format(fmt).load(path).schema  # infer; raises on a bad path
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(db)}")
            if spark.catalog.tableExists(full):
                there = _table_location(spark, db, table)
                if _place(spark, there) != _place(spark, path):
                    raise ValueError(f"table {full} exists on {there}")
            else:
                spark.catalog.createTable(full, path=path, source=fmt)
            if any(c.isPartition for c in spark.catalog.listColumns(full)):
                spark.catalog.recoverPartitions(full)
            return (kind, name, rules.CATALOGED, db, table, path, None)
        except Exception as e:  # noqa: BLE001 - recorded per source
            return (kind, name, rules.CATALOG_ERROR, db, table, path, _message(e))

    todo = [("file", n, p, file_database_name(n)) for n, p in (file_sources or {}).items()]
    todo += [("table", n, p, rules.ITEM_TABLE_DATABASE) for n, p in (item_sources or {}).items()]
    firsts: dict[tuple[str, str], str] = {}
    for _, name, _, db in todo:
        firsts.setdefault((db.lower(), _ident(name).lower()), name)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(lambda t: register(*t, firsts[t[3].lower(), _ident(t[1]).lower()]), todo))
    return local_frame(spark, results, REGISTRATION_SCHEMA)


def _place(spark: SparkSession, path: str | None) -> str | None:
    """A path as its file system names it."""
    if path is None:
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString().rstrip("/")


def list_folder(spark: SparkSession, root: str) -> list[tuple[str, str, bool]]:
    """Name, path and whether it is a folder, of what lies directly under ``root``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((st.getPath().getName(), st.getPath().toString(), st.isDirectory()) for st in fs.listStatus(path))


SOURCES_SCHEMA = StructType(
    [StructField("type", StringType()), StructField("name", StringType()), StructField("path", StringType())]
)


def discover_sources(spark: SparkSession, roots=(), databases: list[str] | None = None) -> DataFrame:
    """Data sources by name: each immediate sub-folder of each root is a file
    source (``type='file'``, like a bucket), each table of the listed catalog
    databases an item source (``type='table'``). Only folder and table names
    are listed (one listing call per root), never the files inside."""
    rows = []
    for root in roots:
        rows += [("file", name, path) for name, path, folder in list_folder(spark, root) if folder]
    for db in databases or []:
        for t in spark.catalog.listTables(_quoted(db)):
            if not t.isTemporary:
                rows.append(("table", t.name, f"{db}.{t.name}"))
    return local_frame(spark, sorted(rows), SOURCES_SCHEMA)
