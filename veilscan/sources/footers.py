"""S1 + S3 from Parquet footers: how many rows have a value in each column, without reading a data page.

The counts are aggregates that Spark's Parquet reader answers in the scan's tasks from the row
and null counts of the column chunks (``spark.sql.parquet.aggregatePushdown``); Spark sums what
the files say. Empty columns and tables without rows keep their columns, with 0 rows.

Footers count values, not lists or structs, so a nested column is counted by a scan of that
column alone, and a table with a struct, map or deeper nesting by a scan of its columns (their
chunks do not stand at the columns' places).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType, VariantType

from .catalog import _quoted as quoted

STATISTICS = "table_name, column_name, column_type, ordinal, rows, table_rows"
_NESTED = (ArrayType, MapType, StructType, VariantType)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet counts are answered by footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def _one_chunk(kind: DataType) -> bool:
    """Does a column of this type have one chunk in each row group?"""
    return not isinstance(kind, _NESTED) or isinstance(kind, ArrayType) and not isinstance(kind.elementType, _NESTED)


def _counted(df: DataFrame, fields: list[StructField], name: str) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(F.col(quoted(f.name))).alias(f"c{i}") for i, f in enumerate(fields)])
    # without rows there is nothing to sum, though Spark takes a count for never null
    known = lambda c: F.greatest(F.col(c), F.lit(0).cast("long"))
    return counts.select(F.lit(name).alias("table_name"), known("all").alias("all"), F.map_from_arrays(
        F.array(*[F.lit(f.name) for f in fields]), F.array(*[known(f"c{i}") for i in range(len(fields))])
    ).alias("counts"))


def column_statistics(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Columns of the Parquet tables at the given paths with the rows that have a value there:
    ``table_name, column_name, column_type, ordinal, rows, table_rows``."""
    footers = footer_session(spark)
    parts = []
    for name, path in tables.items():
        df = footers.read.parquet(path)
        fields = df.schema.fields
        by_footer = [f for f in fields if not isinstance(f.dataType, _NESTED)] if all(_one_chunk(f.dataType) for f in fields) else []
        by_scan = [f for f in fields if f not in by_footer]
        counted = _counted(df, by_footer, name) if by_footer else None
        if by_scan:
            scanned = _counted(spark.read.schema(df.schema).parquet(path), by_scan, name)
            both = scanned if counted is None else counted.unionByName(scanned)
            merged = F.aggregate(F.collect_list("counts"), F.create_map().cast("map<string,bigint>"), lambda a, b: F.map_concat(a, b))
            counted = both.groupBy("table_name").agg(F.max("all").alias("all"), merged.alias("counts"))
        entries = F.array(*[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"),
                     F.lit(i).cast("long").alias("ordinal"))
            for i, f in enumerate(fields)
        ])
        parts.append(counted.select("table_name", "counts", F.col("all").alias("table_rows"), F.inline(entries)))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.select(
        "table_name", "column_name", "column_type", "ordinal", F.col("counts")[F.col("column_name")].alias("rows"), "table_rows"
    )
