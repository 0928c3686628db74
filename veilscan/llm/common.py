"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.session import ensure_checkpoint_dir, read_table

#: rows that equal one another in everything an operator looks at are carried as one row with a
#: count and spelled out again in pieces of this many, so that no task spells out a hot row alone
PIECE_ROWS = 8192


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder of ``spark.checkpoint.dir`` and read it again.

    This cuts lineage so that a lost executor costs a re-read of the table and not the whole job.
    Each call has a folder of its own below ``veilscan-llm``; the folder's owner clears it like
    any other checkpoint data once the results are written.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/veilscan-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash32(text: Column, first: int) -> Column:
    """Eight hex digits of ``md5(text)`` from digit ``first`` on, as a number of 32 bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 8), 16, 10).cast("bigint")


def pieces(rows: DataFrame, count: str, piece: str, piece_rows: str, size: int = PIECE_ROWS) -> DataFrame:
    """One row for each ``size`` of the ``count`` equal rows that a row stands for."""
    return rows.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, F.lit(size).cast("bigint")))).withColumn(
        piece_rows, F.least(F.col(count) - F.col(piece), F.lit(size).cast("bigint"))
    )


def unused(columns: list[str], *names: str) -> list[str]:
    """Each of ``names``, with underscores before it until no column is called that."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
