"""K1: persist reports and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Write ``df`` (a report or a findings table) to ``path`` in ``fmt``, as its tasks have it."""
    df.write.mode(mode).format(fmt).save(path)
    return path


def write_findings(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path
