"""First-n item samples, per table or per group, in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int, key_cols, group_cols=None) -> DataFrame:
    """First ``n`` rows by ``key_cols`` (per group of ``group_cols`` if given).

    Scan order is undefined in Spark, so a key is required. Ungrouped this
    plans as TakeOrderedAndProject (per-task top-n, then a merge of at most
    n rows per task); grouped, ``row_number() <= n`` plans a partial
    WindowGroupLimit before the shuffle, so a hot group sends at most n rows
    per task instead of all its rows.
    """
    if not key_cols:
        raise ValueError("sample_rows needs key columns: scan order is undefined")
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    if not group_cols:
        return df.orderBy(*keys).limit(n)
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    w = Window.partitionBy(*groups).orderBy(*keys)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
