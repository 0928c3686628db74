"""K1 with a commit, and R1 counted while findings are written.

A report has several parts. Overwriting them one by one leaves a mixture if
the run dies in between. Here a run writes its parts below a folder of its
own and then appends one row to the report's manifest; readers follow the
manifest, so they see all parts of a run or none, and the last committed run
stays readable whatever happens to the next.

    <path>/runs/<run id>/<part>/...     Parquet
    <path>/manifest/...                 Parquet, one row per committed run

Rows and other numbers of a part are counted by the job that writes it
(``Observation``), and are kept in the manifest: totals of a report need no
second pass over it.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "run_id string, committed_at timestamp, parts map<string,map<string,bigint>>"
ROWS = "rows"


def write_part(df: DataFrame, path: str, counters: dict[str, Column] | None = None) -> dict[str, int]:
    """Write ``df`` and return ``rows`` and the ``counters`` (aggregates) of what was written.

    The numbers come from the tasks whose output was taken: a task that is tried again, or run
    twice by speculation, counts once. A counter over no row is 0."""
    seen = Observation()
    wanted = {ROWS: F.count(F.lit(1)), **(counters or {})}
    df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in wanted.items()]).write.parquet(path)
    return {n: int(seen.get.get(n) or 0) for n in wanted}


def commit_report(
    spark: SparkSession,
    path: str,
    parts: dict[str, DataFrame],
    counters: dict[str, dict[str, Column]] | None = None,
    run_id: str | None = None,
) -> dict[str, dict[str, int]]:
    """Write all ``parts`` as one run of the report at ``path`` and commit it; the numbers of each part.

    Nothing that an earlier run wrote is touched. A run id is used once: the same one again is an
    error of the write. The manifest's row is one file, put in place at the end of its job."""
    run_id = run_id or uuid.uuid4().hex
    numbers = {
        name: write_part(df, f"{path}/runs/{run_id}/{name}", (counters or {}).get(name)) for name, df in parts.items()
    }
    row = spark.createDataFrame([(run_id, datetime.now(timezone.utc), numbers)], MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return numbers


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: run_id, committed_at, parts. No row where nothing was committed."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def last_run(spark: SparkSession, path: str, run_id: str | None = None):
    """The manifest's row of the run committed last (of one time the greater id), or of ``run_id``."""
    runs = committed_runs(spark, path)
    if run_id is not None:
        runs = runs.where(F.col("run_id") == run_id)
    row = runs.orderBy(F.desc("committed_at"), F.desc("run_id")).first()
    if row is None:
        raise LookupError(f"no committed run {run_id or ''} below {path}")
    return row


def read_report(spark: SparkSession, path: str, part: str, run_id: str | None = None) -> DataFrame:
    """A part of the run committed last (or of ``run_id``)."""
    row = last_run(spark, path, run_id)
    if part not in row["parts"]:
        raise LookupError(f"run {row['run_id']} below {path} has no part {part!r}")
    return spark.read.parquet(f"{path}/runs/{row['run_id']}/{part}")
