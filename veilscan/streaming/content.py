"""The stateless detectors and masks on Structured Streaming.

Content detection, classification and masking are per-row expressions, so
the same operators plan on a ``readStream`` DataFrame unchanged; no state
store is involved. Sinks checkpoint under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster) unless a location is
given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veilscan.functions import classify as C
from veilscan.operators import findings as FD
from veilscan.operators.masking import mask_table
from veilscan.session import ensure_checkpoint_dir


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int | None = None):
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_findings(stream: DataFrame, id_cols, text_col: str, profile="content") -> DataFrame:
    """Findings of each arriving row: ids, types (comma-joined), class, access."""
    f = FD.content_findings(stream, id_cols, text_col, profile=profile)
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return f.select(*ids, C.types_string("pii_types").alias("pii_types"), "data_classification", "access_level")


def stream_masked(stream: DataFrame, column_types=None, custom_rules=None) -> DataFrame:
    """Each arriving row with its PII columns masked."""
    return mask_table(stream, column_types=column_types, custom_rules=custom_rules)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """The checkpoint of the stream called ``name``: the same one after a restart."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def start_to_parquet(
    df: DataFrame, path: str, name: str, checkpoint: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Append the stream to parquet at ``path`` (exactly-once via the
    checkpoint, which a stream of the same name goes on from). ``available_now`` processes what is there and stops."""
    w = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or checkpoint_location(df.sparkSession, name))
        .outputMode("append")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
