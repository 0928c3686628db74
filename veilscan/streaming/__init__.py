"""Structured Streaming entry points for the stateless detectors and masks."""

from veilscan.streaming.content import (  # noqa: F401
    read_parquet_stream,
    start_to_parquet,
    stream_findings,
    stream_masked,
)
