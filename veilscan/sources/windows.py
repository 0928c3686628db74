"""Objects of any size in windows: byte ranges that can be matched one by one.

An object is cut into ranges of ``size`` bytes. Each range is moved to the next character that no
match begins with and no e-mail address holds (white space, ``/``, ASCII punctuation outside the
patterns, a CJK character), and reads on past its end by as many bytes as the longest numeric
match takes, to the next such character. So each match of a fixed pattern lies whole in the
window that owns its start, with its surroundings as they are in the object, and an object has
the same types at every size of its ranges.

Where no such character comes for long, the window goes on, and runs of ASCII letters or digits
are shortened to their ends: no fixed pattern tells longer runs apart. A gigabyte of one letter
is a window of a few bytes.

Tasks read ranges through Arrow's file systems (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .heads import open_store

#: bytes of one range
WINDOW_BYTES = 16 << 20
#: bytes of the longest match that crosses a cut: 16 digits and 3 separators of up to 4 bytes, with room
OVERLAP = 128
#: schemes that ranges are read from; objects elsewhere are read whole through Spark
RANGED = ("file", "s3", "s3a", "s3n", "gs", "gcs", "hdfs")

# (one class first, so that the search skips what is no cut quickly)
_CUT = re.compile(rb"[ \t\n\x0b\x0c\r/,;:\"'{}\[\]<>=&?!#$*\\~^`\xe3-\xe9](?:(?<=[\xe3-\xe9])[\x80-\xbf]{2}|(?<![\xe3-\xe9]))")
_CUT_BYTES = 3
_BLOCK = 1 << 20
#: longer runs are shortened to twice this; no pattern has as many digits or asks for as many letters
_RUN = 256
_LONG_RUNS = (
    re.compile(rb"([A-Za-z]{%d})[A-Za-z]+(?=[A-Za-z]{%d})" % (_RUN, _RUN)),
    re.compile(rb"([0-9]{%d})[0-9]+(?=[0-9]{%d})" % (_RUN, _RUN)),
)

LISTED = "path string, size_bytes bigint, modified timestamp"
WINDOW = "path string, at bigint, content binary, error string"


def _shortened(data: bytes) -> bytes:
    for runs in _LONG_RUNS:
        data = runs.sub(rb"\1", data)
    return data


class _Reader:
    """Bytes of an open file from a place on, in blocks, kept as far as they may matter."""

    def __init__(self, file, size: int, start: int) -> None:
        self.file, self.size, self.place, self.data = file, size, start, b""
        file.seek(start)

    def more(self) -> bool:
        block = self.file.read(min(_BLOCK, self.size - self.place)) if self.place < self.size else b""
        self.place += len(block)
        self.data += block
        return bool(block)


def window(file, size: int, at: int, length: int) -> bytes | None:
    """The window of the range that begins at ``at``; None if it owns no byte of the object."""
    reader = _Reader(file, size, at)
    last = at + length >= size
    if at:
        # the first cut in this range, if any (a cut at its very end belongs to the next one)
        first, looked = None, 0
        while first is None:
            found = _CUT.search(reader.data, looked)
            if found and at + found.start() < at + length:
                first = found.start()
            elif found or at + looked >= at + length or not reader.more():
                return None
            else:
                looked = max(0, len(reader.data) - _BLOCK - _CUT_BYTES)
        reader.data, at, length = reader.data[first:], at + first, length - first
    if last:
        while reader.more():
            if len(reader.data) > 2 * length:
                reader.data = _shortened(reader.data)
        return reader.data
    while len(reader.data) < length and reader.more():
        pass
    parts, reader.data = [reader.data[:length]], reader.data[length:]
    found = _next_cut(reader)
    if found:
        # behind the start of the next range: the overlap, then up to another cut
        past = found.start() + OVERLAP
        while len(reader.data) < past and reader.more():
            pass
        parts.append(reader.data[:past])
        reader.data = reader.data[past:]
        found = _next_cut(reader)
    return b"".join([*parts, reader.data[: found.end()] if found else reader.data])


def _next_cut(reader: _Reader) -> re.Match | None:
    """The first cut in what the reader holds or reads; None at the end of the object."""
    looked, shortened = 0, 0
    while True:
        found = _CUT.search(reader.data, looked)
        if found:
            return found
        looked = max(0, len(reader.data) - _CUT_BYTES)
        if not reader.more():
            return None
        if len(reader.data) - shortened > 4 * _BLOCK:
            # no cut so far, so nothing but its length depends on a place in it
            reader.data, looked = _shortened(reader.data), 0
            shortened = len(reader.data)


def _windows(length: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, at in zip(*(batch.column(c).to_pylist() for c in ("path", "size_bytes", "at")), strict=True):
                content = error = None
                try:
                    store, place = open_store(path)
                    with store.open_input_file(place) as file:
                        content = window(file, size, at, length)
                except Exception as e:  # noqa: BLE001 - recorded per range
                    error = f"{type(e).__name__}: {e}"
                if content is not None or error:
                    yield pa.RecordBatch.from_pylist(
                        [{"path": path, "at": at, "content": content, "error": error}],
                        pa.schema([("path", pa.string()), ("at", pa.int64()), ("content", pa.binary()), ("error", pa.string())]),
                    )

    return read


def object_windows(inventory: DataFrame, length: int = WINDOW_BYTES) -> DataFrame:
    """Windows of the objects of an inventory (path, size_bytes): ``path, at, content, error``.

    Ranges are dealt to tasks by path and place, about 64 MB each. An object that cannot be read
    has rows with an error; one of no bytes has no row.
    """
    from veilscan.session import ship_package

    spark = inventory.sparkSession
    ship_package(spark)
    total = inventory.agg(F.sum("size_bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(total["b"] or 0) // (64 << 20)), -(-total["n"] // 10000))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size_bytes") - 1, F.lit(length).cast("bigint"))
    ranges = inventory.where("size_bytes > 0").select("path", "size_bytes", F.explode(starts).alias("at"))
    return ranges.repartition(parts, "path", "at").mapInArrow(_windows(length), WINDOW)


def hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as pafs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, place = open_store(path)
            (info,) = store.get_file_info([place])
            found = [info]
            if info.type == pafs.FileType.Directory:
                found = store.get_file_info(pafs.FileSelector(place, recursive=True, allow_not_found=True))
            rows = [
                {"path": path + f.path[len(place) :], "size_bytes": f.size, "modified": f.mtime}
                for f in found
                if f.type == pafs.FileType.File and not any(hidden(part) for part in f.path[len(place) :].split("/"))
            ]
            for k in range(0, len(rows), 10000):
                yield pa.RecordBatch.from_pylist(
                    rows[k : k + 10000], pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])
                )


def listed_objects(spark: SparkSession, entries: list[str]) -> DataFrame:
    """Files at and below the given paths, those of no bytes too: ``path, size_bytes, modified``.

    Each path is listed in a task of its own, so give the folders under a root and not the root.
    Names that begin with ``_`` or ``.`` are left out as Spark's own listings do.
    """
    from veilscan.session import local_frame, ship_package

    ship_package(spark)
    rows = local_frame(spark, [(e,) for e in entries], "path string").repartition(max(1, min(len(entries), 1000)), "path")
    return rows.mapInArrow(_listing, LISTED)
