"""C8 for a registry far larger than the batch that is registered.

A join of the two would shuffle the whole registry for each batch. Here the
batch is first put into a Bloom filter (bitmaps built by partial aggregation),
the registry's rows are tested against it where they are read, and only the
few that pass meet the batch in a shuffle. The filter has a fixed size, so it
can be broadcast whatever the batch; a batch too large for it lets more rows
pass, and the result is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 15  # of one bitmap, as Spark's bitmap aggregate has them
BITMAPS = 1 << 12  # 16 MB in all
PROBES = 3


def _probes(resource: Column, bitmaps: int) -> tuple[Column, list[Column]]:
    """The bitmap of a resource and its bits there."""
    where = F.pmod(F.xxhash64(resource), F.lit(bitmaps)).cast("int")
    bits = [F.pmod(F.xxhash64(F.lit(k), resource), F.lit(BITS)).cast("int") for k in range(1, PROBES + 1)]
    return where, bits


def batch_filter(batch: DataFrame, col: str = "resource", bitmaps: int = BITMAPS) -> DataFrame:
    """bitmap_no, bitmap: a Bloom filter of ``batch[col]``, of ``bitmaps`` rows of 4 KB at most."""
    where, bits = _probes(F.col(col), bitmaps)
    rows = batch.where(F.col(col).isNotNull()).select(where.alias("bitmap_no"), F.explode(F.array(*bits)).alias("bit"))
    return rows.groupBy("bitmap_no").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap"))


def may_hold(registry: DataFrame, filter_of_batch: DataFrame, col: str = "resource", bitmaps: int = BITMAPS) -> DataFrame:
    """The registry's resources that the filter lets pass: all that the batch has, and few others."""
    where, bits = _probes(F.col(col), bitmaps)
    rows = registry.select(F.col(col)).where(F.col(col).isNotNull())
    joined = rows.join(F.broadcast(filter_of_batch), where == F.col("bitmap_no"))

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1

    return joined.where(reduce(lambda a, b: a & b, [is_set(b) for b in bits])).select(col)


def register_batch(registry: DataFrame, batch: DataFrame, col: str = "resource", bitmaps: int = BITMAPS) -> DataFrame:
    """Every resource of ``batch`` once, ``registered`` if it is new or ``already_registered``.

    The registry's other resources are not returned. Nulls are no resources; repeated ones on
    either side are combined before they are shuffled."""
    known = may_hold(registry, batch_filter(batch, col, bitmaps), col, bitmaps).select(col, F.lit(False).alias("asked"), F.lit(True).alias("known"))
    asked = batch.select(F.col(col)).where(F.col(col).isNotNull()).select(col, F.lit(True).alias("asked"), F.lit(False).alias("known"))
    both = asked.unionByName(known).groupBy(col).agg(F.max("asked").alias("asked"), F.max("known").alias("known"))
    status = F.when(F.col("known"), F.lit("already_registered")).otherwise(F.lit("registered"))
    return both.where("asked").select(col, status.alias("status"))
