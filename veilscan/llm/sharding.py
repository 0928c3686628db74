"""Sharding by jump consistent hashing (native).

A key's shard follows from the key and the number of shards alone; there is no ring table. One
more shard takes rows only into itself: the jump sequence of a key does not depend on the number
of shards, the last jump below that number names the shard, and the next jump tells whether an
appended shard takes the key.

Nulls, ties and repeats: a null key hashes as the empty text; rows with equal keys share a
shard; repeated rows all get slots of their own. An empty table gives no rows. Other columns of
the input, whatever their names, are not read by :func:`shard_slots`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash32, let, pieces

# Fixed values of jump consistent hashing: the multiplier 2862933555777941757 of its 64-bit
# generator, in limbs of 16 bits from the lowest, and 2^31.
_LIMBS = (0xB0FD, 0x87B0, 0x2EE6, 0x27BB)
_TWO_31 = 2147483648.0

_LOW16, _LOW32 = 0xFFFF, 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def jump_state(key: Column, shards: int) -> Column:
    """struct(shard, next): the last jump below ``shards`` and the first one that is not.

    ``key`` is hashed with md5 first, so that consecutive ids are independent. The generator's
    64-bit product is kept in two halves of 32 bits: long arithmetic would overflow.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(key.cast("string"), F.lit(""))
    start = F.struct(
        hash32(text, 1).alias("hi"),
        hash32(text, 9).alias("lo"),
        _long(-1).alias("shard"),
        _long(0).alias("next"),
    )

    def halves(s: Column, p1: Column, low: Column) -> Column:
        p3 = s["lo"] * _LIMBS[3] + s["hi"] * _LIMBS[1]
        high = (
            F.shiftright(low, 32)
            + F.shiftright(p1, 16)
            + s["lo"] * _LIMBS[2]
            + s["hi"] * _LIMBS[0]
            + F.shiftleft(p3.bitwiseAND(_long(_LOW16)), 16)
        ).bitwiseAND(_long(_LOW32))
        return let(
            high,
            lambda hi: F.struct(
                hi.alias("hi"),
                low.bitwiseAND(_long(_LOW32)).alias("lo"),
                s["next"].alias("shard"),
                F.floor((s["next"] + 1) * (F.lit(_TWO_31) / (F.shiftright(hi, 1) + 1))).cast("bigint").alias("next"),
            ),
        )

    def jump(s: Column) -> Column:
        return let(
            s["lo"] * _LIMBS[1],
            lambda p1: let(
                s["lo"] * _LIMBS[0] + F.shiftleft(p1.bitwiseAND(_long(_LOW16)), 16) + 1, lambda low: halves(s, p1, low)
            ),
        )

    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)),
        start,
        lambda s, _: F.when(s["next"] < shards, jump(s)).otherwise(s),
    )
    return F.struct(end["shard"].cast("int").alias("shard"), end["next"].alias("next"))


def shard_of(key: Column, shards: int) -> Column:
    """The shard, from 0 to ``shards - 1``, of ``key``."""
    return jump_state(key, shards)["shard"]


def with_shard(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """``df`` with the shard of ``key`` in column ``out`` (replaced if ``df`` has one)."""
    return df.withColumn(out, shard_of(F.col(key), shards))


def shard_slots(rows: DataFrame, key: str, shards: int, buckets: int = 1024) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Returns the columns of ``rows`` (all of them take part in the order, so pass narrow rows)
    with shard, grown_shard (the shard after one more is appended) and slot. Slots follow the
    md5 of the key and of the repeat's piece, cut to ``buckets``, then the columns. Each bucket of
    each shard is numbered on its own; only the ``shards * buckets`` totals are summed up across
    buckets. Equal rows are counted before they are shuffled and numbered as one.
    """
    names = rows.columns
    counted = (
        rows.withColumn("__state", jump_state(F.col(key), shards))
        .groupBy(*names, "__state")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cut = (
        pieces(counted, "__n", "__piece", "__rows")
        .withColumn("__shard", F.col("__state.shard"))
        .withColumn(
            "__bucket",
            hash32(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__piece")), 1) % buckets,
        )
    )
    totals = cut.groupBy("__shard", "__bucket").agg(F.sum("__rows").alias("__total"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "__shard", "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base")
    )
    within = (
        Window.partitionBy("__shard", "__bucket")
        .orderBy(*names, "__piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = cut.withColumn("__within", F.coalesce(F.sum("__rows").over(within), F.lit(0))).join(
        bases, ["__shard", "__bucket"]
    )
    offset = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__rows") - 1)).alias("__offset")
    return placed.select(*names, "__state", "__base", "__within", offset).select(
        *names,
        F.col("__state.shard").alias("shard"),
        F.when(F.col("__state.next") == shards, F.lit(shards)).otherwise(F.col("__state.shard")).alias("grown_shard"),
        (F.col("__base") + F.col("__within") + F.col("__offset")).alias("slot"),
    )
