"""Mixing sources to target weights by pivotal dependent rounding (native).

Sources in order of their names (by code point, null last) weigh 5, 2, 1, 5, 2, 1, ... and share
the sum of all sizes; a target stops at ``most`` times its source's size and the excess goes to
the other sources by weight until none is above. A document of a source is to be taken
``target / source size`` times: its whole part surely, its fraction by rounding.

Rounding is dependent: within a source the fractions are paired off. In each pair, size times
fraction is moved from one document to the other until one of the two fractions is 0 or 1; the
direction is drawn so that no document's expected number of copies changes, and the sum of size
times fraction never changes. Groups pair their documents in the order of falling size, so that
long ones settle among themselves. What is left of a group's last pair, one document, goes up a
tree: groups of about ``fan_in`` documents of one source, then groups of what those left, until
one document is left in each source, which goes to the nearer side. A source's taken words so
miss its target by half the size of that one document at most.

All draws are hashes of the ids, so reruns agree. No group is larger than its hash makes it
(about ``fan_in``): documents that are equal in id, source and size are told apart by a running
number. Sizes of 0 take no part; a null source is a source; a null text has size 0. An empty
table gives no rows. The sources themselves (one row each) are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, pieces, staged, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    rows: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0
) -> DataFrame:
    """One row for each source: ``source``, source_size, documents, target."""
    per = rows.groupBy(source).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("documents"))
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = per.withColumn("weight", weight.cast("double")).withColumn("top", F.col("source_size") * F.lit(most))
    # A source is full below some level of target / weight, so sources fill in the order of top / weight.
    fill = Window.orderBy(F.col("top") / F.col("weight"), F.col(source).asc_nulls_last())
    every = Window.partitionBy()
    level = (
        ranked.withColumn("full", F.coalesce(F.sum("top").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("top"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("top") / F.col("weight"), F.col("level")))).over(every)["level"])
    )
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("top")), F.col("top"))
    return level.select(source, "source_size", "documents", target.alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40).cast("bigint")) / F.lit(float(1 << 40))


def _pair_off(items: Column, seed: int) -> Column:
    """struct(left, settled): fold an array of struct(draw, row, size, mass) pair by pair."""

    def moved(a: Column, x: Column, rise: Column, by: Column, a_done: Column) -> Column:
        change = F.when(rise, by).otherwise(-by)
        stays = {name: F.when(a_done, x[name]).otherwise(a[name]) for name in ("draw", "row", "size")}
        mass = F.when(a_done, x["mass"] - change).otherwise(a["mass"] + change)
        # the one that is done ends full if it took mass and empty if it gave it
        return F.struct(
            F.struct(*(value.alias(name) for name, value in stays.items()), mass.alias("mass")).alias("left"),
            F.struct(F.when(a_done, a["row"]).otherwise(x["row"]).alias("row"), (rise == a_done).alias("up")).alias("done"),
        )

    def drawn(a: Column, x: Column, up: Column, down: Column) -> Column:
        rise = (up + down == 0) | (_unit(a["draw"], x["draw"], F.lit(seed)) * (up + down) < down)
        return let(
            F.struct(rise.alias("rise"), F.when(rise, up).otherwise(down).alias("by")),
            # whichever of the two limits was smaller names the document that became integral
            lambda d: moved(a, x, d["rise"], d["by"], d["by"] == F.when(d["rise"], a["size"] - a["mass"]).otherwise(a["mass"])),
        )

    def pair(state: Column, x: Column) -> Column:
        a = state["left"]
        limits = F.struct(
            F.least(a["size"] - a["mass"], x["mass"]).alias("up"), F.least(a["mass"], x["size"] - x["mass"]).alias("down")
        )
        after = let(limits, lambda m: drawn(a, x, m["up"], m["down"]))
        return let(
            after,
            lambda s: F.struct(s["left"].alias("left"), F.concat(state["settled"], F.array(s["done"])).alias("settled")),
        )

    first = F.element_at(items, 1)
    first = F.struct(*(first[name].alias(name) for name in ("draw", "row", "size", "mass")))
    none = F.slice(F.transform(items, lambda x: F.struct(x["row"].alias("row"), F.lit(False).alias("up"))), 1, 0)
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(first.alias("left"), none.alias("settled")), pair)


def mix(
    rows: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[int, ...] = WEIGHTS,
    most: float = 3.0,
    fan_in: int = 64,
    seed: int = 17,
) -> DataFrame:
    """One row for each row of ``rows`` (``id_col``, ``source``, ``size``): those and repeat (the
    running number among rows that are equal in them), source_size, target and copies (0 to ``most``)."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    targets = staged(source_targets(rows, "source", "size", weights, most), "mix-targets")
    largest = targets.agg(F.coalesce(F.max("documents"), F.lit(0)).alias("n")).first()["n"]
    counted = rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    told_apart = pieces(counted, "n", "piece", "piece_rows").select(
        "id", "source", "size", F.explode(F.sequence(F.col("piece"), F.col("piece") + F.col("piece_rows") - 1)).alias("repeat")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    row = F.struct("id", "source", "size", "repeat", "source_size", "target", "whole")
    told_apart = told_apart.withColumnRenamed("source", "s")
    # the targets are one row a source: planned by Spark, broadcast only if found small
    begun = (
        told_apart.join(targets.drop("documents"), F.col("s").eqNullSafe(F.col("source")))
        .withColumn("whole", F.floor(ratio).cast("int"))
        .withColumn("mass", (ratio - F.floor(ratio)) * F.col("size"))
        .withColumn("row", row)
        .withColumn("draw", F.xxhash64("id", "size", "repeat", F.lit(seed)))
        .select("source", "draw", "row", F.col("size").cast("double").alias("size"), "mass")
    )
    settled = begun.where("size = 0").select("row", F.lit(False).alias("up"))
    level, left, parts, groups = 0, begun.where("size > 0"), [settled], int(largest)
    while True:
        groups = -(-groups // fan_in)
        items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "draw", "row", "size", "mass")))
        folded = (
            left.withColumn("group", F.pmod(F.xxhash64("draw", F.lit(level)), F.lit(max(1, groups))))
            .groupBy("source", "group")
            .agg(items.alias("items"))
            .select("source", _pair_off(F.col("items"), seed + level).alias("state"))
        )
        folded = staged(folded.select("source", "state.left", "state.settled"), f"mix-level{level}")
        parts.append(folded.select(F.explode("settled").alias("done")).select("done.row", "done.up"))
        left = folded.select("source", "left.draw", "left.row", "left.size", "left.mass")
        level += 1
        if groups <= 1:
            break
    parts.append(left.select("row", (F.col("mass") * 2 >= F.col("size")).alias("up")))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done.select(
        F.col("row.id").alias(id_col),
        F.col("row.source").alias(source),
        F.col("row.size").alias(size),
        "row.repeat",
        "row.source_size",
        "row.target",
        (F.col("row.whole") + F.col("up").cast("int")).alias("copies"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it."""
    inner = ("mix_id", "mix_source", "mix_size", "taken_id", "taken_source", "taken_size")
    names = unused(docs.columns, *inner, "taken_repeat", "copies", "taken_key", "row_key", "row_repeat", "time")
    key, other, (repeat2, copies_of, key2, row_key, row_repeat, time) = names[:3], names[3:6], names[6:]
    rows = docs.select("*", *(v.alias(c) for v, c in zip((F.col(id_col), F.col(source), word_count(F.col("text"))), key, strict=True)))
    copies = mix(rows.select(*key), *key).where("copies > 0")
    copies = copies.select(
        *(F.col(c).alias(o) for c, o in zip(key, other, strict=True)),
        F.col("repeat").alias(repeat2),
        F.col("copies").alias(copies_of),
        F.xxhash64(*key).alias(key2),
    )
    rows = rows.withColumn(row_key, F.xxhash64(*key)).repartition(row_key)
    numbered = rows.withColumn(
        row_repeat, F.row_number().over(Window.partitionBy(row_key, *key).orderBy(F.xxhash64("text"))) - 1
    )
    same = (F.col(row_key) == F.col(key2)) & (F.col(row_repeat) == F.col(repeat2))
    for c, o in zip(key, other, strict=True):
        same &= F.col(c).eqNullSafe(F.col(o))
    taken = numbered.join(copies, same)
    times = F.explode(F.sequence(F.lit(1), F.col(copies_of))).alias(time)
    return taken.select(*docs.columns, times).drop(time)
