"""Exact dedup by skew-safe combining (native).

Texts are equal when they are identical after no change; a null text counts as empty. Of equal
texts the row with the largest doc_id stays.

1. Equal texts are combined inside each map task and then within a salted digest group, so that
   the copies of a hot text are merged by many tasks.
2. The winners of the salts are combined across salts.
3. Rows find their winner by digest. Groups that hold a thousandth of all rows or more, of which
   there are a thousand at most, are looked up from a broadcast; the rest join by digest.

Both combining stages group by the digest and the full text, so texts are compared as a whole
even where digests are equal. A digest that stands for several texts joins by text in step 3.

Ties and nulls: rows that repeat both text and doc_id count in group_size, and all those that
carry the winning doc_id have kept true; a null doc_id loses to any other, and if all are null
keep_id is null and all rows are kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: groups of at least total / HOT_SHARE rows are broadcast; there are HOT_SHARE of them at most
HOT_SHARE = 1000


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def combine(docs: DataFrame, id_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """One row for each text: digest, text, keep_id, group_size."""
    local = docs.select(
        F.col(id_col).alias("id"),
        text_or_empty().alias("text"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias("salt"),
    ).withColumn("digest", digest(F.col("text")))
    salted = local.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = 8,
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, keep_id, group_size, kept, digest."""
    winners = staged(
        combine(docs.select(id_col, "text"), id_col, digest, salts)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "exact-winners",
    )
    rows = docs.select(F.col(id_col), digest(text_or_empty()).alias("digest"))
    total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    single = winners.where("texts = 1").drop("texts")
    hot = F.col("group_size") * HOT_SHARE >= total
    found = rows.join(
        F.broadcast(
            single.where(hot).select(
                "digest", F.col("keep_id").alias("hot_keep_id"), F.col("group_size").alias("hot_size")
            )
        ),
        "digest",
        "left",
    )
    columns = [id_col, "keep_id", "group_size", "digest"]
    result = (
        found.where(F.col("hot_size").isNotNull())
        .select(id_col, F.col("hot_keep_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "digest")
        .unionByName(found.where(F.col("hot_size").isNull()).join(single.where(~hot), "digest").select(columns))
    )
    several = winners.where("texts > 1").select("digest")
    if not several.isEmpty():
        texts = docs.select(id_col, text_or_empty().alias("text")).withColumn("digest", digest(F.col("text")))
        texts = texts.join(several, "digest", "left_semi")
        by_text = combine(texts.select(id_col, "text"), id_col, digest, salts)
        result = result.unionByName(
            texts.join(by_text, ["digest", "text"]).select(columns)
        )
    return result.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
