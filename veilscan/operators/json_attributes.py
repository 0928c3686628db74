"""D5 + D6 inside JSON text: the attributes that a column of JSON texts holds.

Items often carry a document of their own in a string column. Its attributes
have no place in the table's schema, so neither the column-name profile nor
the string attributes of a row see them. Here each text is parsed once into a
VARIANT and opened level by level, all in the scan's own stage; only counts
per attribute path are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import classify as C
from veilscan.functions import detect as D

from .findings import quoted

MALFORMED = "MALFORMED"
PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"


def nesting(text: Column) -> Column:
    """How deep brackets are nested in a JSON text, without those inside its strings."""
    outside = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")
    step = lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def advance(at: Column, c: Column) -> Column:
        now = at["now"] + step(c)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(brackets, start, advance, lambda at: at["most"])


def _child_path(path: Column, key: Column) -> Column:
    """``path.key``, ``path['odd key']`` or, for the elements of an array, ``path[]``."""
    odd = F.concat(F.lit("['"), F.replace(key, F.lit("'"), F.lit("''")), F.lit("']"))
    named = F.when(key.rlike(PLAIN_KEY), F.concat(F.lit("."), key)).otherwise(odd)
    return F.concat(path, F.when(key.isNull(), F.lit("[]")).otherwise(named))


def json_leaves(df: DataFrame, json_col: str, depth: int | None = None) -> DataFrame:
    """Every value that is no container of every JSON text: ``path, name, value_type, value``.

    ``path`` starts at ``$``; the elements of an array share one path; ``name`` is the key that
    holds the value (that of the array for its elements). ``value_type`` is Spark's type name
    without sizes (``VOID`` for a JSON null, ``OBJECT`` and ``ARRAY`` for empty containers) and
    ``value`` the value as text. A text that is not JSON (or has a repeated key, or is too large
    for a VARIANT) is one value of type ``MALFORMED``, whole. Null texts hold nothing.

    ``depth`` is the number of levels to open; without it the deepest text is looked for first,
    in a pass that returns one number.
    """
    texts = df.select(F.col(quoted(json_col)).cast("string").alias("text")).where("text IS NOT NULL")
    if depth is None:
        depth = texts.agg(F.max(F.when(F.try_parse_json("text").isNotNull(), nesting(F.col("text"))))).first()[0] or 0
    none = F.lit(None).cast("string")
    rows = texts.select("text", F.try_parse_json("text").alias("value"), F.lit("$").alias("path"), none.alias("name"))
    for _ in range(depth):
        # containers give a row for each child, everything else one row of nulls
        opened = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("value").outer()).toDF("pos", "key", "child"))
        below = F.col("pos").isNotNull()
        rows = opened.select(
            "text",
            F.coalesce("child", "value").alias("value"),
            F.when(below, _child_path(F.col("path"), F.col("key"))).otherwise(F.col("path")).alias("path"),
            F.coalesce("key", "name").alias("name"),
        )
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z_]+", 0)
    whole = F.col("value").isNull()
    return rows.select(
        "path",
        "name",
        F.when(whole, F.lit(MALFORMED)).otherwise(kind).alias("value_type"),
        F.when(whole, F.col("text")).when(~kind.isin("OBJECT", "ARRAY"), F.try_variant_get("value", "$", "string")).alias("value"),
    )


def json_attributes(df: DataFrame, json_col: str, profile: str | dict[str, str] = "content", depth: int | None = None) -> DataFrame:
    """One row per attribute path and value type of a column of JSON texts.

    ``path, value_type, values`` (how often), ``hits`` (values in which a pattern of ``profile``
    matches), ``pii_types`` (those patterns, rule order), ``name_types`` (types that the
    attribute's own name gives, D1) and the classification of both together.

    Counting is partial, so a path that every row has sends one row per task.
    """
    patterns = D.profile_patterns(profile)
    leaves = json_leaves(df, json_col, depth)
    digits = D.has_digit_run(F.col("value")) if D.needs_digit_run(patterns) else None
    if digits is not None:
        leaves = leaves.withColumn("run", digits)
    flags = {t: D.content_hit("value", t, p, digit_run=F.col("run") if digits is not None else None) for t, p in patterns.items()}
    flagged = leaves.select("path", "name", "value_type", *[F.coalesce(f, F.lit(False)).alias(f"hit_{i}") for i, f in enumerate(flags.values())])
    names = [f"hit_{i}" for i in range(len(flags))]
    any_hit = reduce(lambda a, b: a | b, [F.col(n) for n in names], F.lit(False))
    found = flagged.groupBy("path", "name", "value_type").agg(
        F.count(F.lit(1)).alias("values"), F.count_if(any_hit).alias("hits"), *[F.max(n).alias(n) for n in names]
    )
    types = F.array_compact(F.array(*[F.when(F.col(n), F.lit(t)) for n, t in zip(names, flags, strict=True)])).cast("array<string>")
    by_name = F.when(F.col("name").isNull(), F.array().cast("array<string>")).otherwise(D.name_types("name"))
    out = found.select("path", "value_type", "values", "hits", types.alias("pii_types"), by_name.alias("name_types"))
    both = F.array_union("pii_types", "name_types")
    return out.withColumn("data_classification", C.data_classification(both)).withColumn(
        "access_level", C.access_level(F.col("data_classification"))
    )
