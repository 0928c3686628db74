"""Quality rules by robust multivariate outliers (native).

Each text gives a vector of four transformed statistics: mean word length, symbols, equal lines
and repeated words, each on a log scale. For every language and source the minimum covariance
determinant estimates the centre and scatter of the ordinary texts, and texts far from it in
Mahalanobis distance are rejected; so are those that fail the two base rules.

1. Statistics of each text are one projection inside the scan stage, written as whole numbers.
2. The fit list of a group has each different vector once: copies of one text, also a third of
   all rows, weigh as one, and are combined before the shuffle. Groups of fewer than MIN_ROWS
   vectors are fitted together, by language, and what then is still too small in one rest group.
3. Concentration steps start from three deterministic scatters (scaled by median deviations,
   spatial signs, squashed scores). Each step puts the distances of all vectors in log-spaced
   bins per group, with counts and moments, so what is shuffled grows with groups and bins and
   not with rows; the least bins that hold half the vectors give the next centre and scatter.
   Steps end when no determinant falls any more. The least determinant of a group wins.
4. The winner is scaled by its median distance, refitted on all vectors within the 97.5 %
   ellipsoid, and scaled again. A text is rejected beyond the ellipsoid that one in 10^9
   normal vectors leaves (REJECT); statistics of text have longer tails than that.

Sums are over whole numbers, so results do not depend on the order of rows. A small variance is
added to each statistic (SPREAD): where nearly all texts agree in one, tiny differences are none.

Defined results. A null text has no words; it and any text with fewer than 50 words fail the base.
Null languages and sources are values of their own. In a rest group of fewer than MIN_ROWS vectors
nothing but the base rejects. Repeated rows and ids are judged row by row. An empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, staged, text_or_empty

#: base rules: least number of words, largest share of words in repeated 3-word windows (percent)
LEAST_WORDS, REPEATED = 50, 50
#: vectors a group has at least to be fitted by itself
MIN_ROWS = 40
#: tail probability of the ellipsoid beyond which a text is rejected
REJECT = 1e-9
#: tail probability of the ellipsoid that the second fit uses
REFIT = 0.025
#: standard deviation added to each statistic
SPREAD = (0.05, 0.4, 0.4, 0.5)
#: transformed statistics are counted in units of 1 / UNIT
UNIT = 1024
#: bins for each doubling of a squared distance, and the bins of the least and largest one
BINS, LOWEST, HIGHEST = 32, -32 * 20, 32 * 40
MOST_STEPS = 30

DIMS = range(4)
PAIRS = list(combinations_with_replacement(DIMS, 2))
_SPACE = " \t\n\x0b\f\r"


def beyond(tail: float) -> float:
    """Squared distance that a chi-squared number of four degrees exceeds with probability ``tail``."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.exp(-mid / 2) * (1 + mid / 2) > tail else (low, mid)
    return low


MEDIAN_OF_NORMAL = beyond(0.5)


# statistics of a text


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(_SPACE))
    return F.when(F.octet_length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def covered_words(starts: Column, width: int) -> Column:
    """Words under windows of ``width`` that start at the sorted ``starts``."""
    step = lambda p, k: F.least(F.coalesce(F.get(starts, k + 1) - p, F.lit(width)), F.lit(width))
    return F.aggregate(F.transform(starts, step), F.lit(0).cast("bigint"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that the text has twice or more."""

    def of_windows(windows: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda p, k: p["h"].eqNullSafe(F.get(pairs, k - 1)["h"]) | p["h"].eqNullSafe(F.get(pairs, k + 1)["h"]),
            )
            return let(F.sort_array(F.transform(twice, lambda p: p["i"])), lambda starts: covered_words(starts, 3))

        numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
            let(numbered, of_sorted)
        )

    last = F.size(words) - 2
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(last, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    return let(windows, of_windows)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.octet_length(F.trim(line, F.lit(_SPACE))) > 0)
    return let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept)))


def statistics(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x0 to x3."""
    text = F.col("text")
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    counted = plain.select(
        "doc_id",
        "lang",
        "source",
        of_words.alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        duplicate_lines(text).cast("bigint").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    share = lambda count, of, per: F.log1p(F.col(count) * F.lit(float(per)) / F.greatest(F.col(of), F.lit(1)))
    vector = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars", 1000),
        share("n_dup_lines", "n_words", 100),
        share("n_repeat_words", "n_words", 100),
    ]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), *(F.round(v * UNIT).cast("bigint").alias(f"x{k}") for k, v in zip(DIMS, vector, strict=True)))


# groups


def fit_groups(rows: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """The group of each language and source, and the different vectors of each group.

    Groups are (lang, source, grp); vectors (grp, x0 to x3).
    """
    xs = [f"x{k}" for k in DIMS]
    vectors = rows.where(~F.col("base_failed")).groupBy("lang", "source", *xs).agg(F.count(F.lit(1)).alias("rows"))
    vectors = staged(vectors.drop("rows"), "outlier-vectors")
    sizes = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("vectors"))
    rest = sizes.where(F.col("vectors") < min_rows).groupBy(F.col("lang").alias("rest_lang")).agg(F.sum("vectors").alias("rest"))
    groups = sizes.join(rest, F.col("lang").eqNullSafe(F.col("rest_lang")), "left").select(
        "lang",
        "source",
        F.when(F.col("vectors") >= min_rows, F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"))))
        .when(F.col("rest") >= min_rows, F.concat(F.lit("language "), F.to_json(F.struct("lang"))))
        .otherwise(F.lit("rest"))
        .alias("grp"),
    )
    groups = staged(groups, "outlier-groups")
    found = vectors.join(renamed(groups), same_group("lang", "source"))
    merged = found.groupBy("grp", *xs).agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    merged = staged(merged, "outlier-fit")
    large = merged.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    return groups, merged.join(large, "grp")


def renamed(groups: DataFrame) -> DataFrame:
    return groups.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})


def same_group(lang: str, source: str) -> Column:
    return F.col(lang).eqNullSafe(F.col("g_lang")) & F.col(source).eqNullSafe(F.col("g_source"))


# estimates: columns grp, start, n, m0.. (centre), w<i><j> (inverse of the scatter's Cholesky factor), logdet


def factored(moments: DataFrame, keep: list[str]) -> DataFrame:
    """Estimates from centres m<i> and scatters c<i><j>."""
    rows = moments
    for i, j in [(i, j) for j in DIMS for i in DIMS if i >= j]:
        inner = F.col(f"c{j}{i}")
        for k in range(j):
            inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(inner) if i == j else inner / F.col(f"l{j}{j}"))
    for j in DIMS:
        for i in range(j, 4):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                total = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j + 1, i)), F.col(f"l{i}{j}") * F.col(f"w{j}{j}"))
                value = -total / F.col(f"l{i}{i}")
            rows = rows.withColumn(f"w{i}{j}", value)
    logdet = sum((2 * F.log(F.col(f"l{k}{k}")) for k in DIMS), F.lit(0.0))
    return rows.select(*keep, *(f"m{k}" for k in DIMS), *(f"w{i}{j}" for i in DIMS for j in range(i + 1)), logdet.alias("logdet"))


ESTIMATE = [*(f"m{k}" for k in DIMS), *(f"w{i}{j}" for i in DIMS for j in range(i + 1))]


def squared_distance() -> Column:
    at = lambda k: F.col(f"x{k}") / F.lit(float(UNIT)) - F.col(f"m{k}")
    parts = [sum((F.col(f"w{i}{j}") * at(j) for j in range(1, i + 1)), F.col(f"w{i}0") * at(0)) for i in DIMS]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def bin_of(squared: Column) -> Column:
    return F.when(squared <= 0, F.lit(LOWEST)).otherwise(
        F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(F.log2(squared) * BINS).cast("int")))
    )


def binned(vectors: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors by group and bin of their distance: count and moments of each bin and all below it."""
    rows = vectors.join(estimates, "grp").withColumn("bin", bin_of(squared_distance()))
    sums = [F.sum(f"x{k}").alias(f"s{k}") for k in DIMS]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    by_bin = rows.groupBy(*keys, "n", "bin").agg(F.count(F.lit(1)).alias("rows"), *sums, *products)
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ["rows", *(f"s{k}" for k in DIMS), *(f"p{i}{j}" for i, j in PAIRS)]
    return by_bin.select(*keys, "n", "bin", F.col("rows").alias("here"), *(F.sum(name).over(below).alias(name) for name in names))


def moments_of(sums: DataFrame, keep: list[str]) -> DataFrame:
    """Centres and scatters of summed vectors."""
    mean = [F.col(f"s{k}") / F.col("rows") / F.lit(float(UNIT)) for k in DIMS]
    centres = [m.alias(f"m{k}") for k, m in zip(DIMS, mean, strict=True)]
    scatter = [
        (F.col(f"p{i}{j}") / F.col("rows") / F.lit(float(UNIT * UNIT)) - mean[i] * mean[j] + F.lit(SPREAD[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i, j in PAIRS
    ]
    return sums.select(*keep, *centres, *scatter)


def half_of(n: Column) -> Column:
    return F.floor((n + len(DIMS) + 1) / 2)


def concentrated(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates after one concentration step of each group and start."""
    found = binned(vectors, estimates.select("grp", "start", *ESTIMATE), ["grp", "start"])
    cut = found.where((F.col("rows") >= half_of(F.col("n"))) & (F.col("rows") - F.col("here") < half_of(F.col("n"))))
    return factored(moments_of(cut, ["grp", "start"]), ["grp", "start"])


def medians(values: DataFrame) -> DataFrame:
    """(grp, dim, value, rows) -> (grp, dim, median): the least value with half the rows at or below it."""
    by_value = Window.partitionBy("grp", "dim").orderBy("value")
    everything = Window.partitionBy("grp", "dim")
    reached = values.withColumns({"at": F.sum("rows").over(by_value), "all": F.sum("rows").over(everything)})
    return reached.where("at * 2 >= all").groupBy("grp", "dim").agg(F.min("value").alias("median"))


def starts(vectors: DataFrame) -> DataFrame:
    """Three estimates of each group."""
    long = vectors.select("grp", F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), F.col(f"x{k}").alias("value")) for k in DIMS))).alias("v"))
    values = staged(long.groupBy("grp", "v.dim", "v.value").agg(F.count(F.lit(1)).alias("rows")), "outlier-values")
    centre = medians(values)
    away = values.join(centre, ["grp", "dim"]).groupBy("grp", "dim", F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("rows").alias("rows"))
    spread = medians(away).withColumnRenamed("median", "away")
    wide = centre.join(spread, ["grp", "dim"]).groupBy("grp").pivot("dim", list(DIMS)).agg(F.first("median").alias("m"), F.first("away").alias("d"))
    scale = [F.sqrt(F.pow(F.col(f"{k}_d") / F.lit(float(UNIT)) * 1.4826, 2) + SPREAD[k] ** 2).alias(f"d{k}") for k in DIMS]
    wide = staged(wide.select("grp", *((F.col(f"{k}_m") / F.lit(float(UNIT))).alias(f"m{k}") for k in DIMS), *scale), "outlier-medians")

    score = [(F.col(f"x{k}") / F.lit(float(UNIT)) - F.col(f"m{k}")) / F.col(f"d{k}") for k in DIMS]
    rows = vectors.join(wide, "grp").select("grp", *(s.alias(f"z{k}") for k, s in zip(DIMS, score, strict=True)))
    length = F.sqrt(sum((F.col(f"z{k}") * F.col(f"z{k}") for k in DIMS), F.lit(0.0)))
    sign = [F.when(F.col("length") > 0, F.col(f"z{k}") / F.col("length")).otherwise(0.0) for k in DIMS]
    squashed = [F.tanh(f"z{k}") for k in DIMS]
    # rounded to whole numbers, so that sums do not depend on the order of rows
    total = lambda parts, i, j: F.sum(F.round(parts[i] * parts[j] * 2**20).cast("bigint")) / F.count(F.lit(1)) / 2.0**20
    scatters = (
        rows.withColumn("length", length)
        .groupBy("grp")
        .agg(
            *(total(sign, i, j).alias(f"a{i}{j}") for i, j in PAIRS),
            *(total(squashed, i, j).alias(f"b{i}{j}") for i, j in PAIRS),
        )
    )
    # a scatter of scores is brought back to the statistics' scales; signs and squashed scores are short of the diagonal by a factor that no distance order depends on
    shape = lambda name: F.array(
        *((F.col(f"d{i}") * F.col(f"d{j}") * (F.col(f"{name}{i}{j}") + (0.01 if i == j else 0.0))).cast("double") for i, j in PAIRS)
    )
    diagonal = F.array(*((F.col(f"d{i}") * F.col(f"d{j}") if i == j else F.lit(0.0)).cast("double") for i, j in PAIRS))
    each = wide.join(scatters, "grp").select("grp", *(f"m{k}" for k in DIMS), F.posexplode(F.array(diagonal, shape("a"), shape("b"))).alias("start", "c"))
    each = each.select("grp", "start", *(f"m{k}" for k in DIMS), *(F.col("c")[k].alias(f"c{i}{j}") for k, (i, j) in enumerate(PAIRS)))
    return factored(each, ["grp", "start"])


def scaled(found: DataFrame) -> DataFrame:
    """(grp, factor): by how much squared distances exceed those of normal numbers at the median."""
    half = found.where(F.col("rows") >= half_of(F.col("n"))).groupBy("grp").agg(F.min("bin").alias("bin"))
    edge = F.pow(F.lit(2.0), (F.col("bin") + 1) / F.lit(float(BINS)))
    return half.select("grp", F.greatest(F.lit(1.0), edge / MEDIAN_OF_NORMAL).alias("factor"))


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """(grp, estimate, factor) of each group: minimum covariance determinant, refitted and scaled."""
    current = staged(starts(vectors), "outlier-start")
    for step in range(MOST_STEPS):
        following = staged(concentrated(vectors, current), "outlier-step")
        fall = current.select("grp", "start", F.col("logdet").alias("before")).join(following, ["grp", "start"])
        most = fall.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        current = following
        # the first step's fall is that from a start, which is no determinant of half the vectors
        if step and (most is None or most <= 1e-9):
            break
    best = current.groupBy("grp").agg(F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    found = staged(binned(vectors, best, ["grp"]), "outlier-bins")
    inside = found.join(scaled(found), "grp").where(F.col("bin") <= bin_of(F.col("factor") * beyond(REFIT)))
    names = ["rows", *(f"s{k}" for k in DIMS), *(f"p{i}{j}" for i, j in PAIRS)]
    sums = inside.groupBy("grp").agg(F.max_by(F.struct(*names), F.col("bin")).alias("s")).select("grp", "s.*")
    refitted = staged(factored(moments_of(sums, ["grp"]), ["grp"]), "outlier-refit").select("grp", *ESTIMATE)
    return staged(refitted.join(scaled(binned(vectors, refitted, ["grp"])), "grp"), "outlier-estimates")


def judged(docs: DataFrame, id_col: str = "doc_id", min_rows: int = MIN_ROWS, reject: float = REJECT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the statistics, base_failed, distance, kept.

    ``distance`` is the squared distance in units of ordinary texts; null where the base failed
    or no group of the text was large enough.
    """
    rows = staged(statistics(docs, id_col), "outlier-statistics")
    groups, vectors = fit_groups(rows, min_rows)
    estimates = robust_estimates(vectors)
    by_source = renamed(groups).join(estimates, "grp", "left")
    far = F.when(~F.col("base_failed"), squared_distance() / F.col("factor"))
    return (
        rows.join(by_source, same_group("lang", "source"), "left")
        .withColumn("distance", far)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= beyond(reject))).alias("kept"),
            "distance",
        )
    )
