"""Small fixtures for the tests of the llm operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: column names that operators use inside, to see that an input's own do no harm
CLASHING = ("size", "score", "n", "node", "label", "shard", "target", "kept", "entry", "word")
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """documents from (doc_id, text[, source[, lang]]) rows."""
    full = []
    for row in rows:
        doc_id, text, source, lang = (*row, *(None, None)[: max(0, 4 - len(row))]) if len(row) < 4 else row
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(full, SHAPE).repartition(3)
    if extra:
        for name in CLASHING:
            df = df.selectExpr("*", f"doc_id as {name}")
    return df


def words_of(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu"]

    def word(k: int) -> str:
        out = ""
        while True:
            out += syllables[k % 10]
            k //= 10
            if not k:
                return out

    return [word(rng.randrange(vocabulary)) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words_of(random.Random(seed), n))


ODD = [(None, None), (None, "x"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "é 🙂 ñ"), (6, "long " * 30000)]
