"""A training corpus from the documents: filtered, deduplicated, decontaminated, mixed, tokenised.

Each stage works on all that the stage before kept. The first four return the columns of
documents; the last returns each document as the written token shards have it. Rows of equal
doc_id in the last stage are the copies that the mix takes.

An empty table goes through all stages. Nulls and repeats are as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import documents, staged, unused
from veilscan.llm.decontaminate import drop_contaminated
from veilscan.llm.minhash import keep_one
from veilscan.llm.mixing import mixed
from veilscan.llm.quality import THRESHOLD, quality_scores
from veilscan.llm.queries import vocabulary
from veilscan.llm.tokens import read_documents, write_shards
from veilscan.session import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    (score,) = unused(docs.columns, "score")
    scored = quality_scores(docs, read_table(spark, sf_dir, "labels"), out=score)
    return scored.where(F.col(score) >= THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token shards."""
    return read_documents(write_shards(docs, vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: hash-driven stages have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; what each keeps is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
