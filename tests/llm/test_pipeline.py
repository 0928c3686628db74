from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.conftest import SF_SMALL
from tests.llm.data import ODD, frame
from tests.llm.test_native import targets
from tests.llm.test_pairs import brute_classes
from veilscan.llm.quality import THRESHOLD, quality_scores
from veilscan.session import read_table


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark):
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "mix_sources", "tokens"]
    docs = read_table(spark, SF_SMALL, "documents")
    rows = {r.doc_id: r for r in docs.collect()}

    first = stages["quality"](spark, docs, SF_SMALL).cache()
    scores = quality_scores(docs, read_table(spark, SF_SMALL, "labels"))
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in scores.collect() if r.score >= THRESHOLD}
    assert 0.7 * len(rows) < first.count() < len(rows)

    second = stages["near_dedup"](spark, first, SF_SMALL).cache()
    left = [(r.doc_id, r.text) for r in first.collect()]
    assert second.columns == docs.columns
    assert {r.doc_id for r in second.collect()} == set(brute_classes(left).values())

    third = stages["decontaminate"](spark, second, SF_SMALL).cache()
    items = [" ".join(r.text.lower().split()) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    holds = {r.doc_id for r in second.collect() if any(i in " ".join(r.text.lower().split()) for i in items)}
    kept = {r.doc_id for r in third.collect()}
    assert holds and kept == {r.doc_id for r in second.collect()} - holds

    fourth = stages["mix_sources"](spark, third, SF_SMALL).cache()
    assert fourth.columns == docs.columns
    size = lambda text: len((text or "").split())
    sizes, taken = Counter(), Counter()
    for r in third.collect():
        sizes[r.source] += size(r.text)
    for r in fourth.collect():
        assert r == rows[r.doc_id]
        taken[r.source] += size(r.text)
    largest = max(size(r.text) for r in third.collect())
    for source, want in targets(sizes).items():
        assert abs(taken[source] - want) <= largest
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= 3

    fifth = stages["tokens"](spark, fourth, SF_SMALL).collect()
    assert Counter(r.doc_id for r in fifth) == Counter(r.doc_id for r in fourth.collect())
    at = 0
    for r in sorted(fifth, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_take_odd_tables(spark):
    for rows in ([], ODD):
        docs = frame(spark, rows, extra=True)
        for name in ("__id", "__source", "__size", "__node", "__bad", "__text", "__quality", "_score", "text_node", "kept_id", "mix_id", "bad_id", "copies"):
            docs = docs.withColumn(name, F.lit(f"own {name}"))
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns, name
            assert all(r["__quality"] == "own __quality" and r["copies"] == "own copies" for r in out.collect())
            assert out.count() <= 3 * len(rows)
        assert pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == len(rows)
