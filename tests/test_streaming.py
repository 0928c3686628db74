"""The stateless detectors and masks on a file stream."""

from conftest import SF_SMALL

from veilscan.operators import findings as FD
from veilscan.session import read_table
from veilscan.streaming import read_parquet_stream, start_to_parquet, stream_findings, stream_masked


def test_stream_findings_equal_batch(spark, scratch):
    docs = read_table(spark, SF_SMALL, "documents")
    src = f"{scratch}/in"
    docs.repartition(4).write.parquet(src)
    stream = read_parquet_stream(spark, src, docs.schema, max_files_per_trigger=1)
    assert stream.isStreaming
    q = start_to_parquet(stream_findings(stream, "doc_id", "text"), f"{scratch}/out", "findings",
                         checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(120)
    got = sorted((r["doc_id"], r["pii_types"]) for r in spark.read.parquet(f"{scratch}/out").collect())
    want = sorted((r["doc_id"], ",".join(r["pii_types"])) for r in FD.content_findings(docs, "doc_id", "text").collect())
    assert got == want and len(got) == 8


def test_stream_masked(spark, scratch):
    from veilscan.plans import standins

    ppl = standins.people(read_table(spark, SF_SMALL, "customer"))
    src = f"{scratch}/people"
    ppl.write.parquet(src)
    stream = read_parquet_stream(spark, src, ppl.schema)
    q = start_to_parquet(stream_masked(stream), f"{scratch}/masked", "masked", checkpoint=f"{scratch}/ck2")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{scratch}/masked")
    assert out.count() == ppl.count()
    assert out.where("ssn NOT IN ('***-**-****', '*********') AND ssn NOT LIKE '%*%'").count() == 0


def test_restarted_stream_goes_on_without_duplicates(spark, scratch):
    import uuid

    docs = read_table(spark, SF_SMALL, "documents")
    src, name = f"{scratch}/in", f"restart-{uuid.uuid4().hex}"
    docs.where("doc_id % 2 = 0").write.parquet(src)
    for _ in range(2):
        stream = read_parquet_stream(spark, src, docs.schema)
        start_to_parquet(stream.select("doc_id"), f"{scratch}/out", name).awaitTermination(120)
        if spark.read.parquet(src).count() < docs.count():
            docs.where("doc_id % 2 = 1").write.mode("append").parquet(src)
    got = [r["doc_id"] for r in spark.read.parquet(f"{scratch}/out").collect()]
    assert sorted(got) == sorted(r["doc_id"] for r in docs.collect())
