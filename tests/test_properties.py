"""Property tests against the Python statements of the rules."""

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan import rules
from veilscan.functions import detect as D
from veilscan.functions.text import head_bytes

MULTIBYTE = ["a", "é", "ß", "€", "😀", "٣", "́", " ", "\n"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(min_value=1000, max_value=1030), st.text(alphabet=MULTIBYTE, min_size=0, max_size=40)),
                min_size=8, max_size=8))
def test_head_bytes_equals_python_decode(spark, parts):
    """Texts whose 1024-byte cut falls inside multi-byte characters."""
    texts = ["a" * pad + tail for pad, tail in parts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["h"] for r in df.select("id", head_bytes(F.col("t"), 1024).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.head_bytes(t)


NAME_PARTS = sorted({p for pats in rules.COLUMN_NAME_PATTERNS.values() for p in pats}) + ["x", "_", "id", "Q", "-"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(NAME_PARTS), min_size=1, max_size=3).map("".join), min_size=25, max_size=25))
def test_column_name_profile_equals_python(spark, names):
    names = [n.upper() if i % 3 == 0 else n for i, n in enumerate(names)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, n string")
    got = {r["id"]: list(r["t"]) for r in df.select("id", D.name_types(F.col("n")).alias("t")).collect()}
    for i, n in enumerate(names):
        assert got[i] == brute.name_types(n), n


SOURCE_PARTS = sorted({k for kws, _ in rules.SOURCE_NAME_RULES for k in kws}) + ["-", "logs", "x", "data"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SOURCE_PARTS), min_size=1, max_size=4).map("-".join), min_size=25, max_size=25))
def test_source_name_profile_equals_python(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, n string")
    got = {r["id"]: list(r["t"]) for r in df.select("id", D.source_types(F.col("n")).alias("t")).collect()}
    for i, n in enumerate(names):
        assert got[i] == brute.source_types(n), n
