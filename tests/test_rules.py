"""Truth tables for the three detection profiles (FIXTURES.md sections 3-5)."""

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan import rules
from veilscan.functions import classify as C
from veilscan.functions import detect as D

CONTENT_CASES = [
    ("john@example.com", ["EMAIL"]),
    ("a@b.c|d", ["EMAIL"]),
    ("a@b.co_", []),
    ("a@bücher.de", []),
    ("ünal@example.com", []),
    ("123-45-6789-1", ["SSN"]),
    ("line\n123-45-6789", ["SSN"]),
    ("é123-45-6789", []),
    ("123-45-6789é", []),
    ("٣٣٣-٤٤-٥٥٥٥", ["SSN"]),
    ("(555) 123-4567", []),
    ("call (555) 123-4567", []),
    ("_555-123-4567", []),
    ("tel(555) 123-4567", ["PHONE"]),
    ("555.123.4567", ["PHONE"]),
    ("5551234567", ["PHONE"]),
    ("555-123-4567", ["PHONE"]),
    ("1 555-123-4567", ["PHONE"]),
    ("4111 1111 1111 1111", ["CREDIT_CARD"]),
    ("4111-1111-1111-1111", ["CREDIT_CARD"]),
    ("01/31/1990", ["DATE_OF_BIRTH"]),
    ("13/01/1990", []),
    ("31-12-1990", []),
    ("x01-31-1990", []),
    ("e\u0301123-45-6789", ["SSN"]),
    ("123-45-6789\u0301", ["SSN"]),
    ("x\u203f555-123-4567", ["PHONE"]),
    ("tel(555)\x1c123-4567", ["PHONE"]),
    ("²123-45-6789", []),
    ("123-45-6789\u200d", ["SSN"]),
    ("", []),
    (None, []),
]

SIMPLE_PHONE = {"555-123-4567", "1 555-123-4567", "x\u203f555-123-4567"}


def _types(spark, texts, profile="content"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", D.content_types(F.col("text"), profile).alias("t")).collect()
    return {r["id"]: list(r["t"]) for r in rows}


def test_content_truth_table(spark):
    got = _types(spark, [t for t, _ in CONTENT_CASES])
    for i, (text, expected) in enumerate(CONTENT_CASES):
        assert got[i] == expected, (text, got[i])
        assert got[i] == brute.content_types(text), text


def test_simple_profile_truth_table(spark):
    got = _types(spark, [t for t, _ in CONTENT_CASES], "simple")
    for i, (text, _) in enumerate(CONTENT_CASES):
        assert got[i] == brute.content_types(text, rules.SIMPLE_PATTERNS), text
        assert ("PHONE" in got[i]) == (text in SIMPLE_PHONE), text


ALPHABET = list("0123456789-./() @_aZé٣|\n") + [" ", "x", "1", "5", "\u0301", "\u203f", "\u200d", "\x1c", "²", "\u00a0"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=40), min_size=20, max_size=20))
def test_content_matches_python_re(spark, texts):
    """Spark (Java regex with (?U) and the cheap guards) equals Python re."""
    got = _types(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute.content_types(t), repr(t)


COLUMN_CASES = [
    ("email_address", ["EMAIL", "ADDRESS"], "MEDIUM_RISK"),
    ("state_tax_id", ["SSN", "ADDRESS"], "CRITICAL_RISK"),
    ("payment_card", ["CREDIT_CARD", "SALARY"], "CRITICAL_RISK"),
    ("credit_card_number", ["CREDIT_CARD"], "CRITICAL_RISK"),
    ("payload", ["SALARY"], "HIGH_RISK"),
    ("cancelled", ["PHONE"], "MEDIUM_RISK"),
    ("filename", ["NAME"], "MEDIUM_RISK"),
    ("p_name", ["NAME"], "MEDIUM_RISK"),
    ("capacity", ["ADDRESS"], "LOW_RISK"),
    ("statement", ["ADDRESS"], "LOW_RISK"),
    ("postal_code", ["ADDRESS"], "LOW_RISK"),
    ("language", ["AGE"], "LOW_RISK"),
    ("message", ["AGE"], "LOW_RISK"),
    ("birth_year", ["AGE"], "LOW_RISK"),
    ("page_id", ["AGE"], "LOW_RISK"),
    ("l_shipdate", [], "NO_RISK"),
    ("url", [], "NO_RISK"),
    ("Phone-No", ["PHONE"], "MEDIUM_RISK"),
]


def test_column_name_truth_table(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in COLUMN_CASES], "name string")
    t = D.name_types(F.col("name"))
    rows = df.select("name", t.alias("t"), C.data_classification(t).alias("c")).collect()
    got = {r["name"]: (list(r["t"]), r["c"]) for r in rows}
    for name, types, cls in COLUMN_CASES:
        assert got[name] == (types, cls), name
        assert got[name][0] == brute.name_types(name)


SOURCE_CASES = [
    ("user-profiles", ["EMAIL", "PHONE", "NAME"], "HIGH", "INTERNAL", "PII_DETECTED"),
    ("customer", ["EMAIL", "PHONE", "NAME"], "HIGH", "INTERNAL", "PII_DETECTED"),
    ("transaction-logs", ["CREDIT_CARD", "SSN"], "MEDIUM", "INTERNAL", "REQUIRES_MASKING"),
    ("patient-payment", ["CREDIT_CARD", "SSN", "MEDICAL_RECORD", "SSN"], "HIGH", "INTERNAL", "PII_DETECTED"),
    ("employee-payroll", ["SSN", "SALARY", "NAME"], "HIGH", "INTERNAL", "PII_DETECTED"),
    ("audit-trail", [], "NO_RISK", "PUBLIC", "PUBLIC"),
]


def test_source_name_truth_table(spark):
    from veilscan.operators.tags import classify_sources

    df = spark.createDataFrame(
        [("file", n, "cataloged", n + "_db") for n, *_ in SOURCE_CASES], "type string, name string, status string, database string"
    )
    rows = {r["source"]: r for r in classify_sources(df).collect()}
    for name, types, risk, access, gov in SOURCE_CASES:
        r = rows[name]
        assert list(r["pii_types"]) == types == brute.source_types(name)
        assert r["risk_level"] == risk
        assert r["tags"]["AccessLevel"] == access
        assert r["tags"]["DataGovernance"] == gov
        assert r["tags"]["PIIType"] == (types[0] if types else "NONE")
        assert r["tags"]["DataClassification"] == risk


@pytest.mark.parametrize("types", [[], ["AGE"], ["NAME", "AGE"], ["SALARY", "EMAIL"], ["ADDRESS", "SSN"], ["MEDICAL_RECORD"]])
def test_classification_and_access(spark, types):
    df = spark.createDataFrame([(types,)], "t array<string>")
    r = df.select(C.data_classification("t").alias("c")).first()
    assert r["c"] == brute.classification(types)
    r2 = df.select(C.access_level(F.lit(r["c"])).alias("a")).first()
    assert r2["a"] == brute.access(r["c"])


def test_classification_is_monotone():
    """Adding a type never lowers the class."""
    import itertools

    types = rules.COLUMN_TYPES
    order = [rules.NO_RISK] + [name for name, _ in reversed(rules.RISK_TIERS)]
    rank = lambda found: order.index(rules.classify_types(found))
    for a, b in itertools.product(types, types):
        assert rank([a, b]) >= rank([a])


EMAIL_PARTS = st.sampled_from(["a", "Z", "0", ".", "_", "%", "+", "-", "@", "|", " ", "é", "\n", "co", ".org", "%20", "@x.com"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(EMAIL_PARTS, max_size=14).map("".join), min_size=60, max_size=60))
def test_linear_email_equals_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    hit = D.content_hit("t", "EMAIL", rules.CONTENT_PATTERNS["EMAIL"])
    for r in df.select("id", hit.alias("h")).collect():
        assert r["h"] == ("EMAIL" in brute.content_types(texts[r["id"]])), repr(texts[r["id"]])


def test_email_on_a_long_encoded_run_is_linear(spark):
    import time

    run = "%41%2B" * 180_000  # more than a megabyte that could begin an address anywhere
    df = spark.createDataFrame([(run + " x@", False), (run + "@x.org", True), ("é" + run, False)], "t string, want boolean")
    hit = D.content_hit("t", "EMAIL", rules.CONTENT_PATTERNS["EMAIL"])
    df.limit(1).select(hit).collect()
    began = time.time()
    assert all(r["h"] == r["want"] for r in df.select("want", hit.alias("h")).collect())
    assert time.time() - began < 3


def test_driver_side_name_rule_equals_column_rule(spark):
    """mask_table picks columns on the driver from schema metadata; that rule
    must equal the Column form used by the catalog scan."""
    from conftest import SF_SMALL

    from veilscan.operators.masking import column_types_by_name
    from veilscan.session import read_tables

    names = [n for n, _, _ in COLUMN_CASES]
    for df in read_tables(spark, SF_SMALL).values():
        names.extend(df.columns)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    col_rule = {r["name"]: list(r["t"]) for r in df.select("name", D.name_types(F.col("name")).alias("t")).collect()}
    wide = spark.createDataFrame([tuple(range(len(set(names))))], ", ".join(f"`{n}` int" for n in dict.fromkeys(names)))
    assert column_types_by_name(wide) == {n: col_rule[n] for n in dict.fromkeys(names)}
