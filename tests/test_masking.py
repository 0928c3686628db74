"""Masking truth table (FIXTURES.md section 6) and properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan import rules
from veilscan.functions.mask import mask, masking_rule

CASES = [
    ("EMAIL", None, "jane.doe@company.com", "ja" + "*" * 18),
    ("PHONE", None, "555-123-4567", "555*******67"),
    ("NAME", None, "John", "J**n"),
    ("NAME", None, "Jo", "**"),
    ("CREDIT_CARD", None, "4111-1111-1111-1111", "*" * 15 + "1111"),
    ("SSN", None, "123-45-6789", "***-**-****"),
    ("SSN", None, "123-45-6789x", "***-**-****"),
    ("SSN", None, "1234567890", "*" * 9),
    ("SSN", None, "12-34", "**-**"),
    ("DATE_OF_BIRTH", None, "01/31/1990", "[REDACTED_DATE_OF_BIRTH]"),
    ("SALARY", None, "75000", "[REDACTED_SALARY]"),
    ("AGE", None, "42", "[REDACTED_AGE]"),
    ("SALARY", ("hash", 0, 0, "*"), "75000", "19993dc8f0a45316"),
    ("NAME", ("tokenize", 0, 0, "*"), "John", "TOKEN_NAME_61409aa1"),
    ("NAME", ("full_mask", 0, 0, "*"), "John", "****"),
    ("PHONE", ("format_preserve", 0, 0, "*"), "(555) 123-4567", "(***) ***-****"),
    ("CREDIT_CARD", ("format_preserve", 0, 0, "*"), "1234", "1234"),
    ("CREDIT_CARD", ("format_preserve", 0, 0, "*"), "123", "***"),
    ("EMAIL", None, None, None),
    ("EMAIL", None, "", ""),
    ("MEDICAL_RECORD", None, "abc", "abc"),
    ("UNKNOWN", None, "abc", "abc"),
    ("ADDRESS", ("format_preserve", 0, 0, "$"), "12 Main St", "$$ $$$$ $$"),
    ("PHONE", ("format_preserve", 0, 0, "\\"), "555", "\\\\\\"),
]


def _rules(t, custom):
    if custom is None:
        return None
    s, f, l, ch = custom
    from veilscan.functions.mask import merged_rules

    return merged_rules({t: masking_rule(t, s, show_first=f, show_last=l, replacement_char=ch)})


def test_masking_truth_table(spark):
    df = spark.createDataFrame([(i, v) for i, (_, _, v, _) in enumerate(CASES)], "id int, v string")
    cols = [mask(F.col("v"), t, _rules(t, c)).alias(f"m{i}") for i, (t, c, _, _) in enumerate(CASES)]
    rows = {r["id"]: r for r in df.select("id", *cols).collect()}
    for i, (t, c, v, expected) in enumerate(CASES):
        got = rows[i][f"m{i}"]
        assert got == expected, (t, c, v, got)


def test_unknown_strategy_rejected():
    with pytest.raises(ValueError):
        masking_rule("NAME", "scramble")


STRATS = [
    ("full_mask", 0, 0, "*"), ("partial_mask", 2, 1, "#"), ("partial_mask", 0, 4, "*"), ("hash", 0, 0, "*"),
    ("tokenize", 0, 0, "*"), ("redact", 0, 0, "*"), ("format_preserve", 0, 0, "*"), ("format_preserve", 0, 0, "$"),
]
TYPES = ["SSN", "PHONE", "CREDIT_CARD", "NAME", "EMAIL"]


def shown(value, masked, ch):
    """Places where the mask shows the value's own character."""
    return [i for i, (a, b) in enumerate(zip(value, masked, strict=True)) if a == b and b != ch]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=list("0123456789-() .abcXYZé😀٣"), min_size=1, max_size=20), min_size=10, max_size=10))
def test_masks_hide_what_they_promise(spark, values):
    """Length kept, shown characters bounded and only at the ends, no digit left, no value repeated."""
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    combos = [(t, s) for t in TYPES for s in STRATS]
    rows = df.select("id", *[mask(F.col("v"), t, _rules(t, s)).alias(f"m{j}") for j, (t, s) in enumerate(combos)]).collect()
    for r in rows:
        v = values[r["id"]]
        for j, (t, (strategy, first, last, ch)) in enumerate(combos):
            m = r[f"m{j}"]
            if strategy == "full_mask":
                assert len(m) == len(v) and set(m) == {ch}
            elif strategy == "partial_mask":
                places = shown(v, m, ch)
                assert len(m) == len(v) and all(i < first or i >= len(v) - last for i in places)
                assert len(places) <= (first + last if len(v) > first + last else 0)
            elif strategy == "hash":
                assert re.fullmatch("[0-9a-f]{16}", m)
            elif strategy == "tokenize":
                assert re.fullmatch(f"TOKEN_{t}_[0-9a-f]{{8}}", m)
            elif strategy == "redact":
                assert m == f"[REDACTED_{t}]"
            elif t == "CREDIT_CARD":
                assert len(m) == len(v) and len(shown(v, m, ch)) <= (4 if len(v) >= 4 else len(v))
            else:
                assert not re.search("[0-9]", m)
                assert len(m) <= len(v)
    # equal values have equal masks
    again = {(v, j): r[f"m{j}"] for r in rows for v in [values[r["id"]]] for j in range(len(combos))}
    assert all(again[values[r["id"]], j] == r[f"m{j}"] for r in rows for j in range(len(combos)))


def test_masks_keep_length_and_show_at_most(spark):
    vals = ["a", "ab", "abcdef", "é😀abc", "x" * 50]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    r = df.select(
        "v",
        mask("v", "NAME", _rules("NAME", ("full_mask", 0, 0, "*"))).alias("full"),
        mask("v", "NAME", _rules("NAME", ("partial_mask", 2, 1, "*"))).alias("part"),
    ).collect()
    for row in r:
        assert len(row["full"]) == len(row["v"]) and set(row["full"]) == {"*"}
        assert len(row["part"]) == len(row["v"])
        shown = sum(1 for a, b in zip(row["part"], row["v"]) if a == b and a != "*")
        assert shown <= 3


def test_mask_table_by_column_names(spark):
    from veilscan.operators.masking import mask_table

    df = spark.createDataFrame([(1, "Jane Roe", "jane@x.org", "123-45-6789", "ok")],
                               "id long, full_name string, email string, ssn string, note string")
    r = mask_table(df).first()
    assert r["id"] == 1 and r["note"] == "ok"
    assert r["full_name"] == "J******e"
    assert r["email"] == "ja********"
    assert r["ssn"] == "***-**-****"
    p = mask_table(df, suffix="_masked").first()
    assert p["email"] == "jane@x.org" and p["email_masked"] == r["email"]


def test_default_rules_cover_column_types():
    assert set(rules.DEFAULT_MASKING) == set(rules.COLUMN_TYPES)


def test_mask_by_type_per_row(spark):
    from veilscan.functions.mask import mask_by_type

    rows = [("EMAIL", "jane.doe@company.com"), ("PHONE", "555-123-4567"), ("SSN", "123-45-6789"),
            ("MEDICAL_RECORD", "abc"), ("NAME", None), ("AGE", "")]
    df = spark.createDataFrame(rows, "t string, v string")
    got = [r["m"] for r in df.select(mask_by_type("v", "t").alias("m")).collect()]
    assert got == ["ja" + "*" * 18, "555*******67", "***-**-****", "abc", None, ""]


def test_preview_and_masked_copy(spark, scratch):
    from conftest import SF_SMALL

    from veilscan.operators.masking import mask_preview
    from veilscan.plans import standins
    from veilscan.plans.scan import masked_copy
    from veilscan.session import read_table
    from veilscan.sources.sinks import write_findings

    ppl = standins.people(read_table(spark, SF_SMALL, "customer"))
    prev = mask_preview(ppl, n=5, key_cols="c_custkey").collect()
    assert [r["c_custkey"] for r in prev] == [0, 1, 2, 3, 4]
    assert all(r["ssn_masked"] in ("***-**-****", "*********") or "*" in r["ssn_masked"] for r in prev)
    assert prev[1]["email"] != prev[1]["email_masked"]
    out = masked_copy(ppl, f"{scratch}/masked")
    back = spark.read.parquet(out)
    assert back.count() == ppl.count()
    orig = {r["c_custkey"]: r for r in ppl.collect()}
    for r in back.collect():
        o = orig[r["c_custkey"]]
        assert r["email"] == (o["email"] and o["email"][:2] + "*" * (len(o["email"]) - 2))
        card = o["credit_card_number"]
        assert r["credit_card_number"] == ("*" * (len(card) - 4) + card[-4:] if len(card) > 4 else "*" * len(card))
        assert r["contact"]["email"] == r["email"] and r["contact"]["id"] == o["c_custkey"]
        assert r["c_acctbal"] == o["c_acctbal"]
        assert r["salary"] == "[REDACTED_SALARY]" and r["c_mktsegment"] == o["c_mktsegment"]
    path = write_findings(ppl.select("c_custkey", "c_mktsegment"), f"{scratch}/f", partition_by=["c_mktsegment"])
    assert spark.read.parquet(path).count() == ppl.count()


def test_nested_and_oddly_named_columns_are_masked(spark):
    from veilscan.operators.masking import mask_table

    shape = (
        "`work.email` string, contact struct<email: string, age: int, notes: array<string>>, phones array<string>, "
        "by_kind map<string, struct<ssn: string, ok: int>>, address struct<line1: string, zip: string>, tags array<string>"
    )
    row = ("a@b.org", ("c@d.org", 41, ["hi"]), ["555-123-4567", None], {"x": ("123-45-6789", 1)}, ("1 Main St", "12345"), ["t"])
    df = spark.createDataFrame([row, (None, None, None, None, None, None)], shape)
    first, empty = mask_table(df).collect()
    assert first["work.email"] == "a@*****"
    assert first["contact"].asDict() == {"email": "c@*****", "age": "[REDACTED_AGE]", "notes": ["hi"]}
    assert first["phones"] == ["555*******67", None] and first["tags"] == ["t"]
    assert first["by_kind"]["x"].asDict() == {"ssn": "***-**-****", "ok": 1}
    assert first["address"].asDict() == {"line1": "1 M******", "zip": "123**"}
    assert all(v is None for v in empty)
    with pytest.raises(ValueError):
        mask_table(spark.createDataFrame([({"a@b.org": "x"},)], "emails map<string,string>"))
    with pytest.raises(ValueError):
        mask_table(spark.createDataFrame([(bytearray(b"x"),)], "ssn binary"))
    with pytest.raises(TypeError):
        masking_rule("NAME", "full_mask", show_frist=1)
