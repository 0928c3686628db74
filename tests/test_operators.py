"""Operators against brute force on small fixtures built from the test tables."""

import brute
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilscan import rules
from veilscan.operators import findings as FD
from veilscan.operators import reports as R
from veilscan.operators import tags as TG
from veilscan.plans import standins
from veilscan.session import read_table
from veilscan.sources.samples import sample_rows


def test_content_findings_equal_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    got = {r["doc_id"]: list(r["pii_types"]) for r in FD.content_findings(docs, "doc_id", "text").collect()}
    want = {}
    for r in docs.select("doc_id", "text").collect():
        t = brute.content_types(r["text"])
        if t:
            want[r["doc_id"]] = t
    assert got == want and len(got) == 8


def test_content_findings_rows_carry_class_access_and_scores(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    for r in FD.content_findings(docs, "doc_id", "text").collect():
        assert r["data_classification"] == brute.classification(list(r["pii_types"]))
        assert r["access_level"] == brute.access(r["data_classification"])
        assert dict(r["confidence"]) == {t: 0.7 for t in r["pii_types"]}


def test_head_bytes_equal_python(spark):
    texts = ["é" * 600, "a" * 1023 + "é" + "b", "😀" * 300, "ab", "", None, "x" * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    from veilscan.functions.text import head_bytes

    got = {r["id"]: r["h"] for r in df.select("id", head_bytes(F.col("t"), 1024).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else brute.head_bytes(t)), i
    docs = read_table(spark, SF_SMALL, "documents")
    rows = docs.select("text", head_bytes(F.col("text"), 1024).alias("h")).collect()
    assert all(r["h"] == brute.head_bytes(r["text"]) for r in rows)


def test_entity_merge_equals_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    pat = FD.content_findings_long(docs, "doc_id", "text")
    ents = standins.recogniser_entities(docs)
    got = {r["doc_id"]: (list(r["pii_types"]), dict(r["confidence"])) for r in FD.merge_entity_scores(pat, ents).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {}
    ent_rows = ents.orderBy("doc_id").collect()
    by_doc = {}
    for e in ent_rows:
        by_doc.setdefault(e["doc_id"], []).append((e["type"], e["score"]))
    for d, text in texts.items():
        types = brute.content_types(text)
        scores = {t: 0.7 for t in types}
        extra = []
        for et, sc in by_doc.get(d, []):
            m = rules.ENTITY_TYPE_MAP.get(et)
            if m is None:
                continue
            if m not in types and m not in extra:
                extra.append(m)
            scores[m] = max(scores.get(m, 0), sc)
        extra.sort(key=rules.CONTENT_TYPES.index)
        if types or extra:
            want[d] = (types + extra, scores)
    assert got == want


def test_scan_items_json_sampled_and_whole(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    whole = {r["table_name"]: r for r in FD.scan_items_json(docs, table_col="source").collect()}
    rows = docs.collect()
    import json

    want = {}
    counts = {}
    for r in rows:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
        js = json.dumps(r.asDict())
        want.setdefault(r["source"], set()).update(brute.content_types(js))
    want = {k: v for k, v in want.items() if v}
    assert set(whole) == set(want)
    for k, r in whole.items():
        assert set(r["pii_types"]) == want[k]
        assert list(r["pii_types"]) == [t for t in rules.CONTENT_TYPES if t in want[k]]
        assert r["item_count"] == counts[k]
    sampled = FD.scan_items_json(docs, table_col="source", key_cols=["doc_id"], max_items=2).collect()
    for r in sampled:
        assert r["item_count"] == counts[r["table_name"]]


def test_string_attributes_simple_rules(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.com", None, 3), (2, "call 555-123-4567", "x", 4), (3, "none", "123-45-6789", 5), (4, "clean", "clean", 6)],
        "id long, a string, b string, n int",
    )
    got = {r["id"]: (list(r["pii_types"]), list(r["attributes"])) for r in FD.scan_string_attributes(df, "id", "t").collect()}
    assert got == {
        1: (["EMAIL"], ["id", "a", "n"]),
        2: (["PHONE"], ["id", "a", "b", "n"]),
        3: (["SSN"], ["id", "a", "b", "n"]),
    }


def test_sample_rows_first_n_per_group(spark):
    ev = read_table(spark, SF_SMALL, "events")
    got = sample_rows(ev, 3, "event_id", group_cols=["event_type"]).collect()
    by = {}
    for r in ev.orderBy("event_id").collect():
        by.setdefault(r["event_type"], []).append(r["event_id"])
    want = sorted((t, i) for t, ids in by.items() for i in ids[:3])
    assert sorted((r["event_type"], r["event_id"]) for r in got) == want
    assert [r["event_id"] for r in sample_rows(ev, 4, "event_id").collect()] == sorted(x for ids in by.values() for x in ids)[:4]


def test_apply_tags_latest_wins_and_idempotent(spark):
    schema = "database string, table_name string, column_name string, tag_key string, tag_value string, seq long"
    existing = spark.createDataFrame([("d", "t", "c", "PIIType", "EMAIL", 1), ("d", "t", None, "PIIType", "NONE", 1)], schema)
    new = spark.createDataFrame(
        [("d", "t", "c", "PIIType", "SSN", 5), ("d", "t", "c", "PIIType", "NAME", 3), ("d", "t", None, "AccessLevel", "PUBLIC", 2)], schema
    )
    out = TG.apply_tags(existing, new)
    got = sorted((r["column_name"] or "", r["tag_key"], r["tag_value"]) for r in out.collect())
    assert got == [("", "AccessLevel", "PUBLIC"), ("", "PIIType", "NONE"), ("c", "PIIType", "SSN")]
    again = TG.apply_tags(out, new)
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, map(tuple, out.collect())))


def test_tag_definitions_and_registry_idempotent(spark):
    ex = TG.tag_definitions(spark, rules.SOURCE_TAG_DEFINITIONS)
    want = TG.tag_definitions(spark, rules.COLUMN_TAG_DEFINITIONS)
    once = TG.ensure_tag_definitions(ex, want)
    created = {(r["tag_key"], r["tag_value"]) for r in once.where("status = 'created'").collect()}
    assert created == {("PIIType", "DATE_OF_BIRTH"), ("PIIType", "AGE"), ("PIIClassification", "SENSITIVE"),
                       ("PIIClassification", "HIGHLY_SENSITIVE"), ("PIIClassification", "CONFIDENTIAL")}
    twice = TG.ensure_tag_definitions(once.select("tag_key", "tag_value"), want)
    assert twice.where("status = 'created'").count() == 0
    reg = spark.createDataFrame([("a",), ("b",)], "resource string")
    new = spark.createDataFrame([("b",), ("c",), ("c",)], "resource string")
    r = {x["resource"]: x["status"] for x in TG.register_resources(reg, new).collect()}
    assert r == {"a": "already_registered", "b": "already_registered", "c": "registered"}


def test_column_tags_counts(spark):
    df = spark.createDataFrame([("d", "t", "email"), ("d", "t", "x")], "database string, table_name string, column_name string")
    f = FD.column_name_findings(df)
    tags = TG.column_tags(f).collect()
    by = {}
    for t in tags:
        by.setdefault(t["column_name"], {})[t["tag_key"]] = t["tag_value"]
    assert by["email"] == {"PIIType": "EMAIL", "DataClassification": "MEDIUM_RISK", "AccessLevel": "CONFIDENTIAL",
                           "DataGovernance": "PII_DETECTED", "PIIClassification": "SENSITIVE"}
    assert by["x"] == {"PIIType": "NONE", "DataClassification": "NO_RISK", "AccessLevel": "PUBLIC", "DataGovernance": "PUBLIC"}


def test_table_classification_rollup(spark):
    df = spark.createDataFrame(
        [("d", "t1", "email"), ("d", "t1", "ssn"), ("d", "t2", "age"), ("d", "t3", "x")],
        "database string, table_name string, column_name string",
    )
    got = {r["table_name"]: (list(r["pii_types"]), r["data_classification"], r["access_level"], r["pii_columns"])
           for r in TG.table_classification(FD.column_name_findings(df)).collect()}
    assert got == {"t1": (["EMAIL", "SSN"], "CRITICAL_RISK", "TOP_SECRET", 2),
                   "t2": (["AGE"], "LOW_RISK", "INTERNAL", 1),
                   "t3": ([], "NO_RISK", "PUBLIC", 0)}


def test_scan_totals_definitions(spark):
    cat = spark.createDataFrame(
        [("d", "t1", None, "email", "string", 0), ("d", "t1", None, "x", "string", 1), ("d", "t2", None, "y", "int", 0)],
        "database string, table_name string, location string, column_name string, column_type string, ordinal long",
    )
    cols = FD.column_name_findings(cat)
    objs = spark.createDataFrame([Row(path="p1", pii_types=["EMAIL"], data_classification="MEDIUM_RISK")])
    items = spark.createDataFrame([Row(table_name="it", item_count=4, pii_types=["SSN"], data_classification="CRITICAL_RISK")])
    r = R.scan_totals(cat.select("database", "table_name"), cols, objs, items).first().asDict()
    assert r == {"total_sources": 4, "total_tables": 2, "total_columns": 3, "pii_columns_found": 1,
                 "no_risk_columns_found": 2, "pii_sources_found": 2, "glue_tables_scanned": 2,
                 "objects_with_pii": 1, "item_tables_with_pii": 1}
    u = R.unified_findings(cols, objs, items)
    want = {("MEDIUM_RISK", "d.t1"): 1, ("MEDIUM_RISK", "unknown"): 1, ("NO_RISK", "d.t1"): 1, ("NO_RISK", "d.t2"): 1,
            ("CRITICAL_RISK", "it"): 1}
    for summary in (R.classification_summary(u), R.classification_summary_of(cols, objs, items)):
        assert {(x["data_classification"], x["table_name"]): x["count"] for x in summary.collect()} == want
    with_pii, without = R.split_findings(u)
    assert with_pii.count() == 3 and without.count() == 2


def test_kpis_clip_and_counts(spark):
    cat = spark.createDataFrame(
        [("file", "user-profiles", "cataloged", "user_profiles_db"), ("file", "audit-trail", "cataloged", "a_db"),
         ("table", "payments", "error", rules.ITEM_TABLE_DATABASE)],
        "type string, name string, status string, database string",
    )
    cls = TG.classify_sources(cat)
    k = R.kpis(R.run_counts(cat, cls)).first().asDict()
    assert k["total_sources"] == 3 and k["cataloged_sources"] == 2 and k["uncataloged"] == 1
    assert k["pii_sources"] == 2 and k["high_risk_sources"] == 1
    assert k["compliance_score"] == 100.0  # 3 tagged / 2 PII sources, clipped
    w = R.workflow_summary(cat, cls).first().asDict()
    assert w == {"data_sources": 3, "cataloged_items": 3, "classified_sources": 3, "high_risk_sources": 1}
    assert {r["tag_key"] for r in R.tag_keys_used(cls).collect()} == set(rules.SOURCE_TAG_KEYS)
    counts = {r["pii_type"]: r["occurrences"] for r in R.pii_type_counts(cls).collect()}
    assert counts == {"EMAIL": 1, "PHONE": 1, "NAME": 1, "CREDIT_CARD": 1, "SSN": 1}


def test_adding_clean_rows_changes_nothing(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    clean = spark.createDataFrame([(10**9 + i, "plain words only", "en", "srcX", 16) for i in range(5)], docs.schema)
    a = sorted(tuple(r) for r in FD.content_findings(docs, "doc_id", "text").select("doc_id", "pii_types").collect())
    b = sorted(tuple(r) for r in FD.content_findings(docs.unionByName(clean), "doc_id", "text").select("doc_id", "pii_types").collect())
    assert a == b


ITEM_ALPHABET = list("0123456789-./()@ _aZ|\n\"\\\x01") + ["é", "ü", "٣", "😀", "ß", "x", "5"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=ITEM_ALPHABET, min_size=1, max_size=30),
                          st.text(alphabet=ITEM_ALPHABET, min_size=1, max_size=30)), min_size=15, max_size=15))
def test_item_json_scan_equals_python_json_dumps(spark, pairs):
    """Rows serialised as Python's json.dumps (ASCII escapes) give the same
    types as the Spark scan; each row is its own item table."""
    import json

    rows = [(f"t{i}", a, b, i * 101) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "tid string, a string, b string, n long")
    got = {r["table_name"]: list(r["pii_types"]) for r in FD.scan_items_json(df, table_col="tid").collect()}
    want = {}
    for tid, a, b, n in rows:
        t = brute.content_types(json.dumps({"tid": tid, "a": a, "b": b, "n": n}))
        if t:
            want[tid] = t
    assert got == want


def test_nested_strings_are_scanned(spark):
    shape = "id int, who struct<mail: string, deep: struct<ids: array<string>>>, tags array<string>, by_name map<string, string>, `odd.name` string"
    rows = [
        (1, ("jane@x.org", (["123-45-6789", None],)), ["555-123-4567"], {"4111-1111-1111-1111": "01/31/1990"}, "a@b.co"),
        (2, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, shape)
    found = {(r["column_name"], r["pii_type"]): r["rows"] for r in FD.column_content_profile({"t": df}).collect()}
    assert found == {
        ("who", "EMAIL"): 1, ("who", "SSN"): 1, ("tags", "PHONE"): 1, ("by_name", "CREDIT_CARD"): 1,
        ("by_name", "DATE_OF_BIRTH"): 1, ("odd.name", "EMAIL"): 1,
    }
    (item,) = FD.scan_items_json(df, table_name="t").collect()
    assert list(item["pii_types"]) == rules.CONTENT_TYPES
    (both,) = FD.scan_item_tables({"t": df}).collect()
    assert list(both["pii_types"]) == rules.CONTENT_TYPES and both["size_bytes"] is None and both["item_count"] == 2


def test_tables_without_strings(spark):
    numbers = spark.range(3).selectExpr("id", "array(id) as ids")
    assert FD.column_content_profile({"n": numbers}).collect() == []
    assert FD.string_values({"n": numbers}) is None
    assert FD.scan_item_tables({"n": numbers}).collect() == []


def test_one_pass_equals_the_separate_scans(spark):
    from veilscan.plans import standins

    docs = read_table(spark, SF_SMALL, "documents")
    once = FD.scan_documents_once(docs, "source", "text")
    apart = {r["table_name"]: (r["item_count"], list(r["pii_types"])) for r in FD.scan_items_json(docs, table_col="source").collect()}
    assert {r["table_name"]: (r["item_count"], list(r["pii_types"])) for r in FD.items_of_scan(once).collect()} == apart
    objects = FD.scan_objects(standins.document_objects(docs)).groupBy("data_classification").count().collect()
    counted = once.agg(*[F.sum(f"objects_{n}").alias(n) for n, _ in rules.RISK_TIERS]).first().asDict()
    assert {k: v for k, v in counted.items() if v} == {r["data_classification"]: r["count"] for r in objects}
