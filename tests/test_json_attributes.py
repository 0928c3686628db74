"""Attributes inside JSON text against a walk of the parsed text in Python."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from veilscan.operators.json_attributes import json_attributes, json_leaves, nesting


def walk(value, path="$"):
    if isinstance(value, dict) and value:
        for key, child in value.items():
            plain = key.isascii() and key.replace("_", "a").isalnum() and not key[0].isdigit()
            yield from walk(child, path + (f".{key}" if plain else "['" + key.replace("'", "''") + "']"))
    elif isinstance(value, list) and value:
        for child in value:
            yield from walk(child, path + "[]")
    else:
        yield path, value


def kind(value):
    if isinstance(value, bool):
        return "BOOLEAN"
    return {dict: "OBJECT", list: "ARRAY", str: "STRING", int: "BIGINT", type(None): "VOID", float: "DECIMAL"}[type(value)]


def random_value(rng, level):
    roll = rng.random()
    if level < 4 and roll < 0.35:
        return {k: random_value(rng, level + 1) for k in rng.sample(["a", "email", "odd key", "q'x", "_z", "1st", "é"], rng.randrange(4))}
    if level < 4 and roll < 0.55:
        return [random_value(rng, level + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 7, -3, 2.5, "", "{[", 'quote " and \\', "x@y.org", "123-45-6789", "née"])


def test_leaves_are_those_of_a_walk(spark):
    rng = random.Random(4)
    values = [random_value(rng, 0) for _ in range(200)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5) for v in values]
    df = spark.createDataFrame([(t,) for t in texts], "j string").repartition(3)
    want = Counter((path, kind(leaf)) for v in values for path, leaf in walk(v))
    found = {(r.path, r.value_type): r["n"] for r in json_leaves(df, "j").groupBy("path", "value_type").agg(F.count("*").alias("n")).collect()}
    assert found == want
    strings = Counter(leaf for v in values for _, leaf in walk(v) if isinstance(leaf, str))
    assert Counter(r.value for r in json_leaves(df, "j").where("value_type = 'STRING'").collect()) == strings


def test_malformed_null_empty_and_repeated_texts(spark):
    texts = [None, "", "{", '{"a": 1, "a": 2}', "call 123-45-6789", '{"email": "x@y.org"}', '{"email": "x@y.org"}', '{"email": null}', "[]", "5"]
    df = spark.createDataFrame([(t, 1) for t in texts], "path string, name int").selectExpr("path as `j.x`", "path", "name")
    rows = {(r.path, r.value_type): r for r in json_attributes(df, "j.x").collect()}
    counts = {k: (r["values"], r.hits, r.pii_types) for k, r in rows.items()}
    assert counts == {
        ("$", "MALFORMED"): (4, 1, ["SSN"]),
        ("$.email", "STRING"): (2, 2, ["EMAIL"]),
        ("$.email", "VOID"): (1, 0, []),
        ("$", "ARRAY"): (1, 0, []),
        ("$", "BIGINT"): (1, 0, []),
    }
    assert rows["$.email", "VOID"].name_types == ["EMAIL"]
    assert rows["$.email", "VOID"].data_classification == rows["$.email", "STRING"].data_classification != rows["$", "ARRAY"].data_classification
    assert json_attributes(df.limit(0), "j.x").collect() == []


def test_depth_and_long_arrays(spark):
    deep = '{"a":' * 12 + "1" + "}" * 12
    wide = json.dumps({"rows": [{"ssn": "123-45-6789"}] * 20000})
    df = spark.createDataFrame([(deep,), (wide,), ('"[[[[[["',)], "j string")
    assert [r[0] for r in df.select(nesting(F.col("j"))).collect()] == [12, 3, 0]
    rows = {r.path: (r["values"], r.hits) for r in json_attributes(df, "j").collect()}
    assert rows == {"$" + ".a" * 12: (1, 0), "$.rows[].ssn": (20000, 20000), "$": (1, 0)}


def test_plan_has_one_shuffle_and_no_python(spark):
    df = spark.createDataFrame([('{"a": [1]}',)], "j string")
    plan = json_attributes(df, "j", depth=3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange ") == 1 and "Python" not in physical and "Join" not in physical
