"""Stand-in inputs built from the test tables.

The test tables carry no SSN, phone, card or birth-date columns, no external
recogniser output and no tag change log. These builders only give rows in the
schema each job expects, derived row by row from a test table so their size
grows with it. They do none of the job's work; the jobs make no use of how
the values are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan import rules

# Recogniser entity types the stand-in emits: the five mapped ones and two
# that the merge must drop.
ENTITY_NAMES = ["EMAIL", "SSN", "PHONE", "CREDIT_DEBIT_NUMBER", "DATE_TIME", "NAME", "ADDRESS"]


def people(customer: DataFrame) -> DataFrame:
    """A person table with PII columns named so the column-name profile finds
    them: ``c_custkey, c_name, email, phone, ssn, credit_card_number,
    date_of_birth, salary, age, street_address, contact, c_nationkey, c_acctbal,
    c_mktsegment``; ``contact`` is a struct with an e-mail and a list of phones. Some values are
    NULL or empty, some SSNs/phones/cards are malformed on purpose."""
    k = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    email = (
        F.when(k % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")))
    )
    phone = (
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 3 == 0, F.concat(F.lit("("), pad(k % 1000, 3), F.lit(") "), pad(k % 900 + 100, 3), F.lit("-"), pad(k, 4)))
        .when(k % 3 == 1, F.concat(pad(k % 1000, 3), F.lit("-"), pad(k % 900 + 100, 3), F.lit("-"), pad(k % 10000, 4)))
        .otherwise(F.concat(pad(k % 1000, 3), F.lit("."), pad(k % 900 + 100, 3), F.lit("."), pad(k % 10000, 4)))
    )
    ssn = (
        F.when(k % 4 == 0, F.concat(pad(k % 1000, 3), F.lit("-"), pad(k % 100, 2), F.lit("-"), pad(k % 10000, 4)))
        .when(k % 4 == 1, F.concat(pad(k % 1000, 3), F.lit("-"), pad(k % 100, 2), F.lit("-"), pad(k % 10000, 4), F.lit("x")))
        .when(k % 4 == 2, F.concat(pad(k % 1000000000, 9), F.lit("7")))
        .otherwise(F.concat(pad(k % 100, 2), F.lit("-"), pad(k % 100, 2)))
    )
    card = (
        F.when(k % 7 == 0, pad(k % 1000, 3))
        .when(k % 2 == 0, F.concat(F.lit("4111-1111-1111-"), pad(k % 10000, 4)))
        .otherwise(F.concat(F.lit("4111 1111 1111 "), pad(k % 10000, 4)))
    )
    dob = F.concat(pad(k % 12 + 1, 2), F.lit("/"), pad(k % 28 + 1, 2), F.lit("/"), (1940 + k % 60).cast("string"))
    return customer.select(
        k.alias("c_custkey"),
        F.col("c_name"),
        email.alias("email"),
        phone.alias("phone"),
        ssn.alias("ssn"),
        card.alias("credit_card_number"),
        dob.alias("date_of_birth"),
        (30000 + (k * 37) % 90000).alias("salary"),
        (18 + k % 60).cast("int").alias("age"),
        F.concat((k % 900 + 100).cast("string"), F.lit(" Main Street")).alias("street_address"),
        F.struct(email.alias("email"), F.array(phone, F.lit("none")).alias("phones"), k.alias("id")).alias("contact"),
        F.col("c_nationkey"),
        F.col("c_acctbal"),
        F.col("c_mktsegment"),
    )


def recogniser_entities(documents: DataFrame) -> DataFrame:
    """Entities ``(doc_id, type, score)`` in the shape an external recogniser
    returns: two per document with types and scores set from the id."""
    d = F.col("doc_id")
    names = F.array(*[F.lit(n) for n in ENTITY_NAMES])
    n = len(ENTITY_NAMES)
    first = F.struct(
        F.element_at(names, (d % n + 1).cast("int")).alias("type"),
        (F.lit(0.5) + (d % 50) / F.lit(100.0)).alias("score"),
    )
    second = F.struct(
        F.element_at(names, ((d * 3 + 1) % n + 1).cast("int")).alias("type"),
        (F.lit(0.6) + (d % 37) / F.lit(100.0)).alias("score"),
    )
    return documents.select(d, F.inline(F.array(first, second)))


def tag_change_log(events: DataFrame) -> DataFrame:
    """A tag assignment log ``(database, table_name, column_name, tag_key,
    tag_value, seq)``: one assignment per event; ``column_name`` NULL is a
    table-level tag; ``seq`` is the event id."""
    keys = list(rules.COLUMN_TAG_DEFINITIONS)
    key = F.element_at(F.array(*[F.lit(x) for x in keys]), (F.col("event_id") % len(keys) + 1).cast("int"))
    u = F.col("user_id")
    value = None
    for kname, vocab in rules.COLUMN_TAG_DEFINITIONS.items():
        v = F.element_at(F.array(*[F.lit(x) for x in vocab]), (u % len(vocab) + 1).cast("int"))
        value = F.when(key == kname, v) if value is None else value.when(key == kname, v)
    column = F.when(u % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("col_"), (u % 4).cast("string")))
    return events.select(
        F.lit("app").alias("database"),
        F.col("event_type").alias("table_name"),
        column.alias("column_name"),
        key.alias("tag_key"),
        value.alias("tag_value"),
        F.col("event_id").alias("seq"),
    )


def document_objects(documents: DataFrame) -> DataFrame:
    """Documents viewed as objects: ``path, size_bytes, text``."""
    return documents.select(
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("text"),
    )
