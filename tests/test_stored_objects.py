"""Tables written as objects or text and read back, over odd rows."""

import duckdb
import pytest

import __spark_entry__ as E

DOCUMENTS = "doc_id bigint, source string, lang string, text string"
ROWS = [
    (1, "a/b =%20ü", "en", "mail me: jane.doe@example.org"),
    (2, "a/b =%20ü", None, None),
    (3, None, "en", "first 4111 1111\n1111 1111 line\r\nand 123-45-"),
    (4, None, "de", "6789"),
    (5, "", "en", ""),
    (5, "", "en", ""),
    (None, "_hidden", "zh", "漢字 (415) 555-1234 " + "x" * 5000),
]


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
@pytest.mark.parametrize("name", ["stored_object_findings", "stored_table_stats"])
def test_stored_tables_match_duckdb(spark, tmp_path, name, rows):
    con = duckdb.connect()
    tables = {"documents": (DOCUMENTS, rows), "pages": ("page_id bigint, html string", [(1, None)]), "conversations": ("text string", [])}
    for table, (schema, values) in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = E.queries()[name](spark, str(tmp_path))
    found = sorted(map(repr, map(tuple, df.collect())))
    listed = ", ".join(df.columns)
    assert found == sorted(map(repr, con.execute(f"SELECT {listed} FROM ({E.oracle_sql()[name]})").fetchall()))
    assert name != "stored_object_findings" or len(found) == len({r[1] for r in rows})
