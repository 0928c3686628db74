"""Every registered query equals its DuckDB statement (sf0.001 here; the
driver checks sf0.01)."""

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from veilscan.plans.queries import QUERIES
from veilscan.session import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            vals.append(round(v, 9) if isinstance(v, float) else (int(v) if isinstance(v, bool) else v))
        out.append(repr(tuple(vals)))
    return sorted(out)


def test_every_query_has_an_oracle():
    # those of the llm subpackage that SQL cannot express are tested in tests/llm
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(df.columns, rows) == _norm(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8
    assert df.columns == ["doc_id", "pii_types", "data_classification", "access_level"]
