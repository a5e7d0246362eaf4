"""Every query of the engine with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from skein.plans.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events benchmark conversations labels pages".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = db.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(norm(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["raw_slop", "raw_phrase", "raw_and"])
def test_a_row_has_its_tokens_made_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(") == 1


def test_texts_are_not_joined_with_vectors(spark):
    """One join of keys with vectors, one of the two legs."""
    plan = QUERIES["hybrid_rrf"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 2
