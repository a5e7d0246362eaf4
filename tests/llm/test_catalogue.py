"""The registered queries over the smallest tables, against their SQL where there is one."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from skein.llm import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) or name == "op7_substring_dup"
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
