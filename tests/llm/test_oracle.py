"""The operators' SQL on the smallest documents, rows with oddities included."""

from __future__ import annotations

import duckdb
import pytest

from citeforge.llm.registry import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_gives_the_same_rows(spark, docs, tmp_path, name):
    keyed = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])  # the SQL takes doc_id as a key
    keyed.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))
