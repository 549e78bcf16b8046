"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from conceptloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    expected = sorted((tuple(dict(zip([c[0] for c in cursor.description], r, strict=True))[c] for c in columns) for r in cursor.fetchall()), key=repr)
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected
