"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from conceptloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    expected = rows(cursor.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert expected
    assert rows([tuple(r) for r in df.collect()], df.columns) == expected
