"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("WEBLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


def check(spark, sql, query, text):
    got = query(spark, FOLDER)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if text is None:
        return
    answer = sql.execute(text)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(rows) == plain([[r[i] for i in order] for r in answer.fetchall()])


from webloom.catalogue import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    check(spark, sql, QUERIES[name], SQL.get(name))


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
