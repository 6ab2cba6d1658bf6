"""Every registered query of the search engine against its SQL."""

import duckdb
import pytest

from gleaner import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    answer = db.execute(queries.SQL[name])
    at = [d[0] for d in answer.description]
    assert sorted(at) == cols
    assert got == sorted((tuple(norm(dict(zip(at, r, strict=True))[c]) for c in cols) for r in answer.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
