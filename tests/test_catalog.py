"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from eqlake import catalog, catalog_jobs, catalog_symbolic  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 5)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cursor = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in order] for r in cursor.fetchall()), key=repr)
    have = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    assert have == want
