"""Queries of the training-data operators give what their SQL gives in DuckDB."""

import duckdb
import pytest

from eqlake.llm import oracles, queries


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_as_sql(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = db.execute(oracles.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in cursor.fetchall()), key=repr)
    have = sorted(([plain(r[c]) for c in sorted(names)] for r in df.collect()), key=repr)
    assert have == want and have
