"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillmeter import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()]
    assert [str(r) for r in in_order(ours)] == [str(r) for r in in_order(theirs)]
