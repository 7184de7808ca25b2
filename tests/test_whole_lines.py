"""Spikes, levels and trends over every line of the tables: gaps, and spikes on days that no cut keeps."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillmeter import catalogue

#: (day of January 1996, nation, quantity, price): days 5 to 7 are a gap, the 20th is a spike.
LINES = [*((n, n % 2, 10.0 + n, 100.0 + n) for n in (1, 2, 3, 4, 8, 9, 10, 11, 12)), (20, 0, 50.0, 900.0), (21, 1, 5.0, 110.0)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("lines")
    n = len(LINES)
    made = {
        "region": {"r_regionkey": [0, 1], "r_name": ["ASIA", "EUROPE"]},
        "nation": {"n_nationkey": [0, 1], "n_name": ["INDIA", "FRANCE"], "n_regionkey": [0, 1]},
        "customer": {"c_custkey": [0, 1], "c_nationkey": [0, 1]},
        "orders": {"o_orderkey": list(range(n)), "o_custkey": [x[1] for x in LINES]},
        "part": {"p_partkey": [1], "p_brand": ["Brand#1"]},
        "lineitem": {
            "l_orderkey": list(range(n)), "l_partkey": [1] * n, "l_suppkey": [1] * n, "l_linenumber": [1] * n, "l_quantity": [x[2] for x in LINES], "l_extendedprice": [x[3] for x in LINES], "l_discount": [0.0] * n,
            "l_returnflag": ["N"] * n, "l_linestatus": ["O"] * n, "l_shipdate": pa.array([datetime.datetime(1996, 1, x[0]) for x in LINES], pa.timestamp("us")),
        },
    }
    for name, columns in made.items():
        pq.write_table(pa.table(columns), d / f"{name}.parquet")
    return str(d)


def test_whole_lines_have_their_gaps_and_spikes(spark, tables):
    rows = {name: [tuple(r) for r in catalogue.queries()[name](spark, tables).orderBy("day").collect()] for name in ("spend_spikes", "activity_levels", "trends_dense")}
    assert rows["spend_spikes"] == [("1996-01-20", 900.0, 108.0)]
    levels = {day: (tokens, level) for day, tokens, level in rows["activity_levels"]}
    assert len(levels) == 21 and levels["1996-01-06"] == (0, 0) and levels["1996-01-20"] == (150, 4) and levels["1996-01-01"] == (33, 1)
    seen = {r[0]: r[1:] for r in rows["trends_dense"]}
    assert sum(r[3] for r in seen.values()) == len(LINES) and seen["1996-01-06"] == (0, 0.0, False, False) and seen["1996-01-20"] == (150, 900.0, False, True)


def test_sql_of_whole_lines_has_no_filter(tables):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "part", "lineitem"):
        c.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    for name in ("spend_spikes", "activity_levels", "trends_dense"):
        assert "% 9" not in catalogue.oracle_sql()[name]
    assert c.execute(catalogue.oracle_sql()["spend_spikes"]).fetchall() == [("1996-01-20", 900.0, 108.0)]
