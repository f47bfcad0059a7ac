"""Every query against its SQL twin, run by DuckDB over the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_matches_sql(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    want = con.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=str)


def test_madgwick_near_level(spark, tmp_path):
    """Accelerations near the vertical keep the slope near zero, where a last bit turns its direction: only equal arithmetic follows the SQL."""
    con = duckdb.connect()
    con.execute("create table events as select 7 + 15 * i as event_id, i as ts, 0::bigint as user_id, 50 + (i % 7 + 1) / 100 as value from range(1000) t(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = catalogue.QUERIES["flt_madgwick"](spark, str(tmp_path)).select("event_id", "roll", "pitch", "yaw").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select event_id, roll, pitch, yaw from ({catalogue.SQL['flt_madgwick']})").fetchall())


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_others_run(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
