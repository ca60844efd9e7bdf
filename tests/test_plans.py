"""Each query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from interfera.plans.all import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else 0.0 if isinstance(v, float) and v == 0 else v
    return sorted((tuple(map(clean, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(map(tuple, got.collect())) == plain(db.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall())


def test_column_priority_reads_every_event(spark, db):
    first, best = {}, {}
    for at, station, user in db.sql("SELECT event_id, event_type, user_id FROM events").fetchall():
        key = (station, user % 5, ("R", "L", "both")[at % 3])
        first[key] = min(at, first.get(key, at))
    for station in {k[0] for k in first}:
        for channel in range(1, 8):
            for pol in "RL":
                tries = [(station, c, p) for c in (channel, 0) for p in (pol, "both")]
                best[station, channel, pol] = next((first[k] for k in tries if k in first), 0)
    assert {(r.station, r.channel, r.pol): r.place for r in QUERIES["column_priority"](spark, DATA).collect()} == best


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows_alone(spark, name):
    """Solutions, which SQL can't state: a gain for each antenna, feed, channel and scan."""
    got = QUERIES[name](spark, DATA)
    scans = QUERIES["leaves"](spark, DATA).count()
    assert got.count() == scans * 7 * 2 * 7 and got.where("isnan(g_re)").count() == 0
