"""Doubles that queries share with their SQL have the same bits, so that rounding them can't tell them apart."""

import itertools

import duckdb
from pyspark.sql import functions as F

from interfera.plans.queries import r
from interfera.plans.tables import GAIN_SQL, VIS_SQL, gains, visibilities


def bits(rows, keys):
    return {tuple(x[:keys]): tuple(map(repr, x[keys:])) for x in map(tuple, rows)}


def test_gains(spark):
    want = duckdb.sql(f"WITH vis AS (SELECT 1 AS ant1, 1 AS ant2, 1 AS chan, 'PP' AS pol), {GAIN_SQL} SELECT ant, feed, chan, g_re, g_im FROM g").fetchall()
    assert bits(gains(spark).collect(), 3) == bits(want, 3)


def test_phases(spark, tmp_path):
    """Of each line number and quantity: but one cosine, whose last digit the JVM has otherwise, all are equal."""
    lines = "(SELECT CAST(a AS INT) AS a, CAST(b AS DOUBLE) AS b FROM range(1, 8) t(a), range(3, 51) u(b) WHERE b NOT IN (13, 17, 19, 23, 29))"
    row = "CAST(a * 100 + b AS BIGINT) AS l_orderkey, 11::BIGINT AS l_partkey, 9::BIGINT AS l_suppkey, a AS l_linenumber, b AS l_quantity, 10000.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1997-04-05' AS l_shipdate"
    duckdb.sql(f"COPY (SELECT {row} FROM {lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    want = bits(duckdb.sql(f"WITH lineitem AS (FROM '{tmp_path}/lineitem.parquet'), {VIS_SQL} SELECT record, re, im FROM vis").fetchall(), 1)
    got = bits(visibilities(spark, str(tmp_path)).select("record", "re", "im").collect(), 1)
    assert got.keys() == want.keys() and len(got) == 7 * 43
    assert sum(got[k] != want[k] for k in got) <= 1


def test_rounding(spark):
    """Halves, what is next to them, and values without digits to round."""
    halves = [s * (k + 0.5) / 1e6 for s, k in itertools.product((1, -1), range(2000))]
    xs = halves + [5.0000005, 1e22, -2e-7, 0.0, float("nan"), float("inf"), -float("inf"), 1e305]
    rows = list(enumerate(xs))
    db = duckdb.connect()
    db.execute("CREATE TABLE x (i BIGINT, x DOUBLE)").executemany("INSERT INTO x VALUES (?, ?)", rows)
    got = spark.createDataFrame(rows, "i long, x double").select("i", *r(F.col("x")), *r(F.col("x"), digits=5)).collect()
    assert bits(got, 1) == bits(db.sql("SELECT i, round(x, 6), round(x, 5) FROM x").fetchall(), 1)
