"""The relations that queries run on, derived from the tables of orders and events."""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interfera.sources.uvfits import ANTENNAS as ANTENNA_FIELDS
from interfera.sources.uvfits import SETUPS as SETUP_FIELDS
from interfera.uvset import VIS, UVSet

ANTENNAS, CHANNELS = 7, 7


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visibility of each line item: seven antennas, seven channels, four polarisations, two windows, a scan for each
    month. Some are NaN or infinite, as are some weights; others have weights under zero."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = F.col("l_suppkey") % ANTENNAS
    b = (a + 1 + F.col("l_partkey") % (ANTENNAS - 1)) % ANTENNAS
    q = F.col("l_quantity")
    phase = 37 * F.col("l_linenumber").cast("long") / F.lit(100.0) + 0.001 * q  # SQL's 0.37 is a decimal: the product has no error
    amp = F.col("l_extendedprice") / 10000.0
    pol = F.when(F.col("l_returnflag") == "A", "PP").when(F.col("l_returnflag") == "R", "QQ").when(F.col("l_linestatus") == "O", "PQ").otherwise("QP")
    scan = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    spw = F.concat(F.lit("spw_"), (F.col("l_orderkey") % 2).cast("string"))
    return rows.select(
        (F.least(a, b) + 1).cast("int").alias("ant1"), (F.greatest(a, b) + 1).cast("int").alias("ant2"),
        F.col("l_linenumber").cast("int").alias("chan"), pol.alias("pol"), scan.alias("scan"), F.col("l_shipdate").cast("timestamp").alias("ts"), spw.alias("spw"),
        F.concat(F.lit("3C"), (scan % 5).cast("string")).alias("source_name"), F.concat(F.lit("scan_"), scan.cast("string")).alias("partition_key"),
        F.when(q == 13, nan).otherwise(amp * F.cos(phase)).alias("re"), F.when(q == 23, inf).otherwise(amp * F.sin(phase)).alias("im"),
        F.when(q < 3, -1.0).when(q == 17, nan).when(q == 19, inf).otherwise(q).alias("w"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 20011 + F.col("l_partkey")) * 1009 + F.col("l_suppkey")).cast("long").alias("record"), F.pmod(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 3.6e9, F.lit(700.0)).alias("ti"),
        F.exp(F.col("l_tax")).alias("u"), F.when(q == 29, nan).otherwise(F.exp(F.col("l_discount"))).alias("v"), F.sin("l_quantity").alias("uw"),
    )


def gains(spark: SparkSession) -> DataFrame:
    """Gains by antenna, feed and channel; one is NaN, one zero and one missing."""
    # 98 rows, whatever the input; made here, as exp() of the JVM and of SQL differ in the last digit
    rows = [r for r in itertools.product(range(1, ANTENNAS + 1), (1, 2), range(1, CHANNELS + 1)) if r != (6, 2, 7)]
    special = {(3, 2, 5): math.nan, (4, 1, 2): 0.0}
    amp = [special.get((a, f, c), math.exp((5 * a + c + 2 * f) / 100)) for a, f, c in rows]
    phase = [(10 * a - 3 * c * f) / 100 for a, f, c in rows]
    columns = [pa.array(x, pa.int32()) for x in zip(*rows)] + [pa.array([g * part(p) for g, p in zip(amp, phase)]) for part in (math.cos, math.sin)]
    return spark.createDataFrame(pa.table(columns, names=["ant", "feed", "chan", "g_re", "g_im"]))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series of system temperatures from events: station, t (seconds), value (some NaN), event_id, user_id."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    return rows.select(F.col("event_type").alias("station"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), value.alias("value"), "event_id", "user_id")


RDATE = "2024-01-01"
#: Stations of the antennas: kinds of events, and two without calibration.
STATIONS = ["view", "signup", "error", "click", "purchase", "none_1", "none_2"]


def uvset(spark: SparkSession, sf_dir: str) -> UVSet:
    """The visibilities as a set: a partition for each source, window and scan, a record for each line item."""
    vis = visibilities(spark, sf_dir).drop("partition_key").withColumn("scan_name", F.col("scan").cast("string"))
    vis = vis.withColumn("partition_key", F.concat(F.lit("M"), "source_name", F.lit("_"), "spw", F.lit("_scan_"), "scan_name"))
    described = vis.groupBy("partition_key", "source_name", "scan_name", "spw").agg(F.min("record").alias("leaf_ord"))
    described = described.select("partition_key", "leaf_ord", "source_name", "scan_name", "spw", (F.substring("spw", 5, 9).cast("int") + 1).alias("spw_index"), F.lit(1).alias("subarray"), F.lit("").alias("sub_scan_name"), F.lit("").alias("intent"), F.lit(83.6).alias("ra"), F.lit(22.0).alias("dec"))
    records = vis.select("partition_key", "record", "ti", "ant1", "ant2", "u", "v", "uw", F.create_map().cast("map<string, array<double>>").alias("extras"))
    places = [(1, a + 1, n, 6.37e6 * math.cos(a) * math.cos(0.1 * a), 6.37e6 * math.sin(a) * math.cos(0.1 * a), 6.35e6 * math.sin(0.1 * a), 1, 0, 0.0, "R", "L", 0.0, 0.0) for a, n in enumerate(STATIONS)]
    setups = [(f"spw_{k}", k + 1, 1e9, [1e9 + 10.0 * k + c for c in range(CHANNELS)], [1.0] * CHANNELS, [1.0] * CHANNELS, [1.0] * CHANNELS) for k in range(2)]
    return UVSet(vis.select(*(f.split()[0] for f in VIS.split(", "))), records, described, spark.createDataFrame(places, ANTENNA_FIELDS), spark.createDataFrame(setups, SETUP_FIELDS), {"rdate": RDATE})


VIS_SQL = f"""raw_vis AS (SELECT *, l_suppkey % {ANTENNAS} AS a_, (l_suppkey % {ANTENNAS} + 1 + l_partkey % {ANTENNAS - 1}) % {ANTENNAS} AS b_ FROM lineitem),
vis AS (SELECT *, w > 0 AND isfinite(w) AS ok, w > 0 AND isfinite(w) AND isfinite(re) AS ok1, w > 0 AND isfinite(w) AND isfinite(re) AND isfinite(im) AS ok2 FROM (
 SELECT CAST(least(a_, b_) + 1 AS INT) AS ant1, CAST(greatest(a_, b_) + 1 AS INT) AS ant2, CAST(l_linenumber AS INT) AS chan,
 CASE WHEN l_returnflag = 'A' THEN 'PP' WHEN l_returnflag = 'R' THEN 'QQ' WHEN l_linestatus = 'O' THEN 'PQ' ELSE 'QP' END AS pol,
 CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS scan, l_shipdate AS ts, 'spw_' || CAST(l_orderkey % 2 AS VARCHAR) AS spw,
 '3C' || CAST((year(l_shipdate) * 100 + month(l_shipdate)) % 5 AS VARCHAR) AS source_name, 'scan_' || CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) AS partition_key,
 CASE WHEN l_quantity = 13 THEN 'nan'::DOUBLE ELSE l_extendedprice / 10000.0 * cos(0.37 * l_linenumber + 0.001 * l_quantity) END AS re,
 CASE WHEN l_quantity = 23 THEN 'inf'::DOUBLE ELSE l_extendedprice / 10000.0 * sin(0.37 * l_linenumber + 0.001 * l_quantity) END AS im,
 CASE WHEN l_quantity < 3 THEN -1.0 WHEN l_quantity = 17 THEN 'nan'::DOUBLE WHEN l_quantity = 19 THEN 'inf'::DOUBLE ELSE l_quantity END AS w,
 CAST(((l_orderkey * 8 + l_linenumber) * 20011 + l_partkey) * 1009 + l_suppkey AS BIGINT) AS record, (epoch_us(l_shipdate) / 3.6e9) % 700.0 AS ti,
 exp(l_tax) AS u, CASE WHEN l_quantity = 29 THEN 'nan'::DOUBLE ELSE exp(l_discount) END AS v, sin(l_quantity) AS uw FROM raw_vis))"""

GAIN_SQL = f"""g AS (SELECT ant, feed, chan, amp * cos(0.1 * ant - 0.03 * chan * feed) AS g_re, amp * sin(0.1 * ant - 0.03 * chan * feed) AS g_im FROM (SELECT CAST(a AS INT) AS ant, CAST(f AS INT) AS feed, CAST(c AS INT) AS chan,
 CASE WHEN a = 3 AND f = 2 AND c = 5 THEN 'nan'::DOUBLE WHEN a = 4 AND f = 1 AND c = 2 THEN 0.0 ELSE exp(0.05 * a + 0.01 * c + 0.02 * f) END AS amp
 FROM range(1, {ANTENNAS + 1}) t(a), range(1, 3) u(f), range(1, {CHANNELS + 1}) x(c)) WHERE NOT (ant = 6 AND feed = 2 AND chan = 7)),
vg AS (SELECT v.*, a.g_re AS ar, a.g_im AS ai, b.g_re AS br, b.g_im AS bi, a.g_re * b.g_re + a.g_im * b.g_im AS kr, a.g_im * b.g_re - a.g_re * b.g_im AS ki
 FROM vis v LEFT JOIN g a ON a.ant = ant1 AND a.chan = v.chan AND a.feed = CASE WHEN substr(pol, 1, 1) = 'P' THEN 1 ELSE 2 END
 LEFT JOIN g b ON b.ant = ant2 AND b.chan = v.chan AND b.feed = CASE WHEN substr(pol, 2, 1) = 'P' THEN 1 ELSE 2 END)"""

#: Over ``vg``: ``model``, whether the sample and its gains are fit for sums of the solver.
MODEL_SQL = "(ok2 AND coalesce(isfinite(kr * kr + ki * ki) AND kr * kr + ki * ki > 0, false))"
CALIBRATION_SQL = "cal AS (SELECT event_type AS station, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS value, event_id, user_id FROM events)"
