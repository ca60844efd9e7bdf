"""Queries of whole sets: what they hold, their parts, functions of partitions, calibration, solutions and files."""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from interfera.functions import astro
from interfera.functions.cplx import finite, sampled
from interfera.operators import apriori
from interfera.plans.queries import query, r
from interfera.plans.tables import ANTENNAS, CALIBRATION_SQL, CHANNELS, RDATE, STATIONS, VIS_SQL, calibration, uvset
from interfera.solver import bandpass
from interfera.solver.models import Feed, Spec, Station
from interfera.sources import uvfits
from interfera.uvset import UVSet, band_center, centered, fingerprint

_KEY = "'M' || source_name || '_' || spw || '_scan_' || CAST(scan AS VARCHAR)"
_NAMES = "nm AS (SELECT a AS ant, ([" + ", ".join(f"'{n}'" for n in STATIONS) + "])[a] AS name FROM (SELECT CAST(unnest(range(1, 8)) AS INT) AS a))"
_SET = f"{VIS_SQL}, {_NAMES}, u AS (SELECT {_KEY} AS key, vis.*, n1.name || '-' || n2.name AS label FROM vis JOIN nm n1 ON n1.ant = ant1 JOIN nm n2 ON n2.ant = ant2), lv AS (SELECT key, source_name, spw, CAST(scan AS VARCHAR) AS scan_name, min(record) AS leaf_ord FROM u GROUP BY ALL)"


def set_query(name: str, sql: str | None = None):
    """A query of the set; SQL over u (samples with key and label) and lv (partitions)."""

    def add(f):
        query(name, None if sql is None else f"WITH {_SET}{', ' + sql[5:] if sql.startswith('WITH ') else ' ' + sql}", vis=False)(lambda spark, sf_dir: f(uvset(spark, sf_dir)))
        return f

    return add


@set_query("leaves", "SELECT key AS partition_key, leaf_ord, source_name, spw, scan_name FROM lv")
def _(u: UVSet):
    return u.leaves().select("partition_key", "leaf_ord", "source_name", "spw", "scan_name")


@set_query("sources_in_order", "SELECT source_name, min(leaf_ord) AS first_leaf FROM lv GROUP BY ALL")
def _(u: UVSet):
    return u.sources()


@set_query("scan_ids", "SELECT leaf_ord, scan_name FROM lv WHERE source_name = '3C1'")
def _(u: UVSet):
    return u.scan_ids("3C1")


@set_query("n_scans", "SELECT count(DISTINCT scan_name) AS n_scans FROM lv")
def _(u: UVSet):
    return u.n_scans()


@set_query("uv_counters", "SELECT count(DISTINCT (ant1, ant2)) AS n_baselines, count(*) AS n_integrations, count(DISTINCT chan) AS n_channels, count(DISTINCT pol) AS n_pols FROM u")
def _(u: UVSet):
    return u.counters()


@set_query("uv_summary", "SELECT key AS partition_key, count(DISTINCT chan) AS n_chan, count(DISTINCT ti) AS n_time, count(DISTINCT (ant1, ant2)) AS n_baseline, count(DISTINCT pol) AS n_pol, count(*) AS n_record FROM u GROUP BY ALL")
def _(u: UVSet):
    return u.summary().select("partition_key", "n_chan", "n_time", "n_baseline", "n_pol", "n_record")


@set_query("uv_windows", "SELECT key AS partition_key, round(min(ti), 6) AS lo, round(max(ti), 6) AS hi, round((min(ti) + max(ti)) / 2, 6) AS center FROM u GROUP BY ALL")
def _(u: UVSet):
    return u.scan_windows().select("partition_key", *r("lo", "hi", "center"))


@set_query("uv_baselines", "SELECT key AS partition_key, label, row_number() OVER (PARTITION BY key ORDER BY ant1, ant2) AS slot FROM (SELECT DISTINCT key, label, ant1, ant2 FROM u)")
def _(u: UVSet):
    return u.baselines().select("partition_key", "label", F.col("slot").cast("long").alias("slot"))


@set_query("baseline_index", "WITH b AS (SELECT key, label, row_number() OVER (PARTITION BY key ORDER BY ant1, ant2) AS slot FROM (SELECT DISTINCT key, label, ant1, ant2 FROM u)) SELECT key AS partition_key, slot FROM b WHERE label = 'view-error'")
def _(u: UVSet):
    return u.baseline_index(("view", "error")).select("partition_key", F.col("slot").cast("long").alias("slot"))


@set_query("union_baselines", "SELECT ant1, ant2, label, row_number() OVER (ORDER BY ant1, ant2) AS slot FROM (SELECT DISTINCT ant1, ant2, label FROM u)")
def _(u: UVSet):
    return u.union_baselines().select("ant1", "ant2", "label", F.col("slot").cast("long").alias("slot"))


@set_query("uv_participants", "SELECT key AS partition_key, string_agg(name, ',' ORDER BY name) AS antennas FROM (SELECT key, n.name FROM u JOIN nm n ON n.ant = ant1 UNION SELECT key, n.name FROM u JOIN nm n ON n.ant = ant2) GROUP BY key")
def _(u: UVSet):
    return u.participating_antennas().select("partition_key", F.array_join("antennas", ",").alias("antennas"))


@set_query("frequency_axis", "SELECT spw, min(leaf_ord) AS first_leaf, 1e9 + 10.0 * CAST(substr(spw, 5) AS INT) + 3.0 AS center, -3.0::DOUBLE AS lowest FROM lv GROUP BY ALL")
def _(u: UVSet):
    return u.union_frequency_axis().select("spw", "first_leaf", band_center(F.col("freqs")).alias("center"), F.element_at(centered(F.col("freqs")), 1).alias("lowest"))


@set_query("uv_antennas", "SELECT name, ant FROM nm")
def _(u: UVSet):
    return u.union_antennas().select("name", "ant")


@set_query("uv_by_spw", "SELECT spw, len(list(key)) AS n, (list(key ORDER BY leaf_ord, key))[1] AS first FROM lv GROUP BY ALL")
def _(u: UVSet):
    return u.by_spw().select("spw", F.size("keys").cast("long").alias("n"), F.element_at("keys", 1).alias("first"))


_COUNT = "key AS partition_key, count(*) AS n, count(DISTINCT (ant1, ant2)) AS n_baseline"


def _counted(u: UVSet) -> DataFrame:
    out = u.vis.groupBy("partition_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ant1", "ant2").alias("n_baseline"))
    return u.partitions.select("partition_key").join(out, "partition_key")


@set_query("uv_select_station", f"SELECT {_COUNT} FROM u WHERE ant1 = 3 OR ant2 = 3 GROUP BY ALL")
def _(u: UVSet):
    return _counted(u.select_station("error"))


@set_query("uv_select_baseline", f"SELECT {_COUNT} FROM u WHERE label = 'signup-click' GROUP BY ALL")
def _(u: UVSet):
    return _counted(u.select_baseline("signup-click"))


@set_query("uv_time_window", f"SELECT {_COUNT} FROM u WHERE ti BETWEEN 100 AND 250 GROUP BY ALL")
def _(u: UVSet):
    return _counted(u.time_window(100, 250))


@set_query("uv_select_partition", f"SELECT {_COUNT} FROM u WHERE source_name = '3C4' AND spw = 'spw_1' GROUP BY ALL")
def _(u: UVSet):
    return _counted(u.select_partition(source_name="3C4", spw="spw_1", intent=None))


@set_query("uv_baseline", "SELECT key AS partition_key, leaf_ord, ti, pol, chan, round(re, 6) AS re, w <= 0 AS flag FROM u JOIN lv USING (key) WHERE label = 'view-purchase'")
def _(u: UVSet):
    return u.baselines_per_scan("view-purchase").select("partition_key", "leaf_ord", "ti", "pol", "chan", *r("re"), "flag")


@set_query("uv_with_visibilities", "SELECT pol, count(*) FILTER (w - 20 <= 0 AND NOT isnan(w)) AS flagged, count(*) AS n FROM u GROUP BY pol")
def _(u: UVSet):
    changed = u.with_visibilities(u.vis.withColumn("w", F.col("w") - 20))
    return changed.flags().groupBy("pol").agg(F.sum(F.col("flag").cast("long")).alias("flagged"), F.count(F.lit(1)).alias("n"))


_DATA = """pt AS (SELECT key, spw, min(ti) AS lo, max(ti) AS hi FROM u GROUP BY ALL), sl AS (SELECT *, CAST(row_number() OVER (PARTITION BY spw ORDER BY lo, key) - 1 AS INT) AS slot, (lo + hi) / 2 AS center FROM pt),
da AS (SELECT key, ant1, ant2, pol, chan, coalesce(sum(w) FILTER (ok1), 0.0) AS w, coalesce(sum(w * re) FILTER (ok1) / sum(w) FILTER (ok1), 'nan'::DOUBLE) AS re FROM u GROUP BY ALL)"""


def _dataset(u: UVSet) -> DataFrame:
    return bandpass.dataset(u.vis, u.partitions)


@set_query("uv_dataset", f"WITH {_DATA} SELECT sl.spw, slot, round(center, 5) AS center, ant1, ant2, pol, chan, round(re, 6) AS re, round(w, 6) AS w FROM da JOIN sl USING (key)")
def _(u: UVSet):
    return _dataset(u).select("spw", "slot", *r("center", digits=5), "ant1", "ant2", "pol", "chan", *r("re", "w"))


@set_query("uv_average", f"WITH {_DATA} SELECT key AS partition_key, ant1, ant2, pol, chan, round(w, 6) AS w, round(center, 5) AS ti FROM da JOIN sl USING (key)")
def _(u: UVSet):
    return u.average().vis.select("partition_key", "ant1", "ant2", "pol", "chan", *r("w"), *r("ti", digits=5))


@set_query("apply", "SELECT pol, chan, count(*) AS n, round(sum(2 * re) FILTER (ok2), 3) AS re FROM u GROUP BY ALL")
def _(u: UVSet):
    twice = u.apply(lambda leaf, info: leaf.assign(re=leaf["re"] * 2))
    return twice.vis.groupBy("pol", "chan").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(sampled(im="im"), F.col("re"))), 3).alias("re"))


@set_query("mapleaves", "SELECT key AS partition_key, count(*) AS n, max(chan) AS top, lv.spw || '/2024-01-01' AS what FROM u JOIN lv USING (key) GROUP BY ALL")
def _(u: UVSet):
    rows = u.mapleaves(lambda leaf, info, root: {"n": len(leaf), "top": int(leaf["chan"].max()), "what": f"{info['spw']}/{root['rdate']}"}, "n bigint, top int, what string")
    return rows.select("partition_key", "n", "top", "what")


@set_query("flatmap", "SELECT key AS partition_key, ant1, count(*) AS n FROM u GROUP BY ALL")
def _(u: UVSet):
    rows = u.flatmap(lambda leaf: [{"ant1": int(a), "n": len(x)} for a, x in leaf.groupby("ant1")], "ant1 int, n bigint")
    return rows.select("partition_key", "ant1", "n")


@query("fingerprint", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL", vis=False)
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("print", fingerprint("p_brand", "p_size"))
    return part.groupBy("print").agg(F.first("p_brand").alias("p_brand"), F.first("p_size").alias("p_size"), F.count(F.lit(1)).alias("n")).drop("print")


# --- calibration -----------------------------------------------------------------------------------------------------

_MIDNIGHT = 2460310.5  # Julian date of RDATE
_PLACES = ", ".join(f"({a + 1}, '{n}')" for a, n in enumerate(STATIONS))
_ELEVATION = f"""xy AS (SELECT ant, name, 6.37e6 * cos(a) * cos(0.1 * a) AS x, 6.37e6 * sin(a) * cos(0.1 * a) AS y, 6.35e6 * sin(0.1 * a) AS z FROM (SELECT CAST(ant AS INT) AS ant, name, (ant - 1)::DOUBLE AS a FROM (VALUES {_PLACES}) t(ant, name))),
gd AS (SELECT *, atan2(y, x) AS lon, atan2(z + ep2 * b * pow(sin(t), 3), p - e2 * 6378137.0::DOUBLE * pow(cos(t), 3)) AS lat FROM (SELECT *, atan2(z * 6378137.0::DOUBLE, p * b) AS t FROM (SELECT *, sqrt(x * x + y * y) AS p, 6378137.0::DOUBLE * (1 - f) AS b, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep2 FROM (SELECT *, 1 / 298.257223563::DOUBLE AS f FROM xy)))),
tm AS (SELECT DISTINCT ti, {_MIDNIGHT}::DOUBLE + ti / 24 - 2451545.0 AS d FROM u),
hr AS (SELECT ti, ant, name, lat, radians((280.46061837::DOUBLE + 360.98564736629::DOUBLE * d + 0.000387933::DOUBLE * (d / 36525) * (d / 36525) - pow(d / 36525, 3) / 38710000.0) % 360.0) + lon - radians(83.6::DOUBLE) AS h FROM tm, gd),
el AS (SELECT ti, ant, name, degrees(asin(greatest(least(sin(lat) * sin(radians(22.0::DOUBLE)) + cos(lat) * cos(radians(22.0::DOUBLE)) * cos(h), 1.0), -1.0))) AS el FROM hr)"""


@set_query("elevation", f"WITH {_ELEVATION} SELECT ti, ant, round(el, 5) AS elevation FROM el")
def _(u: UVSet):
    times = u.vis.select("ti").distinct().join(F.broadcast(u.antennas.select("ant", "x", "y", "z")))  # seven antennas for each time
    el = astro.elevation(F.col("x"), F.col("y"), F.col("z"), F.radians(F.lit(83.6)), F.radians(F.lit(22.0)), apriori.julian(F.col("ti"), RDATE))
    return times.select("ti", "ant", F.round(F.degrees(el), 5).alias("elevation"))


@set_query("observation_times", f"SELECT DISTINCT ti, {_MIDNIGHT} + round(ti / 24.0, 6) AS jd, epoch_ms(TIMESTAMP '2024-01-01') + CAST(round(ti * 3600000) AS BIGINT) AS ms FROM u")
def _(u: UVSet):
    return u.vis.select("ti").distinct().select("ti", (F.round(apriori.julian(F.col("ti"), RDATE) - _MIDNIGHT, 6) + _MIDNIGHT).alias("jd"), F.unix_millis(apriori.instant(F.col("ti"), RDATE)).alias("ms"))


def _curves(spark: SparkSession) -> DataFrame:
    """Gain curves of the stations that have any."""
    return spark.createDataFrame([(n, math.exp(0.1 * i - 2), math.exp(0.1 * i - 1.5), [1.0, 0.002 * i]) for i, n in enumerate(STATIONS[:5])], "station string, dpfu_1 double, dpfu_2 double, poly array<double>")


def _temps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of system temperatures: four for channels 1 to 4 in R, L or both, and three for all channels."""
    rows = calibration(spark, sf_dir)
    pol = F.when(F.col("user_id") % 3 == 0, "R").when(F.col("user_id") % 3 == 1, "L").otherwise("both")
    channel = (F.col("user_id") % 5).cast("int")
    return rows.select("station", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), (channel * 3 + F.col("user_id") % 3 + 1).cast("long").alias("at"), channel.alias("channel"), pol.alias("pol"), F.abs("value").alias("value"))


_GAINS = f"""{CALIBRATION_SQL}, {_ELEVATION}, tc AS (SELECT station, t, abs(value) AS value, CAST(user_id % 5 AS INT) AS channel, CASE user_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'L' ELSE 'both' END AS pol FROM cal),
cv AS (SELECT name AS station, exp(0.1 * (ant - 1) - 2) AS d1, exp(0.1 * (ant - 1) - 1.5) AS d2, 0.002 * (ant - 1) AS p1 FROM xy WHERE ant <= 5),
wn AS (SELECT key, epoch_ms(TIMESTAMP '2024-01-01') / 1000 + round(min(ti) * 3600000) / 1000 AS lo, epoch_ms(TIMESTAMP '2024-01-01') / 1000 + round(max(ti) * 3600000) / 1000 AS hi FROM u GROUP BY key),
mn AS (SELECT key, station, channel, pol, avg(value) FILTER (isfinite(value)) AS tsys FROM wn JOIN tc ON t BETWEEN lo AND hi GROUP BY ALL), hs AS (SELECT DISTINCT station, channel, pol FROM tc),
pk AS (SELECT s.station, c.chan, f.feed, first(hs.channel ORDER BY hs.channel = 0, hs.pol = 'both') AS channel, first(hs.pol ORDER BY hs.channel = 0, hs.pol = 'both') AS pol
 FROM (SELECT DISTINCT station FROM tc) s CROSS JOIN (SELECT CAST(unnest(range(1, {CHANNELS + 1})) AS INT) AS chan) c CROSS JOIN (SELECT CAST(unnest(range(1, 3)) AS INT) AS feed) f
 JOIN hs ON hs.station = s.station AND hs.channel IN (c.chan, 0) AND hs.pol IN (CASE f.feed WHEN 1 THEN 'R' ELSE 'L' END, 'both') GROUP BY ALL),
kt AS (SELECT DISTINCT key, ti FROM u), fc AS (SELECT CAST(unnest(range(1, 3)) AS INT) AS feed), cc AS (SELECT CAST(unnest(range(1, {CHANNELS + 1})) AS INT) AS chan),
ga AS (SELECT kt.key, kt.ti, el.ant, fc.feed, cc.chan, cv.station IS NULL AS missing, CASE WHEN cv.station IS NULL THEN 'nan'::DOUBLE ELSE el.el END AS elevation,
 CASE WHEN cv.station IS NOT NULL AND coalesce(mn.tsys > 0 AND isfinite(mn.tsys), false) AND 1 + p1 * el.el > 0 THEN mn.tsys / (CASE fc.feed WHEN 1 THEN d1 ELSE d2 END * (1 + p1 * el.el)) ELSE 'nan'::DOUBLE END AS sefd
 FROM kt JOIN el USING (ti) CROSS JOIN fc CROSS JOIN cc LEFT JOIN cv ON cv.station = el.name LEFT JOIN pk ON pk.station = el.name AND pk.chan = cc.chan AND pk.feed = fc.feed LEFT JOIN mn ON mn.key = kt.key AND mn.station = el.name AND mn.channel = pk.channel AND mn.pol = pk.pol)"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apriori.apriori_gains(uvset(spark, sf_dir), _curves(spark), _temps(spark, sf_dir), on_missing="ignore")


@query("apriori_gains", f"WITH {_SET}, {_GAINS} SELECT key AS partition_key, ant, feed, chan, count(*) AS n, round(avg(elevation), 4) AS elevation, round(avg(sefd), 2) AS sefd FROM ga GROUP BY ALL", vis=False)
def _(spark, sf_dir):
    return _gains(spark, sf_dir).groupBy("partition_key", "ant", "feed", "chan").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("elevation"), 4).alias("elevation"), F.round(F.avg("sefd"), 2).alias("sefd"))


@query("missing_station", f"WITH {_NAMES} SELECT name FROM nm WHERE ant > 5", vis=False)
def _(spark, sf_dir):
    return apriori.missing_stations(uvset(spark, sf_dir), _curves(spark))


@query("apply_apriori", f"""WITH {_SET}, {_GAINS}, gg AS (SELECT key, ti, ant, feed, chan, CASE WHEN missing THEN 1.0 ELSE 1 / sqrt(sefd) END AS g FROM ga),
ap AS (SELECT u.key, u.record, u.pol, u.chan, u.re, u.w, u.ok, a.g AS ga, b.g AS gb FROM u JOIN gg a ON a.key = u.key AND a.ti = u.ti AND a.ant = ant1 AND a.chan = u.chan AND a.feed = CASE WHEN substr(pol, 1, 1) = 'P' THEN 1 ELSE 2 END
 JOIN gg b ON b.key = u.key AND b.ti = u.ti AND b.ant = ant2 AND b.chan = u.chan AND b.feed = CASE WHEN substr(pol, 2, 1) = 'P' THEN 1 ELSE 2 END),
va AS (SELECT key, pol, chan, CASE WHEN ok AND isfinite(ga) AND isfinite(gb) THEN re / (ga * gb) ELSE re END AS re, CASE WHEN ok AND isfinite(ga) AND isfinite(gb) THEN w * ga * gb * ga * gb WHEN ok THEN 0.0 ELSE w END AS w FROM ap)
SELECT key AS partition_key, pol, chan, count(*) AS n, count(*) FILTER (w = 0) AS n_flagged, round(sum(re) FILTER (isfinite(re)), 1) AS re, round(sum(w) FILTER (isfinite(w)), 6) AS w FROM va GROUP BY ALL""", vis=False)  # fmt: skip
def _(spark, sf_dir):
    out = apriori.apply_calibration(uvset(spark, sf_dir), _curves(spark), _temps(spark, sf_dir), on_missing="ignore")
    add = lambda c: F.sum(F.when(finite(F.col(c)), F.col(c)))
    return out.vis.groupBy("partition_key", "pol", "chan").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("w") == 0).cast("long")).alias("n_flagged"), F.round(add("re"), 1).alias("re"), F.round(add("w"), 6).alias("w"))


# --- records and scans -----------------------------------------------------------------------------------------------

_RECORDS = "rc AS (SELECT event_id AS record, epoch_us(ts) / 3.6e9 % 720.0 AS ti, CAST(user_id % 3 AS INT) * 10 + 5 AS freqsel FROM events)"
_NX = "nx AS (SELECT CAST(i + 1 AS INT) AS row, i * 24.0 + (i % 3) AS lower, i * 24.0 + 9 + (i % 5) AS upper, n, i * n // 30 + 1 AS first, (i + 1) * n // 30 AS last FROM range(30) t(i), (SELECT count(*) AS n FROM events))"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 % 720.0
    return events.select(F.col("event_id").alias("record"), hours.alias("ti"), ((F.col("user_id") % 3).cast("int") * 10 + 5).alias("freqsel"))


def _scans(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(i + 1, i * 24.0 + i % 3, i * 24.0 + 9 + i % 5, 1, 1, i * n // 30 + 1, (i + 1) * n // 30) for i in range(30)], uvfits.NX)


@query("record_scan_range", f"WITH {_NX}, z AS (SELECT event_id AS record, row_number() OVER (ORDER BY event_id) AS p FROM events) SELECT record, row FROM z JOIN nx ON p BETWEEN first AND last", vis=False)
def _(spark, sf_dir):
    records = _records(spark, sf_dir)
    n = records.count()
    # the place of a record by its id, as a file's records have; ids have no gaps of note
    placed = records.withColumn("id_", F.col("record")).withColumn("part_", F.floor(F.col("record") / 65536))
    sizes = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("c_"))
    before = sizes.withColumn("b_", F.coalesce(F.sum("c_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for 65,536 ids
    placed = placed.join(before, "part_").withColumn("record", F.row_number().over(W.partitionBy("part_").orderBy("id_")) - 1 + F.col("b_"))
    return uvfits.by_ranges(placed, _scans(spark, n)).select(F.col("id_").alias("record"), "row")


@query("record_scan_time", f"""WITH {_RECORDS}, {_NX}, s AS (SELECT *, row_number() OVER (ORDER BY lower, row) AS pos FROM nx), t AS (SELECT DISTINCT ti FROM rc), a AS (SELECT ti, (SELECT count(*) FROM s WHERE lower <= ti) AS k0 FROM t),
c AS (SELECT ti, s.row, CASE WHEN pos = k0 AND ti BETWEEN lower - 1e-6 AND upper + 1e-6 THEN 0 WHEN pos = k0 + 1 AND ti BETWEEN lower - 1e-6 AND upper + 1e-6 THEN 1 ELSE 2 END AS k, abs(ti - (lower + upper) / 2) AS away, pos <> greatest(k0, 1) AS other, pos FROM a JOIN s ON pos BETWEEN k0 - 2 AND k0 + 2),
b AS (SELECT ti, first(row ORDER BY k, CASE WHEN k < 2 THEN 0.0 ELSE away END, other, pos) AS row FROM c GROUP BY ti) SELECT record, row FROM rc JOIN b USING (ti)""", vis=False)  # fmt: skip
def _(spark, sf_dir):
    return uvfits.by_time(_records(spark, sf_dir), _scans(spark, 30)).select("record", "row")


@query("record_spw_densify", f"WITH {_RECORDS} SELECT record, CASE freqsel WHEN 25 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS spw_index FROM rc", vis=False)
def _(spark, sf_dir):
    return uvfits.dense_spw(_records(spark, sf_dir), [25, 5, 15]).select("record", "spw_index")


# --- solutions and files ---------------------------------------------------------------------------------------------

_OPTIONS = bandpass.Options(antennas=ANTENNAS, freqs=tuple(float(c) for c in range(CHANNELS)), ref_ant=1, iterations=3)


@set_query("solve_bandpass")
def _(u: UVSet):
    return bandpass.wrap(bandpass.solve_bandpass(_dataset(u), _OPTIONS), ANTENNAS, CHANNELS)


@set_query("random_start")
def _(u: UVSet):
    return bandpass.solve_bandpass(_dataset(u), replace(_OPTIONS, iterations=1, seed=1))


@set_query("gain_parameters", "WITH n AS (SELECT spw, count(DISTINCT key) AS k FROM u GROUP BY spw) SELECT spw, CAST(2 * 14 * 6 AS BIGINT) AS n_parameters FROM n")
def _(u: UVSet):
    return bandpass.parameters(bandpass.solve_bandpass(_dataset(u), _OPTIONS), [], [])


@set_query("under_determined", f"""WITH {_DATA}, b AS (SELECT DISTINCT sl.spw, slot, ant1, ant2, CASE WHEN pol = 'PP' THEN 1 ELSE 2 END AS feed FROM da JOIN sl USING (key) WHERE w > 0 AND pol IN ('PP', 'QQ')),
n AS (SELECT spw, slot, feed, count(*) AS n_baselines FROM b WHERE ant1 = 2 OR ant2 = 2 GROUP BY ALL) SELECT CAST(2 AS INT) AS ant, slot, feed, n_baselines, CAST({CHANNELS} AS INT) AS freedom FROM n WHERE n_baselines < 7 AND feed = 1 AND spw = 'spw_0' ORDER BY slot, feed LIMIT 1""")  # fmt: skip
def _(u: UVSet):
    options = replace(_OPTIONS, min_baselines=7, stations={2: Station(reference=Feed(phase=Spec(per_scan=True)))})
    some = _dataset(u).where("spw = 'spw_0'")
    return bandpass.under_determined(some, options, 1)


@set_query("uvfits_roundtrip", f"SELECT 1e9 + 10.0 * CAST(substr(spw, 5) AS INT) AS freq, {4 * CHANNELS} * count(DISTINCT (ti, ant1, ant2)) AS n, count(DISTINCT (ant1, ant2)) AS n_baseline FROM u WHERE source_name = '3C1' GROUP BY key, spw")
def _(u: UVSet):
    """One source's set, written and read again: a record for each time and baseline, with all products and channels, of
    weight 0 where there was no sample. The file goes to the folder that the session's checkpoints go to, or on one
    machine to a folder of its own."""
    spark = u.vis.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="uvfits-")
    one = u.select_source("3C1")
    place = ["partition_key", "ti", "ant1", "ant2"]
    records = one.records.groupBy(*place).agg(F.max_by(F.struct("record", "u", "v", "uw", "extras"), "record").alias("x")).select(*place, "x.*")
    axes = records.select(*place, F.explode(F.array(*[F.lit(p) for p in uvfits.ORDER])).alias("pol")).select("*", F.explode(F.sequence(F.lit(1), F.lit(CHANNELS))).alias("chan"))
    vis = axes.join(one.vis.dropDuplicates([*place, "pol", "chan"]), [*place, "pol", "chan"], "left").select(*place, "pol", "chan", "re", "im", F.coalesce("w", F.lit(0.0)).alias("w"))
    vis = vis.na.fill(float("nan"), ["re", "im"])
    cards = (uvfits.Card("CTYPE3", "STOKES"), uvfits.Card("CRVAL3", -1.0), uvfits.Card("CDELT3", -1.0), uvfits.Card("CRPIX3", 1.0), uvfits.Card("CTYPE4", "FREQ"), uvfits.Card("CRVAL4", 1e9), uvfits.Card("OBJECT", "3C1"))
    path = uvfits.write_uvfits(f"{folder.removeprefix('file://')}/{uuid.uuid4().hex}.uvfits", replace(one, vis=vis, records=records, cards=cards))
    again = uvfits.read_uvfits(spark, path)  # its scans and windows are numbered anew
    setups = again.partitions.select("partition_key", "spw").join(again.setups.select("spw", F.element_at("freqs", 1).alias("freq")), "spw")
    return _counted(again).join(setups, "partition_key").select("freq", "n", "n_baseline")
