"""Flux calibration, spectra, choices and reports on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from interfera.functions import astro
from interfera.operators import apriori, calibrate, reports, series
from test_uvset import make

NAN = float("nan")


def curves(spark, *names):
    return spark.createDataFrame([(n, 1.0, 1.0, [1.0]) for n in names], "station string, dpfu_1 double, dpfu_2 double, poly array<double>")


def temps(spark, values):
    rows = [(n, f"2000-01-01 0{h}:00:00", 1, 0, p, v) for n, v in values.items() for h in (0, 1) for p in ("R", "L")]
    rows = [(n, ts, 1 if p == "R" else 2, c, p, v) for n, ts, _, c, p, v in rows]
    return spark.createDataFrame(rows, "station string, ts string, at bigint, channel int, pol string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_flux_scale(spark):
    u = make(spark)
    out = apriori.apply_calibration(u, curves(spark, "AA", "AX"), temps(spark, {"AA": 100.0, "AX": 400.0}))
    key = ["partition_key", "ti", "ant1", "ant2", "pol", "chan"]
    both = out.vis.join(u.vis.select(*key, F.col("re").alias("r0"), F.col("w").alias("w0")), key).collect()
    assert len(both) == 32 and all(abs(r.re - 200 * r.r0) < 1e-9 and abs(r.w - r.w0 / 40000) < 1e-12 for r in both)
    table = apriori.inspect(u, curves(spark, "AA", "AX"), temps(spark, {"AA": 100.0, "AX": 400.0}))
    assert {(r.station, r.sefd) for r in table.collect()} == {("AA", 100.0), ("AX", 400.0)}


def test_stations_without_calibration(spark, caplog):
    u = make(spark)
    with pytest.raises(ValueError, match="AX"):
        apriori.apply_calibration(u, curves(spark, "AA"), temps(spark, {"AA": 100.0}), on_missing="error")
    out = apriori.apply_calibration(u, curves(spark, "AA"), temps(spark, {"AA": 100.0}))  # its gain is 1
    assert "no calibration for stations ['AX']" in caplog.text
    assert abs(out.vis.agg(F.sum("w")).first()[0] - u.vis.agg(F.sum("w")).first()[0] / 100) < 1e-9
    none = apriori.apply_calibration(u, curves(spark, "AA", "AX"), temps(spark, {"AA": 100.0, "AX": NAN}))
    assert none.vis.where("w <> 0").count() == 0 and none.vis.agg(F.sum("re")).first()[0] == pytest.approx(u.vis.agg(F.sum("re")).first()[0])
    with pytest.raises(ValueError, match="reference date"):
        apriori.julian(F.lit(0.0), "")


def test_elevation(spark):
    """A source at the pole stands as high as the place's latitude; one overhead at the zenith."""
    one = spark.range(1)
    x, z = F.lit(6378137.0 * math.cos(0.5)), F.lit(6378137.0 * math.sin(0.5))
    lat, _, _ = astro.geodetic(x, F.lit(0.0), z)
    pole = astro.elevation(x, F.lit(0.0), z, F.lit(0.3), F.lit(math.pi / 2), F.lit(2451545.0))
    up = astro.elevation(x, F.lit(0.0), z, astro.sidereal(F.lit(2451545.0), F.lit(0.0)), lat, F.lit(2451545.0))
    r = one.select(lat.alias("lat"), pole.alias("pole"), up.alias("up"), astro.sidereal(F.lit(2451545.0), F.lit(0.0)).alias("s")).first()
    assert r.pole == pytest.approx(r.lat, abs=1e-9) and r.up == pytest.approx(math.pi / 2, abs=1e-6) and math.degrees(r.s) == pytest.approx(280.46061837)


def test_windows_and_gains_that_are_missing(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, NAN), ("a", 3.0, 3.0), ("a", 9.0, 99.0)], "station string, t double, value double")
    windows = spark.createDataFrame([("a", 1, 0.0, 4.0), ("a", 2, 5.0, 8.0), ("b", 3, 0.0, 9.0)], "station string, name int, lo double, hi double")
    got = {r.name: (r["mean"], r.n) for r in calibrate.window_mean(rows, windows).collect()}
    assert got[1] == (2.0, 2) and all(math.isnan(got[k][0]) and got[k][1] == 0 for k in (2, 3))
    vis = spark.createDataFrame([(1, 2, "PP", 1, 2.0, 0.0, 1.0), (1, 3, "PP", 1, 2.0, 0.0, 1.0), (1, 2, "PP", 1, 5.0, 0.0, -1.0)], "ant1 int, ant2 int, pol string, chan int, re double, im double, w double")
    gains = spark.createDataFrame([(1, 1, 1, 2.0, 0.0), (2, 1, 1, 0.5, 0.0)], "ant int, feed int, chan int, g_re double, g_im double")
    assert sorted((r.re, r.w) for r in calibrate.apply_gains(vis, gains).collect()) == [(2.0, 1.0), (2.0, 1.0), (5.0, -1.0)]
    with pytest.raises(Exception, match="no feed: RR"):
        calibrate.apply_gains(vis.withColumn("pol", F.lit("RR")), gains).collect()


def test_exact_median(spark):
    rows = spark.createDataFrame([(g, float((7 * i) % 101) + (1e6 if i == 3 else 0)) for g in range(3) for i in range(50 + g)], "g int, x double")
    want = {r.g: r.m for r in rows.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert {r.g: r.median for r in calibrate.exact_median(rows, "g", bins=8).collect()} == want


def test_limits_and_shared_tracks(spark):
    values = spark.createDataFrame([(1, 1.0, NAN), (1, 2.0, NAN), (1, NAN, NAN), (1, 4.0, NAN), (2, NAN, 1.0)], "k int, value double, noise double")
    (r,) = series.limits(values, "k", pad=0.1).collect()
    assert (r.k, round(r.lo, 9), round(r.hi, 9)) == (1, 0.7, 4.3)
    tracks = [(k, t, c, v) for k, pair in {1: ([1.0, NAN], [1.0 + 1e-13, NAN]), 2: ([1.0, 2.0], [1.0, NAN]), 3: ([1.0, 2.0], [1.0, 2.1]), 4: ([NAN, NAN], [5.0, 6.0])}.items() for t, vs in enumerate(pair) for c, v in enumerate(vs, 1)]
    got = series.shared_track(spark.createDataFrame(tracks, "k int, t int, chan int, value double"), "t", "k").collect()
    assert sorted((r.k, r.chan, r.value) for r in got) == [(1, 1, 1.0), (4, 1, 5.0), (4, 2, 6.0)]


def test_choices():
    pols = ["PP", "PQ", "QP", "QQ"]
    assert series.choose_pols(pols) == ["PP", "QQ"] and series.choose_pols(pols, "all") == pols and series.choose_pols(pols, ["12", 4]) == ["PQ", "QQ"]
    assert series.choose_feeds(["11", 2]) == [1, 2] and series.choose_sites(["AA", "AX"], ["AX", 1]) == [2, 1] and series.choose_sites(["AA"], "all") == [1]
    for bad in (lambda: series.choose_pols(["PP"]), lambda: series.choose_pols(pols, 5), lambda: series.choose_feeds(3), lambda: series.choose_sites(["AA"], "ZZ"), lambda: series.gain_label("delay")):
        with pytest.raises(ValueError):
            bad()
    assert series.gain_label("phase") == "gain phase rel. to ref (rad)"


def test_order_of_tables_and_lines(spark):
    rows = [(1, 2, "PP", 3, 0.9, 10.0, 0.95, 5.0, 5.0, 18.0), (1, 3, "PP", 2, 0.9, 10.0, 0.8, 20.0, NAN, NAN), (2, 3, "QQ", 3, 0.9, 9.0, 0.99, 1.0, 8.0, 8.0)]
    table = spark.createDataFrame(rows, "ant1 int, ant2 int, pol string, n bigint, coherence_before double, loss_before double, coherence_after double, loss_after double, improvement double, rms_after double")
    assert [(r.ant1, r.ant2) for r in table.orderBy(*series.by_improvement()).collect()] == [(2, 3), (1, 2), (1, 3)]
    assert [(r.ant1, r.ant2) for r in series.site_coherence(table, 3).collect()] == [(1, 3), (2, 3)] and series.site_coherence(table, 3, "QQ", 1).count() == 1
    lines = [r.line for r in reports.coherence_lines(table).collect()]
    assert lines[0] == "1-2       PP       3       0.900           10.00      0.950           5.00        5.00           18.00" and lines[1].endswith("n/a             n/a")
    assert reports.site_lines(table, 3).first().line.startswith("1-2       1")
    stats = spark.createDataFrame([(0.1, 12.0, 2)], "loss double, rms double, n bigint")
    assert reports.coherence_note(stats).first().note == "scan loss 0.10%\nscan rms 12.0 deg"
