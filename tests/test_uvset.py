"""Sets built in code, written to files and read again; what they hold, their parts, and functions of partitions."""

import logging
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from interfera.sources import fits, uvfits
from interfera.sources.fits import Card
from interfera.uvset import UVSet, band_center, centered

POLS = ["PP", "PQ", "QP", "QQ"]
CARDS = tuple(
    [Card("CTYPE2", "COMPLEX"), Card("CTYPE3", "STOKES"), Card("CRVAL3", -1.0), Card("CDELT3", -1.0), Card("CRPIX3", 1.0), Card("CTYPE4", "FREQ"), Card("CRVAL4", 1e9), Card("CTYPE5", "IF")]
    + [Card("CTYPE6", "RA"), Card("CRVAL6", 10.5), Card("CTYPE7", "DEC"), Card("CRVAL7", -3.25), Card("OBJECT", "TEST"), Card("TELESCOP", "TEST"), Card("DATE-OBS", "2000-01-01")]
    + [Card(f"PTYPE{i}", p) for i, p in enumerate(["UU---SIN", "VV---SIN", "WW---SIN", "BASELINE", "DATE", "DATE", "INTTIM"], 1)]
)
OBS = {"telescope": "TEST", "instrument": "", "date_obs": "2000-01-01", "equinox": 2000.0, "bunit": "UNCALIB", "rdate": "2000-01-01", "gst_iat0": 100.5, "earth_rot_rate": 360.9856, "ut1utc": 0.0, "polarx": 0.0, "polary": 0.0, "datutc": 0.0, "time_sys": "UTC", "frame": "ITRF", "xyzhand": "RIGHT", "poltype": "APPROX", "extras": {}}


def make(spark, times=(0.0, 1.0), scans=("1", "2"), spws=(1, 1), subs=(1, 1), pairs=((1, 2), (1, 2)), source="TEST", setups=1, antennas=None, pols=POLS, seed=0):
    rng = np.random.default_rng(seed)
    records = [(i, t, *pairs[i], 1.5 * i, 2.0, -3.0, scans[i], spws[i], subs[i], {"INTTIM": [0.5 + i / 2]}) for i, t in enumerate(times)]
    samples = [(i, p, c, *(float(np.float32(x)) for x in rng.normal(size=2)), 1.0 + c) for i in range(len(times)) for p in (pols if i else POLS) for c in range(1, 5)]
    ants = antennas or [(s, a, n, 1e6 * a, 2e6, 3e6, 1, 0, 0.0, "R", "L", 0.0, 0.0) for s in sorted(set(subs)) for a, n in ((1, "AA"), (2, "AX"))]
    freqs = [(f"spw_{k}", k + 1, 1e9, [1e9 + 4 * k + c for c in range(4)], [1.0] * 4, [1.0] * 4, [1.0] * 4) for k in range(setups)]
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return UVSet.from_records(
        one(records, "record bigint, ti double, ant1 int, ant2 int, u double, v double, uw double, scan_name string, spw_index int, subarray int, extras map<string, array<double>>"),
        one(samples, "record bigint, pol string, chan int, re double, im double, w double"), one(ants, uvfits.ANTENNAS), one(freqs, uvfits.SETUPS),
        {"source_name": source, "ra": 10.5, "dec": -3.25}, OBS, tuple({"name": "ARR", "xyz": (0.0, 0.0, 0.0)} for _ in set(subs)), CARDS,
    )


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def same(a, b):
    for x, y in zip(rows(a.vis, "partition_key", "ant1", "ant2", "pol", "chan", "re", "im", "w"), rows(b.vis, "partition_key", "ant1", "ant2", "pol", "chan", "re", "im", "w"), strict=True):
        assert x == y
    assert rows(a.records, "record", "u", "v", "uw", "extras") == rows(b.records, "record", "u", "v", "uw", "extras")
    for x, y in zip(rows(a.vis, "partition_key", "ti"), rows(b.vis, "partition_key", "ti"), strict=True):
        assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-4


def test_round_trip(spark, tmp_path):
    a = make(spark)
    b = uvfits.read_uvfits(spark, uvfits.write_uvfits(str(tmp_path / "a.uvfits"), a), records_per_partition=1)
    assert [r.partition_key for r in b.leaves().collect()] == ["TEST_spw_0_scan_1", "TEST_spw_0_scan_2"]
    same(a, b)
    assert rows(a.antennas, *a.antennas.columns) == rows(b.antennas, *b.antennas.columns) and b.obs == OBS and b.arrays == a.arrays
    assert b.freq_setup() == a.freq_setup() and b.leaf("TEST_spw_0_scan_2")["ra"] == 10.5
    c = uvfits.read_uvfits(spark, uvfits.write_uvfits(str(tmp_path / "b.uvfits"), b))
    same(b, c)
    with open(tmp_path / "a.uvfits", "rb") as f:
        p = fits.hdus(f)[0]
    assert [fits.value(p.cards, f"PTYPE{i}") for i in range(1, 8)] == ["UU---SIN", "VV---SIN", "WW---SIN", "BASELINE", "DATE", "DATE", "INTTIM"]
    assert (tmp_path / "a.uvfits").stat().st_size % fits.BLOCK == 0


def test_linear_feeds_in_another_order(spark, tmp_path, caplog):
    cards = tuple(Card("CRVAL3", -5.0) if c.key == "CRVAL3" else c for c in CARDS)
    a = replace(make(spark), cards=cards)
    with caplog.at_level(logging.WARNING):
        same(a, uvfits.read_uvfits(spark, uvfits.write_uvfits(str(tmp_path / "l.uvfits"), a)))
    assert "linear but not all feeds are" in caplog.text


def test_two_windows_and_two_antenna_tables(spark, tmp_path):
    a = make(spark, scans=("1", "1"), spws=(1, 2), setups=2, times=(0.0, 0.0))
    b = uvfits.read_uvfits(spark, uvfits.write_uvfits(str(tmp_path / "w.uvfits"), a))
    assert {r.spw for r in b.leaves().collect()} == {"spw_0", "spw_1"} and b.union_frequency_axis().count() == 2
    with pytest.raises(ValueError, match="several frequency setups"):
        b.freq_setup()
    shifted = [(s, x, n, 1e6 * x + s, 2e6, 3e6, 1, 0, 0.0, "R", "L", 0.0, 0.0) for s in (1, 2) for x, n in ((1, "AA"), (2, "AX"))]
    c = make(spark, subs=(1, 2), antennas=shifted)
    d = uvfits.read_uvfits(spark, uvfits.write_uvfits(str(tmp_path / "s.uvfits"), c))
    assert d.antennas.select("subarray").distinct().count() == 2
    assert [r.partition_key for r in d.leaves().collect()] == ["TEST_spw_0_sub_0_scan_1", "TEST_spw_0_sub_1_scan_2"]
    with pytest.raises(Exception, match="unlike antennas named AA"):
        d.union_antennas().collect()


def test_what_cannot_be_written(spark, tmp_path):
    out = str(tmp_path / "x.uvfits")
    with pytest.raises(ValueError, match="unlike polarisations"):
        uvfits.write_uvfits(out, make(spark, pols=["PP", "QQ"]))
    with pytest.raises(Exception, match="antenna index over 255"):
        uvfits.write_uvfits(out, make(spark, pairs=((1, 256), (1, 2))))
    with pytest.raises(ValueError, match="without records"):
        uvfits.write_uvfits(out, make(spark).average())
    two = UVSet.merge(make(spark), make(spark, source="3C273"))
    assert [r.source_name for r in two.sources().collect()] == ["TEST", "3C273"] and "M3C273_spw_0_scan_1" in {r.partition_key for r in two.leaves().collect()}
    with pytest.raises(ValueError, match="one source"):
        uvfits.write_uvfits(out, two)
    with pytest.raises(Exception, match="no values for parameter"):
        uvfits.write_uvfits(out, replace(make(spark), cards=(*CARDS, Card("PTYPE8", "OTHER"))))


def test_headers():
    for c in (Card("A", 1, "x"), Card("B", -2.5e-7), Card("C", "it's"), Card("D", True), Card("HISTORY", None, "made here")):
        assert fits.parse_card(fits.format_card(c)) == c and len(fits.format_card(c)) == 80
    assert fits.number("1.5D3") == 1500 and fits.number("7") == 7 and fits.number("x y") == "x y"
    assert uvfits.stokes((), 2) == ([], ["1", "2"]) and uvfits.julian_date("2000-01-01") == 2451544.5 and uvfits.julian_date("01/01/00") == 2415020.5
    assert uvfits.source_of((Card("NAXIS", 1), Card("CTYPE1", "RA"), Card("CRVAL1", 5.0), Card("OBSDEC", 2.0))) == {"source_name": "", "ra": 5.0, "dec": 2.0}
    assert uvfits.observation(())["frame"] == "ITRF" and uvfits.observation((Card("OBSERVER", "me"),))["extras"] == {"OBSERVER": "me"}
    with pytest.raises(ValueError, match="unknown mount"):
        uvfits.antenna_rows({"ANNAME": np.array(["A"]), "STABXYZ": np.zeros((1, 3)), "MNTSTA": np.array([2])}, 1)
    with pytest.raises(ValueError, match="frequencies for"):
        uvfits.setup_rows((), {"IF FREQ": np.zeros((1, 3))}, 4)


def test_dates(spark):
    make_ = lambda *d: spark.createDataFrame(list(d), "date_1 double, date_2 double")
    of = lambda df: [r[0] for r in df.select(uvfits.hours(df, "2000-01-01")).collect()]
    assert of(make_((2451544.0, 0.75))) == [6.0] and of(make_((0.0, 0.25))) == [6.0] and of(make_()) == []
    with pytest.raises(ValueError, match="neither"):
        of(make_((5000.0, 0.0)))


def test_scans_of_records(spark):
    scans = spark.createDataFrame([(1, 0.0, 1.0, 1, 1, 1, 2), (2, 2.0, 3.0, 1, 1, 3, 3), (3, 2.5, 2.6, 1, 1, 4, 5)], uvfits.NX)
    times = [-4.0, 0.0, 0.5, 1.4, 1.6, 2.0 - 5e-7, 2.2, 2.55, 2.9, 9.0]
    records = spark.createDataFrame(list(enumerate(times)), "record bigint, ti double")
    got = {r.ti: r.row for r in uvfits.by_time(records, scans).collect()}
    # 2.9 is after the start of scan 3, which doesn't hold it: scan 2 isn't asked, and 3 has the nearer centre of the two
    assert got == {-4.0: 1, 0.0: 1, 0.5: 1, 1.4: 1, 1.6: 2, 2.0 - 5e-7: 2, 2.2: 2, 2.55: 3, 2.9: 3, 9.0: 3}
    assert [r.row for r in uvfits.by_ranges(records, scans, width=2).orderBy("record").collect()] == [1, 1, 2, 3, 3]
    whole = [(1, 0, 0, 1, 1, 1, 2), (2, 0, 0, 1, 1, 3, 5)]
    assert uvfits.complete_ranges(whole, 5) and not uvfits.complete_ranges(whole, 6) and not uvfits.complete_ranges([(1, 0, 0, 1, 1, None, None)], 5)
    some = spark.createDataFrame([(3,), (7,)], "freqsel int")
    assert [r.spw_index for r in uvfits.dense_spw(some, [7, 3]).orderBy("freqsel").collect()] == [2, 1]
    with pytest.raises(Exception, match="no frequency setup 7"):
        uvfits.dense_spw(some, [3, 5]).collect()


def test_degenerate_windows_keep_ranges(spark, tmp_path):
    a = make(spark, times=(1.0, 1.0))
    assert uvfits.read_uvfits(spark, uvfits.write_uvfits(str(tmp_path / "d.uvfits"), a)).n_scans().first()[0] == 2


def test_what_it_holds(spark):
    a = make(spark, times=(0.0, 1.0, 1.0), scans=("1", "2", "2"), spws=(1, 1, 1), subs=(1, 1, 1), pairs=((1, 2), (1, 2), (2, 2)))
    assert a.counters().first().asDict() == {"n_baselines": 2, "n_integrations": 3, "n_channels": 4, "n_pols": 4}
    assert [tuple(r)[1] for r in a.scan_ids("TEST").collect()] == ["1", "2"] and a.n_scans().first()[0] == 2
    assert rows(a.scan_windows(), "partition_key", "lo", "hi", "center") == [("TEST_spw_0_scan_1", 0.0, 0.0, 0.0), ("TEST_spw_0_scan_2", 1.0, 1.0, 1.0)]
    assert rows(a.baselines(), "partition_key", "slot", "label") == [("TEST_spw_0_scan_1", 1, "AA-AX"), ("TEST_spw_0_scan_2", 1, "AA-AX"), ("TEST_spw_0_scan_2", 2, "AX-AX")]
    for key in ((2, 2), ("AX", "AX"), "AX-AX", ["AX", "AX"]):
        assert a.baseline_number("TEST_spw_0_scan_2", key) == 2
    for key in (("AX", "AA"), (2, 1), "AX-AA"):  # in that order
        with pytest.raises(KeyError):
            a.baseline_number("TEST_spw_0_scan_2", key)
    assert rows(a.participating_antennas(), "partition_key", "antennas")[0][1] == ["AA", "AX"]
    assert rows(a.union_antennas(), "name") == [("AA",), ("AX",)] and a.union_pol_products() == sorted(POLS)
    assert rows(a.union_baselines(), "slot", "label") == [(1, "AA-AX"), (2, "AX-AX")]
    assert [(r.scan_name, r.n_chan, r.n_time, r.n_baseline, r.n_pol, r.n_record) for r in a.summary().collect()] == [("1", 4, 1, 1, 4, 1), ("2", 4, 1, 2, 4, 2)]
    assert a.leaf("TEST_spw_0_scan_2")["record_order"].count() == 2
    f = a.setups.select(band_center(F.col("freqs")).alias("c"), centered(F.col("freqs")).alias("d")).first()
    assert f.c == 1e9 + 1.5 and f.d == [-1.5, -0.5, 0.5, 1.5]
    assert a.by_spw().first().asDict() == {"spw": "spw_0", "keys": ["TEST_spw_0_scan_1", "TEST_spw_0_scan_2"]}


def test_repeated_records_keep_the_last_samples(spark, tmp_path):
    a = make(spark, times=(1.0, 1.0), scans=("1", "1"))
    assert a.vis.count() == 16 and a.records.count() == 2
    b = uvfits.read_uvfits(spark, uvfits.write_uvfits(str(tmp_path / "r.uvfits"), a))
    assert b.records.count() == 2 and rows(b.vis, "re") == rows(a.vis, "re")


def test_parts(spark):
    a = make(spark, times=(0.0, 1.0, 1.5), scans=("1", "2", "2"), spws=(1, 1, 1), subs=(1, 1, 1), pairs=((1, 2), (1, 2), (2, 2)))
    keys = lambda u: [r.partition_key for r in u.leaves().collect()]
    assert keys(a.time_window(0.5, 1.5)) == ["TEST_spw_0_scan_2"] and a.time_window(0.5, 1.5).records.count() == 2
    assert a.select_station("AX").vis.count() == 48 and a.select_station("AA").records.count() == 2 and keys(a.select_station("ZZ")) == []
    assert keys(a.select_baseline("AX-AX")) == ["TEST_spw_0_scan_2"] and keys(a.select_source("no")) == [] and keys(a.select_partition(scan_name="2", spw="spw_0", intent=None)) == ["TEST_spw_0_scan_2"]
    assert a.select_scan("TEST", 2)["scan_name"] == "2" and keys(a.subset(["TEST_spw_0_scan_1"])) == ["TEST_spw_0_scan_1"]
    with pytest.raises(KeyError):
        a.select_scan("TEST", 3)
    assert [r.ti for r in a.baseline(("AA", "AX")).select("ti").distinct().collect()] == [0.0, 1.0]
    two = make(spark, scans=("1", "1"), spws=(1, 2), setups=2)
    with pytest.raises(ValueError, match="several windows"):
        two.baseline("AA-AX")
    assert two.baselines_per_scan("AA-AX").count() == 32
    changed = a.with_visibilities(a.vis.withColumn("w", F.lit(-1.0)))
    assert changed.flags().where("flag").count() == 48
    mean = a.average()
    assert rows(mean.vis.where("ant1 = 1 AND partition_key = 'TEST_spw_0_scan_2'"), "ti")[0] == (1.25,) and mean.records.count() == 0
    assert rows(a.uvw_average(), "ant1", "ant2", "u")[0] == (1, 2, 0.0)


def test_merge(spark):
    a, b = make(spark), make(spark, times=(100.0, 101.0), source="3C273")
    m = UVSet.merge(a, b)
    assert m.records.select("record").distinct().count() == 4 and [r.leaf_ord for r in m.leaves().collect()] == [0, 1, 2, 3]
    for other, message in ((a, "in two sets"), (replace(b, obs={}), "unlike observations"), (make(spark, source="B", times=(0.0,), scans=("1",), spws=(1,), subs=(1,), pairs=((1, 2),)).time_window(9, 10), "unlike")):
        with pytest.raises(ValueError, match=message):
            UVSet.merge(a, other)


def test_functions_of_partitions(spark):
    a = make(spark)
    twice = a.apply(lambda leaf: leaf.assign(re=2 * leaf["re"]))
    assert rows(twice.vis, "re") == rows(a.vis.select((2 * F.col("re")).alias("re")), "re")
    named = a.apply(lambda leaf, info, root: leaf.assign(w=float(info["scan_name"]) + len(root["telescope"])))
    assert rows(named.vis.select("partition_key", "w").distinct(), "partition_key", "w") == [("TEST_spw_0_scan_1", 5.0), ("TEST_spw_0_scan_2", 6.0)]
    counts = a.mapleaves(lambda leaf, info: {"n": len(leaf), "scan": info["scan_name"]}, "n bigint, scan string")
    assert [(r.partition_key, r.n, r.scan) for r in counts.collect()] == [("TEST_spw_0_scan_1", 16, "1"), ("TEST_spw_0_scan_2", 16, "2")]
    flat = a.flatmap(lambda leaf, *rest: [{"chan": int(c)} for c in sorted(set(leaf["chan"]))] if rest[0]["scan_name"] == "2" else [], "chan bigint")
    assert [(r.partition_key, r.chan) for r in flat.collect()] == [("TEST_spw_0_scan_2", c) for c in range(1, 5)]
    with pytest.raises(Exception, match="list of rows"):
        a.flatmap(lambda leaf: 1, "chan bigint").collect()
    with pytest.raises(TypeError):
        a.apply(lambda: None)
