import datetime as dt

import pytest

from interfera.operators import calibrate
from interfera.sources import antab

TEXT = """! made for this test
GAIN AA EQUAT DPFU = 0.5 POLY = 1.0, 0.01 /
GAIN AX ALTAZ DPFU=1.0,2.0 /
TSYS AA FT=1.0 INDEX='R1','L1' /
100 00:00:30.5 10 20 ! noon
100 00:01.5 11 21 99
/
TSYS AX TIMEOFF=0
INDEX = 'X1:32', 'L2|R2'
/
101 01:00:00 5 6
/
"""


def test_blocks(spark, tmp_path):
    (tmp_path / "e22a26.AN").write_text(TEXT)
    gains = {r.station: (r.dpfu_1, r.dpfu_2, r.poly) for r in antab.gain_curves(spark, str(tmp_path)).collect()}
    assert gains == {"AA": (0.5, 0.5, [1.0, 0.01]), "AX": (1.0, 2.0, [1.0])}
    rows = antab.system_temperatures(spark, str(tmp_path))
    got = sorted((r.station, r.ts, r["at"], r.channel, r.pol, r.value) for r in rows.selectExpr("station", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') AS ts", "at", "channel", "pol", "value").collect())
    day = (dt.date(2022, 1, 1) + dt.timedelta(99)).isoformat()
    assert got == [
        ("AA", f"{day} 00:00:30.500", 1, 1, "R", 10.0), ("AA", f"{day} 00:00:30.500", 2, 1, "L", 20.0),
        ("AA", f"{day} 00:01:30.000", 1, 1, "R", 11.0), ("AA", f"{day} 00:01:30.000", 2, 1, "L", 21.0),
        ("AX", "2022-04-11 01:00:00.000", 1, 0, "R", 5.0), ("AX", "2022-04-11 01:00:00.000", 2, 2, "both", 6.0),
    ]


@pytest.mark.parametrize("text", ["TSYS AA INDEX='R1' /\n1 0:0 1\n/\n", "GAIN AA DPFU=1 /\nTSYS AA INDEX='Q1' /\n1 0:0 1\n/\n", "GAIN AA DPFU=1 /\nTSYS AA INDEX='R1','L1' /\n1 0:0 1\n/\n"])
def test_errors(spark, tmp_path, text):
    (tmp_path / "e22a26.AN").write_text(text)
    with pytest.raises(Exception, match="no gain|unknown column|short row"):
        antab.system_temperatures(spark, str(tmp_path)).collect()


def test_interpolate(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 250000.0, 3.0), ("b", 5.0, 7.0)], "station string, t double, value double")
    points = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 125000.0, 250000.0, 250001.0)] + [("b", 9e6), ("c", 1.0)], "station string, t double")
    got = {(r.station, r.t): r.value for r in calibrate.interpolate(rows, points).collect()}
    nan = {k for k, v in got.items() if v != v}
    assert nan == {("a", -1.0), ("a", 250001.0), ("c", 1.0)}
    assert {k: v for k, v in got.items() if k not in nan} == {("a", 0.0): 1.0, ("a", 125000.0): 2.0, ("a", 250000.0): 3.0, ("b", 9e6): 7.0}
