"""Flux calibration from system temperatures and gain curves, by station and scan."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interfera.functions import astro
from interfera.functions.cplx import finite, weighted
from interfera.functions.names import feed
from interfera.operators.calibrate import pick_column
from interfera.uvset import UVSet

_NAN = float("nan")
log = logging.getLogger(__name__)


def instant(hours: Column, rdate: str) -> Column:
    """The time, to a millisecond, of hours since a reference date; an error at once without one."""
    return F.timestamp_millis(F.lit(_midnight_ms(rdate)) + F.rint(hours * 3.6e6).cast("long"))


def julian(hours: Column, rdate: str) -> Column:
    return F.lit(_midnight_ms(rdate) / 86_400_000 + 2440587.5) + hours / 24.0


def _midnight_ms(rdate: str) -> int:
    from interfera.sources.uvfits import julian_date

    if not rdate:
        raise ValueError("the set has no reference date")
    return round((julian_date(rdate) - 2440587.5) * 86_400_000)


def scan_temperatures(temps: DataFrame, windows: DataFrame, wanted: DataFrame, width_s: int = 3600) -> DataFrame:
    """Adds ``tsys`` to wanted (partition_key, station, feed, chan): the mean, over the partition's window (partition_key,
    lo, hi; seconds), of the finite values of the column that stands for the channel and the feed's polarisation (R for
    1, L for 2); NaN without any.

    temps: station, t (seconds), at, channel, pol, value. Means are taken once for a window and column, by cells of
    ``width_s``, before channels are told apart.
    """
    cell = lambda c: F.floor(F.col(c) / width_s)
    spans = windows.select("partition_key", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    inside = temps.where(finite(F.col("value"))).select("station", "at", "t", "value", cell("t").alias("cell")).join(spans, "cell").where(F.col("t").between(F.col("lo"), F.col("hi")))
    means = inside.groupBy("partition_key", "station", "at").agg(F.avg("value").alias("tsys"))
    letter = F.when(F.col("feed") == 1, "R").otherwise("L")
    asked = wanted.select("station", F.col("chan").alias("channel"), letter.alias("pol")).distinct()
    picked = pick_column(temps.select("station", "at", "channel", "pol").distinct(), asked)
    picked = picked.select("station", F.col("channel").alias("chan"), F.when(F.col("pol") == "R", 1).otherwise(2).alias("feed"), "at")
    out = wanted.join(picked, ["station", "feed", "chan"], "left").join(means, ["partition_key", "station", "at"], "left")
    return out.select(*wanted.columns, F.coalesce("tsys", F.lit(_NAN)).alias("tsys"))


def apriori_gains(uvset: UVSet, curves: DataFrame, temps: DataFrame, on_missing: str = "warn") -> DataFrame:
    """partition_key, ti, ant, feed, chan, elevation (degrees), sefd, gain (1 / sqrt of it), for each time of a partition
    and antenna; what isn't finite and over zero gives NaN.

    curves: station, dpfu_1, dpfu_2, poly; temps: station, ts, at, channel, pol, value. Temperatures are means over the
    partition's window, elevations belong to each time. A station without a curve has gain 1 and no sefd: an error, or a
    warning, at once, as on_missing says ("error", "warn", "ignore").
    """
    if on_missing not in ("warn", "error", "ignore"):
        raise ValueError("on_missing is warn, error or ignore")
    if on_missing != "ignore" and (lost := [r[0] for r in missing_stations(uvset, curves).orderBy("name").limit(20).collect()]):
        if on_missing == "error":
            raise ValueError(f"no calibration for stations {lost}")
        log.warning("no calibration for stations %s: their gain is 1", lost)
    rdate = uvset.obs.get("rdate", "")
    channels = uvset.vis.agg(F.max("chan")).first()[0] or 0
    seconds = lambda c: F.unix_micros(instant(F.col(c), rdate)) / 1e6
    windows = uvset.scan_windows().select("partition_key", seconds("lo").alias("lo"), seconds("hi").alias("hi"))
    temps = temps.select("station", (F.unix_micros("ts") / 1e6).alias("t"), "at", "channel", "pol", "value")
    times = uvset.vis.select("partition_key", "ti").distinct().join(uvset.partitions.select("partition_key", "subarray", "ra", "dec"), "partition_key")
    seen = times.join(uvset.antennas.select("subarray", "ant", F.col("name").alias("station"), "x", "y", "z"), "subarray")
    known = seen.join(curves.select("station", "dpfu_1", "dpfu_2", "poly"), "station", "left").withColumn("missing", F.col("poly").isNull())
    el = F.degrees(astro.elevation(F.col("x"), F.col("y"), F.col("z"), F.radians("ra"), F.radians("dec"), julian(F.col("ti"), rdate)))
    known = known.withColumn("elevation", F.when(F.col("missing"), _NAN).otherwise(el)).withColumn("shape", astro.elevation_gain(F.col("poly"), F.col("elevation")))
    each = lambda df: df.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("feed")).select("*", F.explode(F.sequence(F.lit(1), F.lit(channels))).alias("chan"))
    tsys = scan_temperatures(temps, windows, each(known.select("partition_key", "station").distinct()))
    cells = each(known).join(tsys, ["partition_key", "station", "feed", "chan"], "left").withColumn("dpfu", F.when(F.col("feed") == 1, F.col("dpfu_1")).otherwise(F.col("dpfu_2")))
    good = lambda c: F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False))
    sefd = F.when(good("tsys") & good("shape") & good("dpfu"), F.try_divide(F.col("tsys"), F.col("dpfu") * F.col("shape"))).otherwise(_NAN)
    cells = cells.withColumn("sefd", F.when(F.col("missing"), _NAN).otherwise(sefd))
    return cells.select("partition_key", "ti", "ant", "station", "feed", "chan", "elevation", "sefd", F.when(F.col("missing"), 1.0).otherwise(1 / F.sqrt("sefd")).alias("gain"), "missing")


def missing_stations(uvset: UVSet, curves: DataFrame) -> DataFrame:
    """name: stations of the set's partitions without a curve."""
    return uvset.antennas.join(uvset.partitions.select("subarray").distinct(), "subarray", "left_semi").select("name").distinct().join(curves.select(F.col("station").alias("name")), "name", "left_anti")


def apply_real_gains(vis: DataFrame, gains: DataFrame) -> DataFrame:
    """v / (g_a g_b) and w (g_a g_b)^2 by partition_key, ti, antenna, feed and channel; a NaN gain gives weight 0 and
    leaves v; samples without weight pass as they are."""
    side = lambda p: gains.select("partition_key", "ti", F.col("ant").alias(f"ant{1 + (p == 'b')}"), F.col("feed").alias(f"f{p}"), "chan", F.col("gain").alias(f"g{p}"))
    both = vis.withColumn("fa", feed(F.col("pol"), 1)).withColumn("fb", feed(F.col("pol"), 2))
    both = both.join(side("a"), ["partition_key", "ti", "ant1", "fa", "chan"], "left").join(side("b"), ["partition_key", "ti", "ant2", "fb", "chan"], "left")
    g = F.col("ga") * F.col("gb")
    ok, fine = weighted(), F.coalesce(finite(F.col("ga")) & finite(F.col("gb")), F.lit(False))
    new = lambda c, x, bad: F.when(ok & fine, x).when(ok, bad).otherwise(F.col(c))
    out = both.withColumns({"re": new("re", F.try_divide(F.col("re"), g), F.col("re")), "im": new("im", F.try_divide(F.col("im"), g), F.col("im")), "w": new("w", F.col("w") * g * g, F.lit(0.0))})
    return out.select(*vis.columns)


def apply_calibration(uvset: UVSet, curves: DataFrame, temps: DataFrame, on_missing: str = "warn") -> UVSet:
    """The set in units of flux; see ``apriori_gains``."""
    return uvset.with_visibilities(apply_real_gains(uvset.vis, apriori_gains(uvset, curves, temps, on_missing)))


def inspect(uvset: UVSet, curves: DataFrame, temps: DataFrame) -> DataFrame:
    """What calibration would use for each partition: the gains' table, nothing applied."""
    return apriori_gains(uvset, curves, temps, "ignore")
