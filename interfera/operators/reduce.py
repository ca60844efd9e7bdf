"""Averages by inverse-variance weight. All sums aggregate before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interfera.functions.cplx import finite, flagged, sampled


def _sum(ok: Column, x: Column) -> Column:
    return F.sum(F.when(ok, x).otherwise(0.0))


def scan_average(vis: DataFrame, *by: str) -> DataFrame:
    """sum(w v) / sum(w) and sum(w) by ``by``; without a valid sample NaN, 0 and flagged."""
    ok = sampled()
    out = vis.groupBy(*by).agg(_sum(ok, F.col("w")).alias("weight"), _sum(ok, F.col("w") * F.col("re")).alias("sre"), _sum(ok, F.col("w") * F.col("im")).alias("sim"))
    mean = lambda s: F.when(F.col("weight") > 0, F.try_divide(F.col(s), F.col("weight"))).otherwise(float("nan"))
    return out.withColumn("re", mean("sre")).withColumn("im", mean("sim")).withColumn("flag", flagged("weight")).drop("sre", "sim")


def uvw_average(vis: DataFrame, *by: str, names: tuple[str, ...] = ("u", "v", "uw")) -> DataFrame:
    """Means of coordinates by the valid weight; a component that isn't finite still counts in the divisor."""
    ok = sampled()
    total = _sum(ok, F.col("w"))
    return vis.groupBy(*by).agg(*[F.try_divide(_sum(ok & finite(F.col(c)), F.col("w") * F.col(c)), total).alias(c) for c in names])


def noise(vis: DataFrame, *by: str) -> DataFrame:
    """Mean amplitude, 1 / sqrt(sum w), and the phase's noise, of samples whose both parts are finite."""
    out = scan_average(vis.where(sampled(im="im")), *by)
    sigma = F.when(F.col("weight") > 0, 1 / F.sqrt("weight"))
    return out.withColumn("amp", F.hypot("re", "im")).withColumn("sigma", sigma).withColumn("sigma_phase", F.try_divide(F.col("sigma"), F.col("amp")))


def support(vis: DataFrame, value: Column, *by: str) -> DataFrame:
    """A sum that each sample adds to both its antennas: weights, or w |v|^2. Pairs are summed up before they're given to
    their two ends."""
    pairs = vis.groupBy("ant1", "ant2", *by).agg(F.sum(value).alias("x_"))
    return pairs.select(F.explode(F.array("ant1", "ant2")).alias("ant"), *by, "x_").groupBy("ant", *by).agg(F.sum("x_").alias("support"))
