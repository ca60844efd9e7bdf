"""How coherent, complete and smooth the data are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from interfera.functions.cplx import finite, sampled, weighted
from interfera.functions.names import is_parallel


def coherence(vis: DataFrame, *by: str) -> DataFrame:
    """|sum w v/|v|| / sum w, clamped to 0..1; the loss in percent and the phase's rms in degrees that it stands for."""
    amp = F.hypot("re", "im")
    rows = vis.where(sampled(im="im") & (amp > 0))
    unit = lambda c: F.sum(F.col("w") * F.col(c) / amp)
    out = rows.groupBy(*by).agg(unit("re").alias("x"), unit("im").alias("y"), F.sum("w").alias("d"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("coherence", F.least(F.greatest(F.hypot("x", "y") / F.col("d"), F.lit(0.0)), F.lit(1.0)))
    rms = F.when(F.col("coherence") > 0, F.degrees(F.sqrt(F.greatest(-2 * F.ln("coherence"), F.lit(0.0))))).otherwise(float("inf"))
    return out.select(*by, "coherence", (100 * (1 - F.col("coherence"))).alias("loss"), rms.alias("rms"), "n")


def reference_channel(vis: DataFrame) -> DataFrame:
    """The channel of most weight in parallel hands, whatever their visibilities; the first of equals; 1 without any."""
    rows = vis.where(weighted() & is_parallel(F.col("pol")))
    best = rows.groupBy("chan").agg(F.sum("w").alias("weight")).agg(F.max(F.struct("weight", (-F.col("chan")).alias("c"))).alias("best"))
    return best.select(F.coalesce((-F.col("best.c")).cast("int"), F.lit(1)).alias("chan"), F.coalesce("best.weight", F.lit(0.0)).alias("weight"))


def diagnostic_baseline(vis: DataFrame) -> DataFrame:
    rows = vis.where(sampled() & is_parallel(F.col("pol")))
    return rows.groupBy("ant1", "ant2").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "ant1", "ant2").limit(1)


def unwrap(tracks: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Adds ``unwrapped`` to tracks (by, chan, phase): whole turns are taken out of steps between channels, outwards from
    the channel of the most (finite) weight, or the first; that one keeps its phase. Channels that aren't finite stay
    as they are and are passed over."""
    order = W.partitionBy(*by).orderBy("chan")
    ok = finite(F.col("phase"))
    good = F.when(ok, F.col("phase"))
    step = good - F.last(good, True).over(order.rowsBetween(W.unboundedPreceding, -1))
    turns = F.coalesce(F.rint(step / (2 * F.pi())), F.lit(0.0))
    out = tracks.withColumn("turns_", turns).withColumn("sum_", F.sum("turns_").over(order.rowsBetween(W.unboundedPreceding, 0)))
    value = F.lit(0.0) if weight is None else F.when(finite(F.col(weight)), F.col(weight)).otherwise(float("-inf"))
    seed = F.max(F.when(ok, F.struct(value.alias("w"), (-F.col("chan")).alias("c"), F.col("sum_").alias("s")))).over(W.partitionBy(*by))
    out = out.withColumn("seed_", seed["s"])
    return out.withColumn("unwrapped", F.when(ok, F.col("phase") - 2 * F.pi() * (F.col("sum_") - F.col("seed_"))).otherwise(F.col("phase"))).drop("turns_", "sum_", "seed_")


def _middle(values: Column) -> Column:
    """The median of a sorted array; null for an empty one."""
    n = F.size(values)
    return (F.get(values, F.floor((n + 1) / 2).cast("int") - 1) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def neighbour_median(tracks: DataFrame, *by: str, window: int = 2, support: str | None = None) -> DataFrame:
    """Adds ``scale``: the median amplitude of up to ``window`` channels on either side, itself left out; with fewer than
    two, that of the track's others; null if there are none. Only finite amplitudes over zero count, and with
    ``support`` those of a support over zero. A track is a row for each channel."""
    order = W.partitionBy(*by).orderBy("chan")
    good = finite(F.col("amp")) & (F.col("amp") > 0)
    good = good & (F.col(support) > 0) if support else good
    rows = tracks.withColumn("good_", F.when(good, F.struct("chan", "amp")))
    near = F.concat(*[F.collect_list("good_").over(order.rangeBetween(a, b)) for a, b in ((-window, -1), (1, window))])
    every = F.filter(F.collect_list("good_").over(W.partitionBy(*by)), lambda x: x["chan"] != F.col("chan"))
    amps = lambda x: F.array_sort(F.transform(x, lambda y: y["amp"]))
    out = rows.withColumns({"near_": amps(near), "all_": amps(every)})
    return out.withColumn("scale", F.when(F.size("near_") >= 2, _middle(F.col("near_"))).otherwise(_middle(F.col("all_")))).drop("good_", "near_", "all_")


def collapsed(tracks: DataFrame, *by: str, fraction: float = 0.05, least: float = 1e-2, window: int = 2, support: str | None = None) -> DataFrame:
    """Finite amplitudes over zero (with ``support``, of a support over zero) that are under ``least`` or under a fraction
    of their neighbours' median, if there is one."""
    good = finite(F.col("amp")) & (F.col("amp") > 0)
    good = good & (F.col(support) > 0) if support else good
    low = (F.col("amp") < least) | F.coalesce(F.col("amp") < fraction * F.col("scale"), F.lit(False))
    return neighbour_median(tracks, *by, window=window, support=support).where(good & F.col("scale").isNotNull() & low)


def sanitized(tracks: DataFrame, *by: str, window: int = 2, support: str | None = None) -> DataFrame:
    """Tracks (by, chan, amp, phase) whose broken amplitudes (not finite, or not over zero; with ``support``, of a support
    over zero) are replaced by their neighbours' median, if there is one; phases stay. Adds ``repaired``."""
    broken = ~F.coalesce(finite(F.col("amp")) & (F.col("amp") > 0), F.lit(False))
    broken = broken & (F.col(support) > 0) if support else broken
    out = neighbour_median(tracks, *by, window=window, support=support).withColumn("repaired", broken & F.col("scale").isNotNull())
    return out.withColumn("amp", F.when(F.col("repaired"), F.col("scale")).otherwise(F.col("amp"))).drop("scale")


def parallel_support(vis: DataFrame, *by: str) -> DataFrame:
    """Counts and weights of the two parallel hands, and their ratios."""
    ok = sampled(im="im")
    n = lambda p: F.sum((ok & (F.col("pol") == p)).cast("long"))
    w = lambda p: F.sum(F.when(ok & (F.col("pol") == p), F.col("w")).otherwise(0.0))
    out = vis.groupBy(*by).agg(n("PP").alias("n_pp"), n("QQ").alias("n_qq"), w("PP").alias("w_pp"), w("QQ").alias("w_qq"))
    return out.withColumns({"count_ratio": F.col("n_qq") / F.greatest("n_pp", F.lit(1)), "weight_ratio": F.col("w_qq") / F.greatest("w_pp", F.lit(2.220446049250313e-16))})
