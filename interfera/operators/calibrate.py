"""Gains: apply them, and what is left when they have been."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from interfera.functions.cplx import abs2, conj, div, finite, mul, sampled, weighted
from interfera.functions.names import feed



def with_gains(vis: DataFrame, gains: DataFrame, *by: str) -> DataFrame:
    """Adds each sample's two gains, by ``by`` (such as window and scan), antenna, feed and channel: ar, ai, br, bi; null
    where there is none."""
    side = lambda p: gains.select(*by, F.col("ant").alias(f"ant{1 + (p == 'b')}"), F.col("feed").alias(f"f{p}"), "chan", F.col("g_re").alias(f"{p}r"), F.col("g_im").alias(f"{p}i"))
    vis = vis.withColumn("fa", feed(F.col("pol"), 1)).withColumn("fb", feed(F.col("pol"), 2))
    return vis.join(side("a"), [*by, "ant1", "fa", "chan"], "left").join(side("b"), [*by, "ant2", "fb", "chan"], "left")


def _pair() -> tuple[Column, Column]:
    """g_a conj(g_b)"""
    return mul((F.col("ar"), F.col("ai")), conj((F.col("br"), F.col("bi"))))


def _usable(m: tuple[Column, Column]) -> Column:
    """The sample counts, and its model is finite and not zero."""
    return sampled(im="im") & F.coalesce(finite(abs2(m)) & (abs2(m) > 0), F.lit(False))


def apply_gains(vis: DataFrame, gains: DataFrame, *by: str) -> DataFrame:
    """v / (g_a conj(g_b)) and w |g_a|^2 |g_b|^2. Samples without weight, or for which there is no gain, pass as they are;
    a gain of zero gives NaN."""
    k = _pair()
    new = div((F.col("re"), F.col("im")), k)
    ok = weighted() & k[0].isNotNull()
    pick = lambda x, old: F.when(ok, F.coalesce(x, F.lit(float("nan")))).otherwise(F.col(old))
    out = with_gains(vis, gains, *by)
    return out.withColumns({"re": pick(new[0], "re"), "im": pick(new[1], "im"), "w": F.when(ok, F.col("w") * abs2(k)).otherwise(F.col("w"))}).select(*vis.columns)


def match_scans(partitions: DataFrame, gains: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Adds ``slot`` to partitions (spw, center in hours, others): of the gains' scans of that window (spw, slot, center)
    within the tolerance the first by slot; null without one. A window without any gains is an error when read.

    A band join as an equi-join: centres meet in cells as wide as the band, and in the cells beside them.
    """
    slots = gains.select("spw", "slot", F.col("center").alias("c_")).distinct()
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    wide = slots.withColumn("cell_", F.explode(F.sequence(cell("c_") - 1, cell("c_") + 1)))
    near = partitions.select("spw", "center").distinct().withColumn("cell_", cell("center")).join(wide, ["spw", "cell_"]).where(F.abs(F.col("center") - F.col("c_")) <= tolerance)
    first = near.groupBy("spw", "center").agg(F.min("slot").alias("slot"))
    known = slots.select("spw", F.lit(True).alias("known_")).distinct()
    found = partitions.join(known, "spw", "left").join(first, ["spw", "center"], "left")
    return found.where(F.when(F.col("known_"), True).otherwise(F.raise_error(F.concat(F.lit("no gains for window "), "spw")).cast("boolean"))).drop("known_")


def apply_bandpass(vis: DataFrame, partitions: DataFrame, gains: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Gains (spw, slot, center, ant, feed, chan, g_re, g_im) applied to visibilities by window and scan: each partition
    (partition_key, spw, center) takes the gains of its scan; one without such a scan stays as it is."""
    matched = match_scans(partitions.select("partition_key", "spw", "center"), gains, tolerance).select("partition_key", "spw", "slot")
    out = apply_gains(vis.join(matched, ["partition_key", "spw"], "left"), gains, "spw", "slot")
    return out.select(*vis.columns)


def source_coherency(vis: DataFrame, gains: DataFrame, *by: str) -> DataFrame:
    """sum(w v conj(m)) / sum(w |m|^2) for m = g_a conj(g_b); 0 without data. Models that are zero or not finite don't
    count."""
    m = _pair()
    p, ok = mul((F.col("re"), F.col("im")), conj(m)), _usable(m)
    add = lambda x: F.sum(F.when(ok, F.col("w") * x).otherwise(0.0))
    out = with_gains(vis, gains).groupBy(*by).agg(add(p[0]).alias("x"), add(p[1]).alias("y"), add(abs2(m)).alias("d"))
    value = lambda c: F.when(F.col("d") > 0, F.try_divide(F.col(c), F.col("d"))).otherwise(0.0)
    return out.select(*by, value("x").alias("s_re"), value("y").alias("s_im"))


def chi_square(vis: DataFrame, gains: DataFrame, cell: list[str], *by: str) -> DataFrame:
    """sum w |v - S m|^2 by ``by`` (of ``cell``), with the S of each cell, in one pass: a cell's sum is
    sum w |v|^2 - |sum w v conj(m)|^2 / sum w |m|^2, which holds as many digits as the residuals have beyond the
    visibilities' own 16."""
    m = _pair()
    usable = with_gains(vis, gains).where(_usable(m)).withColumns({"m_re": m[0], "m_im": m[1]})
    m = (F.col("m_re"), F.col("m_im"))
    v, w = (F.col("re"), F.col("im")), F.col("w")
    p = mul(v, conj(m))
    sums = usable.groupBy(*cell).agg(F.sum(w * p[0]).alias("x"), F.sum(w * p[1]).alias("y"), F.sum(w * abs2(m)).alias("d"), F.sum(w * abs2(v)).alias("q"), F.count(F.lit(1)).alias("n"))
    left = F.greatest(F.col("q") - (F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.col("d"), F.lit(0.0))
    return sums.groupBy(*by).agg(F.sum(left).alias("chi2"), F.sum("n").alias("nvis"))


def residuals(vis: DataFrame, gains: DataFrame, coherency: DataFrame, *by: str) -> DataFrame:
    """Usable samples with the model (m_re, m_im), the residual (r_re, r_im) and rr = |v - g_a S conj(g_b)|^2; coherency:
    by, s_re, s_im."""
    joined = with_gains(vis, gains).where(_usable(_pair())).join(coherency, list(by))
    m = mul(_pair(), (F.col("s_re"), F.col("s_im")))
    joined = joined.withColumns({"m_re": m[0], "m_im": m[1]})
    joined = joined.withColumns({"r_re": F.col("re") - F.col("m_re"), "r_im": F.col("im") - F.col("m_im")})
    return joined.withColumn("rr", abs2((F.col("r_re"), F.col("r_im"))))


def residual_stats(res: DataFrame, *by: str) -> DataFrame:
    """Counts, chi-square, weights, plain, weighted and normalised rms, chi-square by visibility and by real, and the
    median and largest of sqrt(w) |r|, by ``by``."""
    w, rr = F.col("w"), F.col("rr")
    norm = F.sqrt(w * rr)
    out = res.groupBy(*by).agg(F.count(F.lit(1)).alias("nvis"), F.sum(w * rr).alias("chi2"), F.sum(w).alias("sum_w"), F.sqrt(F.avg(rr)).alias("rms"), F.max(norm).alias("max_norm"))
    out = out.join(exact_median(res.select(*by, norm.alias("x")), *by).withColumnRenamed("median", "median_norm"), list(by))
    nreal = 2 * F.col("nvis")
    return out.withColumns({"nreal": nreal, "wrms": F.sqrt(F.col("chi2") / F.col("sum_w")), "norm_rms": F.sqrt(F.col("chi2") / F.col("nvis")), "chi2_per_vis": F.col("chi2") / F.col("nvis"), "chi2_per_real": F.col("chi2") / nreal})


def exact_median(rows: DataFrame, *by: str, bins: int = 4096) -> DataFrame:
    """The median of ``x`` (finite, not null) of each group, without a group in one task: values are counted in ``bins``
    between a group's least and largest, then only those of the two middle bins are ranked."""
    ends = rows.groupBy(*by).agg(F.min("x").alias("lo_"), F.max("x").alias("hi_"), F.count(F.lit(1)).alias("n_"))
    place = F.least(F.floor((F.col("x") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * bins), F.lit(bins - 1)).cast("int")
    placed = rows.join(ends, list(by)).withColumn("bin_", F.when(F.col("hi_") > F.col("lo_"), place).otherwise(0))
    counts = placed.groupBy(*by, "bin_").agg(F.count(F.lit(1)).alias("c_"), F.first("n_").alias("n_"))
    before = W.partitionBy(*by).orderBy("bin_").rowsBetween(W.unboundedPreceding, -1)  # ``bins`` rows a group at most
    counts = counts.withColumn("b_", F.coalesce(F.sum("c_").over(before), F.lit(0)))
    low, high = F.floor((F.col("n_") + 1) / 2), F.floor(F.col("n_") / 2) + 1
    middle = counts.where((F.col("b_") < high) & (F.col("b_") + F.col("c_") >= low)).select(*by, "bin_", "b_", "n_")
    ranked = placed.select(*by, "bin_", "x").join(middle, [*by, "bin_"])
    ranked = ranked.withColumn("r_", F.row_number().over(W.partitionBy(*by, "bin_").orderBy("x")) + F.col("b_"))
    return ranked.where((F.col("r_") == low) | (F.col("r_") == high)).groupBy(*by).agg(F.avg("x").alias("median"))


def window_mean(rows: DataFrame, windows: DataFrame, width_s: int = 3600) -> DataFrame:
    """The mean of the finite values of rows (station, t, value) in each window (station, name, lo, hi; seconds, both
    ends included), and their number; NaN and 0 for a window without any.

    An interval join as an equi-join: a window is laid over the stretches of ``width_s`` that it touches.
    """
    a = rows.where(finite(F.col("value"))).withColumn("cell", F.floor(F.col("t") / width_s)).select("station", "cell", "t", "value")
    b = windows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width_s), F.floor(F.col("hi") / width_s))))
    found = a.join(b, ["station", "cell"]).where(F.col("t").between(F.col("lo"), F.col("hi"))).groupBy("station", "name").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return windows.select("station", "name").distinct().join(found, ["station", "name"], "left").select("station", "name", F.coalesce("mean", F.lit(float("nan"))).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def interpolate(rows: DataFrame, points: DataFrame, width_s: int = 86400) -> DataFrame:
    """Adds ``value`` to points (station, t, others): linear between the rows (station, t, value) on either side.

    A station's only row holds at any time; beyond a station's rows, or without any, the value is NaN. Of rows of equal
    time the smallest value counts. Rows and points are sorted by cells of ``width_s``; what lies before and after a
    cell comes from a row for each cell, so no task gets all of a station.
    """
    cell = F.floor(F.col("t") / width_s).alias("cell")
    rows = rows.groupBy("station", "t").agg(F.min("value").alias("value")).select("station", cell, "t", F.struct("t", "value").alias("row_"))
    points = points.select("*", cell)
    names = points.columns
    ends = rows.groupBy("station", "cell").agg(F.min("row_").alias("head"), F.max("row_").alias("tail"), F.count(F.lit(1)).alias("n"))
    cells = points.select("station", "cell").distinct().join(ends, ["station", "cell"], "full")
    order = W.partitionBy("station").orderBy
    earlier, later = (order(c).rowsBetween(W.unboundedPreceding, -1) for c in ("cell", F.desc("cell")))
    carried = cells.select("station", "cell", F.last("tail", True).over(earlier).alias("tail_"), F.last("head", True).over(later).alias("head_"), F.sum("n").over(W.partitionBy("station")).alias("n_"), F.max("head").over(W.partitionBy("station")).alias("only_"))
    both = points.withColumn("row_", F.lit(None).cast(rows.schema["row_"].dataType)).unionByName(rows, allowMissingColumns=True).withColumn("point_", F.col("row_").isNull())
    inside = W.partitionBy("station", "cell")
    before = F.last("row_", True).over(inside.orderBy("t", "point_").rowsBetween(W.unboundedPreceding, 0))
    after = F.last("row_", True).over(inside.orderBy(F.desc("t"), "point_").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumns({"a_": before, "b_": after}).where("point_").join(carried, ["station", "cell"], "left")
    found = found.withColumns({"a_": F.coalesce("a_", "tail_"), "b_": F.coalesce("b_", "head_")})
    share = (F.col("t") - F.col("a_.t")) / (F.col("b_.t") - F.col("a_.t"))
    line = F.when(F.col("a_.t") == F.col("b_.t"), F.col("a_.value")).otherwise(F.col("a_.value") + share * (F.col("b_.value") - F.col("a_.value")))
    value = F.when(F.col("n_") == 1, F.col("only_.value")).when(F.col("a_").isNull() | F.col("b_").isNull(), float("nan")).otherwise(line)
    return found.withColumn("value", F.coalesce(value, F.lit(float("nan")))).select(*[c for c in names if c != "cell"], "value")


def pick_column(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``at`` to wanted (station, channel, pol): the column (station, at, channel, pol) of that channel and
    polarisation, else the channel's for both, else the one for all channels, else that for both; 0 without any.
    Of equals the first counts."""
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("c"), p.alias("p")) for i, (c, p) in enumerate((c, p) for c in (F.col("channel"), F.lit(0)) for p in (F.col("pol"), F.lit("both")))])
    first = columns.groupBy("station", F.col("channel").alias("c"), F.col("pol").alias("p")).agg(F.min("at").alias("at"))
    asked = wanted.select("station", "channel", "pol", F.inline(tries))
    best = asked.join(first, ["station", "c", "p"], "left").groupBy("station", "channel", "pol").agg(F.min(F.when(F.col("at").isNotNull(), F.struct("rank", "at"))).alias("best"))
    return best.select("station", "channel", "pol", F.coalesce("best.at", F.lit(0)).alias("at"))
