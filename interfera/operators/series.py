"""Spectra and what is drawn, tabled or chosen by them. A spectrum is a row for each channel (chan, from 1) of whatever
``by`` names; scans, times or other groups of one are averaged each by itself, then together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from interfera.functions.cplx import abs2, conj, div, finite, mul, sampled, weighted
from interfera.functions.names import feed, is_parallel
from interfera.operators.calibrate import exact_median

_NAN = float("nan")
PARALLEL, CROSS = ("PP", "QQ"), ("PQ", "QP")


def spectrum(vis: DataFrame, *by: str) -> DataFrame:
    """by, chan, weight (all finite weights over zero), re, im (of samples with both parts finite; NaN without any)."""
    ok, some = sampled(im="im"), weighted()
    add = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    w = F.col("w")
    out = vis.groupBy(*by, "chan").agg(add(some, w).alias("weight"), add(ok, w).alias("d_"), add(ok, w * F.col("re")).alias("x_"), add(ok, w * F.col("im")).alias("y_"))
    mean = lambda c: F.when(F.col("d_") > 0, F.try_divide(F.col(c), F.col("d_"))).otherwise(_NAN)
    return out.select(*by, "chan", "weight", mean("x_").alias("re"), mean("y_").alias("im"))


def with_noise(spectra: DataFrame) -> DataFrame:
    """Adds amp, phase, sigma (1 / sqrt of the weight, else NaN) and sigma_phase to spectra."""
    sigma = F.when(F.col("weight") > 0, 1 / F.sqrt("weight")).otherwise(_NAN)
    out = spectra.withColumns({"amp": F.hypot("re", "im"), "phase": F.when(finite(F.col("re")), F.atan2("im", "re")).otherwise(_NAN), "sigma": sigma})
    return out.withColumn("sigma_phase", F.when(finite(F.col("amp")) & (F.col("amp") > 0), F.try_divide(F.col("sigma"), F.col("amp"))).otherwise(_NAN))


def _reference(value: str, good: Column, by: Sequence[str], ref: int) -> Column:
    """chan and value of the reference channel if it's good, else of the first good one; null without any."""
    whole = W.partitionBy(*by)
    return F.min(F.when(good, F.struct((F.col("chan") != ref).alias("later"), F.col("chan"), F.col(value).alias("v")))).over(whole)


def relative_phase(tracks: DataFrame, *by: str, ref: int = 1) -> DataFrame:
    """Adds ``relative``: phases less that of channel ``ref``, or of the first finite one, within half a turn; NaN where
    there's none."""
    ok = finite(F.col("phase"))
    out = tracks.withColumn("ref_", _reference("phase", ok, by, ref))
    d = F.col("phase") - F.col("ref_.v")
    return out.withColumn("relative", F.when(ok, F.atan2(F.sin(d), F.cos(d))).otherwise(_NAN)).drop("ref_")


def relative_amplitude(tracks: DataFrame, *by: str, ref: int = 1) -> DataFrame:
    """Adds ``relative``: amplitudes by that of channel ``ref``, or of the first that is finite and over zero; NaN where
    there's none."""
    ok = finite(F.col("amp")) & (F.col("amp") > 0)
    out = tracks.withColumn("ref_", _reference("amp", ok, by, ref))
    return out.withColumn("relative", F.when(ok, F.col("amp") / F.col("ref_.v")).otherwise(_NAN)).drop("ref_")


def series(vis: DataFrame, *by: str, quantity: str = "phase", relative: bool = True, ref: int = 1) -> DataFrame:
    """by, chan, value and noise of phases or amplitudes; relative ones have no noise at their reference."""
    if quantity not in ("phase", "amplitude"):
        raise ValueError("the quantity is phase or amplitude")
    out = with_noise(spectrum(vis, *by))
    plain, sigma = ("phase", "sigma_phase") if quantity == "phase" else ("amp", "sigma")
    if not relative:
        return out.select(*by, "chan", F.col(plain).alias("value"), F.col(sigma).alias("noise"))
    ok = finite(F.col("amp")) & (F.col("amp") > 0)
    out = out.withColumn("at_", _reference("amp", ok, by, ref)["chan"])
    out = (relative_phase if quantity == "phase" else relative_amplitude)(out, *by, ref=ref)
    scaled = F.col("sigma_phase") if quantity == "phase" else F.col("relative") * F.col("sigma_phase")
    fine = finite(F.col("relative")) & finite(F.col("sigma_phase"))
    noise = F.when(fine & (F.col("chan") == F.col("at_")), 0.0).when(fine, scaled).otherwise(_NAN)
    return out.select(*by, "chan", F.col("relative").alias("value"), noise.alias("noise"))


def scan_averaged_amplitude(vis: DataFrame, group: str, *by: str, relative: bool = False) -> DataFrame:
    """by, chan, amp: amplitudes of each group's spectrum, averaged over groups by their weights; group 0 is left out."""
    one = with_noise(spectrum(vis.where(F.col(group) != 0), *by, group))
    one = relative_amplitude(one, *by, group).withColumn("amp", F.col("relative")) if relative else one
    ok = finite(F.col("amp")) & finite(F.col("weight")) & (F.col("weight") > 0)
    add = lambda x: F.sum(F.when(ok, x).otherwise(0.0))
    mean = F.when(add(F.col("weight")) > 0, F.try_divide(add(F.col("weight") * F.col("amp")), add(F.col("weight")))).otherwise(_NAN)
    return one.groupBy(*by, "chan").agg(mean.alias("amp"))


def amplitude_span(vis: DataFrame, group: str, *by: str) -> DataFrame:
    """by, n (groups with two valid channels at least), span (the median over them of the largest less the smallest
    relative amplitude) and a label."""
    one = relative_amplitude(with_noise(spectrum(vis.where(F.col(group) != 0), *by, group)), *by, group).where(finite(F.col("relative")))
    spans = one.groupBy(*by, group).agg((F.max("relative") - F.min("relative")).alias("x"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    found = spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(exact_median(spans.select(*by, "x"), *by), list(by))
    every = vis.select(*by).distinct().join(found, list(by), "left")
    label = F.when(F.col("n").isNull(), "no valid scans").otherwise(F.format_string("median rel amp span %.3f", "median"))
    return every.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.col("median").alias("span"), label.alias("label"))


def phase_coherence(spectra: DataFrame, *by: str) -> DataFrame:
    """by, coherence, loss (percent), rms (degrees) and n channels of spectra with re, im, weight; none without channels."""
    amp = F.hypot("re", "im")
    rows = spectra.where((F.col("weight") > 0) & finite(F.col("weight")) & finite(F.col("re")) & finite(F.col("im")) & (amp > 0))
    unit = lambda c: F.sum(F.col("weight") * F.col(c) / amp)
    out = rows.groupBy(*by).agg(unit("re").alias("x"), unit("im").alias("y"), F.sum("weight").alias("d"), F.count(F.lit(1)).alias("n"))
    c = F.least(F.greatest(F.hypot("x", "y") / F.col("d"), F.lit(0.0)), F.lit(1.0))
    rms = F.when(F.col("coherence") > 0, F.degrees(F.sqrt(F.greatest(-2 * F.ln("coherence"), F.lit(0.0))))).otherwise(float("inf"))
    return out.withColumn("coherence", c).select(*by, "coherence", (100 * (1 - F.col("coherence"))).alias("loss"), rms.alias("rms"), "n")


def residual_coherence(vis: DataFrame, group: str, *by: str) -> DataFrame:
    """by, coherence, loss, rms: plain means over the groups' own (group 0 is left out), and n, their number."""
    each = phase_coherence(spectrum(vis.where(F.col(group) != 0), *by, group), *by, group)
    return each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("coherence", "loss", "rms")], F.count(F.lit(1)).alias("n"))


def coherence_table(before: DataFrame, after: DataFrame, group: str, weights: str = "input", pols: Sequence[str] = PARALLEL) -> DataFrame:
    """Of each baseline and polarisation what coherence is lost before and after a correction, by improvement (largest
    first, those without one last), baseline and polarisation.

    before, after: the same samples (ant1, ant2, pol, chan, ``group``, ti). With weights "input" both sides have the
    weights before, with "native" each its own.
    """
    if weights not in ("input", "native"):
        raise ValueError("comparison weights are input or native")
    place = [group, "ti", "ant1", "ant2", "pol", "chan"]
    before, after = (df.where(F.col("pol").isin(*pols)) for df in (before, after))
    if weights == "input":
        after = after.drop("w").join(before.select(*place, "w"), place)
    key = ["ant1", "ant2", "pol"]
    sides = [residual_coherence(df, group, *key).select(*key, F.col("n").alias(f"n_{s}"), F.col("coherence").alias(f"coherence_{s}"), F.col("loss").alias(f"loss_{s}"), F.col("rms").alias(f"rms_{s}")) for df, s in ((before, "before"), (after, "after"))]
    out = sides[0].join(sides[1], key, "full").withColumn("n", F.greatest("n_before", "n_after"))
    out = out.withColumns({"improvement": F.col("loss_before") - F.col("loss_after"), "rms_improvement": F.col("rms_before") - F.col("rms_after")}).drop("n_before", "n_after")
    return out.orderBy(*by_improvement())


def by_improvement() -> list[Column]:
    last = F.when(finite(F.col("improvement")), -F.col("improvement")).otherwise(float("inf"))
    return [last, F.col("ant1"), F.col("ant2"), F.col("pol")]


def site_coherence(table: DataFrame, ant: int, pol: str | None = None, limit: int | None = None) -> DataFrame:
    """A station's rows of a coherence table: by loss after (largest first), improvement (smallest first), baseline."""
    rows = table.where((F.col("ant1") == ant) | (F.col("ant2") == ant))
    rows = rows if pol is None else rows.where(F.col("pol") == pol)
    inf = float("inf")
    out = rows.orderBy(F.when(finite(F.col("loss_after")), -F.col("loss_after")).otherwise(inf), F.when(finite(F.col("improvement")), F.col("improvement")).otherwise(inf), "ant1", "ant2", "pol")
    return out if limit is None else out.limit(limit)


def phase_mean(rows: DataFrame, *by: str) -> DataFrame:
    """by, mean: the direction of the sum of weight e^(i phase)."""
    return rows.groupBy(*by).agg(F.atan2(F.sum(F.col("weight") * F.sin("phase")), F.sum(F.col("weight") * F.cos("phase"))).alias("mean"))


def complex_correction(rows: DataFrame, *by: str) -> DataFrame:
    """by, re, im: the geometric mean of amplitudes and the circular one of phases, of samples (re, im, weight)."""
    w = F.col("weight")
    phase = F.atan2("im", "re")
    out = rows.groupBy(*by).agg((F.sum(w * F.ln(F.hypot("re", "im"))) / F.sum(w)).alias("l"), F.atan2(F.sum(w * F.sin(phase)), F.sum(w * F.cos(phase))).alias("p"))
    return out.select(*by, (F.exp("l") * F.cos("p")).alias("re"), (F.exp("l") * F.sin("p")).alias("im"))


def feed_support(vis: DataFrame, *by: str) -> DataFrame:
    """ant, feed, by, support: the weights of all products, the first feed's at the first antenna, the second's at the
    second."""
    pairs = vis.where(weighted()).groupBy("ant1", "ant2", "pol", *by).agg(F.sum("w").alias("x_"))
    ends = F.array(F.struct(F.col("ant1").alias("ant"), feed(F.col("pol"), 1).alias("feed")), F.struct(F.col("ant2").alias("ant"), feed(F.col("pol"), 2).alias("feed")))
    return pairs.select(*by, "x_", F.inline(ends)).groupBy("ant", "feed", *by).agg(F.sum("x_").alias("support"))


def parallel_mask(baselines: DataFrame, antennas: DataFrame) -> DataFrame:
    """baselines (ant1, ant2) with mask_1 and mask_2: whether both antennas' first, or second, feeds have one label."""
    one, two = (antennas.select(F.col("ant").alias(f"ant{i}"), F.col("feed_1").alias(f"p{i}"), F.col("feed_2").alias(f"q{i}")) for i in (1, 2))
    out = baselines.join(one, "ant1", "left").join(two, "ant2", "left")
    return out.select(*baselines.columns, (F.col("p1") == F.col("p2")).alias("mask_1"), (F.col("q1") == F.col("q2")).alias("mask_2"))


def parallel_support(vis: DataFrame, group: str, *by: str) -> DataFrame:
    """by (with pol): of each parallel hand valid samples and weight, groups with data, the least and most valid samples
    of a group and of a channel (those of any baseline or hand count, with 0 where there's none).

    vis: averages, a row for each group and channel at most.
    """
    ok = sampled(im="im")
    rows = vis.where(is_parallel(F.col("pol")))
    n = lambda x: F.sum(x.cast("long"))
    total = rows.groupBy(*by).agg(n(ok).alias("n_valid"), F.sum(F.when(ok, F.col("w")).otherwise(0.0)).alias("weight"))

    def ends(axis: str, name: str) -> DataFrame:
        some = rows.where(ok).groupBy(*by, axis).agg(F.count(F.lit(1)).alias("n"))
        all_ = F.broadcast(vis.agg(F.countDistinct(axis).alias("all_")))  # one row
        found = some.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("n").alias("low"), F.max("n").alias(f"most_{name}")).join(all_)
        return found.select(*by, f"n_{name}", F.when(F.col(f"n_{name}") < F.col("all_"), 0).otherwise(F.col("low")).alias(f"least_{name}"), f"most_{name}")

    out = total.join(ends(group, "group"), list(by), "left").join(ends("chan", "chan"), list(by), "left").drop("n_chan")
    return out.na.fill(0, ["n_group", "least_group", "most_group", "least_chan", "most_chan"])


def mean_phase(vis: DataFrame, *by: str) -> DataFrame:
    """by, phase: the direction of the sum of w v / |v|."""
    amp = F.hypot("re", "im")
    rows = vis.where(sampled(im="im") & (amp > 0))
    return rows.groupBy(*by).agg(F.atan2(F.sum(F.col("w") * F.col("im") / amp), F.sum(F.col("w") * F.col("re") / amp)).alias("phase"))


def site_support(vis: DataFrame, ant: int) -> DataFrame:
    """A station's baselines with valid samples and weights of both parallel hands and their ratios, by that of weights."""
    from interfera.operators.diagnostics import parallel_support as both

    return both(vis.where((F.col("ant1") == ant) | (F.col("ant2") == ant)), "ant1", "ant2").orderBy("weight_ratio", "ant1", "ant2")


def phase_reference(vis: DataFrame, blocked: Sequence[int] = ()) -> DataFrame:
    """ant, weight: the antenna of most weight in parallel hands that isn't blocked, the first of equals; an error when
    read without any."""
    pairs = vis.where(weighted() & is_parallel(F.col("pol"))).groupBy("ant1", "ant2").agg(F.sum("w").alias("x"))
    ends = pairs.select(F.explode(F.array("ant1", "ant2")).alias("ant"), "x").where(~F.col("ant").isin(*blocked) if blocked else F.lit(True))
    best = ends.groupBy("ant").agg(F.sum("x").alias("weight")).agg(F.max(F.struct("weight", (-F.col("ant")).alias("a"))).alias("b"))
    found = F.when(F.col("b").isNotNull(), -F.col("b.a")).otherwise(F.raise_error(F.lit("no antenna for a phase reference")).cast("int"))
    return best.select(found.alias("ant"), F.col("b.weight").alias("weight"))


def limits(rows: DataFrame, *by: str, pad: float = 0.08, least: float = 1e-3, cap: float = 0.5) -> DataFrame:
    """by, lo, hi: what an axis must show of ``value`` and its ``noise``; none without a finite value."""
    ok, noisy = finite(F.col("value")), finite(F.col("noise")) & (F.col("noise") > 0)
    out = rows.groupBy(*by).agg(F.min(F.when(ok, F.col("value"))).alias("a"), F.max(F.when(ok, F.col("value"))).alias("b"), F.coalesce(F.max(F.when(noisy, F.col("noise"))), F.lit(0.0)).alias("n")).where("a IS NOT NULL")
    span = F.col("b") - F.col("a")
    scale = F.when(span > 0, span).otherwise(F.greatest(F.abs("a"), F.abs("b"), F.lit(1.0)))
    more = F.greatest(F.lit(least), pad * scale) + F.least(F.col("n"), cap * scale)
    return out.select(*by, (F.col("a") - more).alias("lo"), (F.col("b") + more).alias("hi"))


def shared_track(tracks: DataFrame, track: str, *by: str, atol: float = 1e-12, rtol: float = 1e-9) -> DataFrame:
    """by, chan, value of those whose tracks (``track``, chan, value) all agree: finite in the same channels, and there as
    good as equal to the first one. Tracks without a finite value don't count."""
    ok = finite(F.col("value"))
    some = tracks.where(ok)
    shape = some.groupBy(*by, track).agg(F.array_sort(F.collect_list("chan")).alias("mask"))
    alike = shape.groupBy(*by).agg(F.countDistinct("mask").alias("masks"), F.min(track).alias("first_")).where("masks = 1")
    first = some.join(alike, list(by)).where(F.col(track) == F.col("first_")).select(*by, "chan", F.col("value").alias("v0"))
    close = F.abs(F.col("value") - F.col("v0")) <= F.greatest(F.lit(atol), rtol * F.greatest(F.abs("value"), F.abs("v0")))
    every = some.join(first, [*by, "chan"]).groupBy(*by).agg(F.min(close.cast("int")).alias("close")).where("close = 1")
    return first.join(every, list(by), "left_semi").withColumnRenamed("v0", "value")


def blocks(chan: Column, size: int) -> Column:
    """The block (from 0) of a channel (from 1)."""
    return F.floor((chan - 1) / size).cast("int")


def coordinate(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """Adds ``coordinate`` to rows (by, chan, x, valid): x by its largest valid size; in blocks of ``size`` channels less
    the valid ones' mean first, and 0 in a block without any."""
    if not size:
        scale = F.max(F.when(F.col("valid"), F.abs("x"))).over(W.partitionBy(*by)) if by else F.max(F.when(F.col("valid"), F.abs("x"))).over(W.partitionBy())
        return rows.withColumn("coordinate", F.when(scale > 0, F.col("x") / scale).otherwise(0.0))
    block = W.partitionBy(*by, "block_")
    out = rows.withColumn("block_", blocks(F.col("chan"), size)).withColumn("c_", F.col("x") - F.avg(F.when(F.col("valid"), F.col("x"))).over(block))
    scale = F.max(F.when(F.col("valid"), F.abs("c_"))).over(block)
    return out.withColumn("coordinate", F.when(scale > 0, F.col("c_") / scale).otherwise(0.0)).drop("block_", "c_")


def by_chi_square(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """Residual statistics by chi-square of a real (largest first, those without one last), baseline, polarisation."""
    out = stats.orderBy(F.when(finite(F.col("chi2_per_real")), -F.col("chi2_per_real")).otherwise(float("inf")), "ant1", "ant2", "pol")
    return out if limit is None else out.limit(limit)


def before_after(before: DataFrame, after: DataFrame, ant1: int, ant2: int, pol: str) -> DataFrame:
    """Samples of a baseline and polarisation of two sets side by side: partition_key, ti, chan, and re, im, w with _b and
    _a. Partitions that lack the baseline in either aren't there."""
    one = lambda df, s: df.where((F.col("ant1") == ant1) & (F.col("ant2") == ant2) & (F.col("pol") == pol)).select("partition_key", "ti", "chan", *[F.col(c).alias(f"{c}_{s}") for c in ("re", "im", "w")])
    return one(before, "b").join(one(after, "a"), ["partition_key", "ti", "chan"])


def corrected(vis: DataFrame) -> DataFrame:
    """Adds c_re and c_im, v / (g_a conj(g_b)), to samples with gains (ar, ai, br, bi)."""
    c = div((F.col("re"), F.col("im")), mul((F.col("ar"), F.col("ai")), conj((F.col("br"), F.col("bi")))))
    return vis.withColumns({"c_re": c[0], "c_im": c[1]})


def normalised_residual(res: DataFrame) -> DataFrame:
    """Adds n_re and n_im, sqrt(w) (v - m), and sigma, 1 / sqrt(w), to ``calibrate.residuals``."""
    s = F.sqrt("w")
    return res.withColumns({"n_re": s * F.col("r_re"), "n_im": s * F.col("r_im"), "sigma": 1 / s})


def gain_series(gains: DataFrame, quantity: str = "phase", relative: bool = True, by: Sequence[str] = ("spw", "slot", "ant", "feed")) -> DataFrame:
    """by, chan, value: phases or amplitudes of gains (g_re, g_im), relative to the first channel's, or plain."""
    if quantity not in ("phase", "amplitude"):
        raise ValueError("the quantity is phase or amplitude")
    name = "phase" if quantity == "phase" else "amp"
    value = F.atan2("g_im", "g_re") if quantity == "phase" else F.hypot("g_re", "g_im")
    out = gains.withColumn(name, F.when(finite(F.col("g_re")) & finite(F.col("g_im")), value).otherwise(_NAN))
    if relative:
        out = (relative_phase if quantity == "phase" else relative_amplitude)(out, *by).withColumn(name, F.col("relative"))
    return out.select(*by, "chan", F.col(name).alias("value"))


def gain_label(quantity: str, relative: bool = True) -> str:
    labels = {("phase", True): "gain phase rel. to ref (rad)", ("phase", False): "gain phase (rad)", ("amplitude", True): "gain amp / ref", ("amplitude", False): "gain amp"}
    if (quantity, relative) not in labels:
        raise ValueError("the quantity is phase or amplitude")
    return labels[quantity, relative]


def choose_pols(pols: Sequence[str], wish: str | int | Sequence = "parallel") -> list[str]:
    """Polarisations by "parallel", "all", place (from 1), name, or 11, 22, 12 and 21 for feeds; several as a list."""
    if not isinstance(wish, (str, int)):
        return [p for w in wish for p in choose_pols(pols, w)]
    feeds = {"11": "PP", "22": "QQ", "12": "PQ", "21": "QP"}
    if isinstance(wish, int):
        found = list(pols[wish - 1 : wish]) if wish >= 1 else []
    elif wish in ("parallel", "all"):
        found = list(pols) if wish == "all" else [p for p in PARALLEL if p in pols]
        found = found if wish == "all" or len(found) == 2 else []
    else:
        name = wish if wish in pols else feeds.get(wish, wish)
        found = [name] if name in pols else []
    if not found:
        raise ValueError(f"no polarisation {wish} in {list(pols)}")
    return found


def choose_feeds(wish: str | int | Sequence = "all") -> list[int]:
    """Feeds 1 and 2 by "all" or "parallel", place, "11" or "22" (also "Pol 1", "Pol 2"); several as a list."""
    if not isinstance(wish, (str, int)):
        return [f for w in wish for f in choose_feeds(w)]
    known = {"all": [1, 2], "parallel": [1, 2], 1: [1], 2: [2], "11": [1], "Pol 1": [1], "22": [2], "Pol 2": [2]}
    if wish not in known:
        raise ValueError(f"no feed {wish}")
    return known[wish]


def choose_sites(names: Sequence[str], wish: str | int | Sequence = "all") -> list[int]:
    """Places (from 1) of stations by "all", place or name; several as a list."""
    if wish == "all":
        return list(range(1, len(names) + 1))
    if not isinstance(wish, (str, int)):
        return [s for w in wish for s in choose_sites(names, w)]
    found = wish if isinstance(wish, int) else list(names).index(wish) + 1 if wish in names else 0
    if not 1 <= found <= len(names):
        raise ValueError(f"no station {wish} in {list(names)}")
    return [found]


# --- what figures show -----------------------------------------------------------------------------------------------


def stability(before: DataFrame, after: DataFrame, ant1: int, ant2: int, group: str, quantity: str = "phase", pols: Sequence[str] = PARALLEL, relative: bool = False, weights: str = "input") -> DataFrame:
    """A figure's points of a baseline before and after a correction: side, pol, ``group`` (null: all together), chan,
    value, noise."""
    if weights not in ("input", "native"):
        raise ValueError("comparison weights are input or native")
    place = [group, "ti", "ant1", "ant2", "pol", "chan"]
    of = lambda df: df.where((F.col("ant1") == ant1) & (F.col("ant2") == ant2) & F.col("pol").isin(*pols))
    before, after = of(before), of(after)
    if weights == "input":
        after = after.drop("w").join(before.select(*place, "w"), place)
    out = None
    for side, df in (("before", before), ("after", after)):
        each = series(df, "pol", group, quantity=quantity, relative=relative)
        if quantity == "phase":
            whole = series(df, "pol", quantity=quantity, relative=relative)
        else:
            whole = scan_averaged_amplitude(df, group, "pol", relative=relative).withColumnRenamed("amp", "value").withColumn("noise", F.lit(_NAN))
        both = each.unionByName(whole.withColumn(group, F.lit(None).cast(each.schema[group].dataType))).withColumn("side", F.lit(side))
        out = both if out is None else out.unionByName(both)
    return out.select("side", "pol", group, "chan", "value", "noise")


def baseline_phases(before: DataFrame, after: DataFrame, ant1: int, ant2: int, group: str, relative: bool = True, pols: Sequence[str] = PARALLEL) -> DataFrame:
    """Phases of each scan of a baseline before and after: side, pol, group, chan, value, noise."""
    return stability(before, after, ant1, ant2, group, "phase", pols, relative).where(F.col(group).isNotNull())


def gain_solutions(gains: DataFrame, quantity: str = "phase", feeds: Sequence[int] = (1, 2), ants: Sequence[int] | None = None, relative: bool = True) -> DataFrame:
    """Gains' tracks to draw: spw, slot (null where all scans share one track), ant, feed, chan, value."""
    some = gains.where(F.col("feed").isin(*feeds)) if ants is None else gains.where(F.col("feed").isin(*feeds) & F.col("ant").isin(*ants))
    tracks = gain_series(some, quantity, relative)
    key = ["spw", "ant", "feed"]
    shared = shared_track(tracks, "slot", *key)
    own = tracks.join(shared.select(*key).distinct(), key, "left_anti")
    return shared.withColumn("slot", F.lit(None).cast("int")).unionByName(own).select("spw", "slot", *key[1:], "chan", "value")


def baseline_bandpass(res: DataFrame, ant1: int, ant2: int, group: str, pols: Sequence[str] = PARALLEL, by_source: bool = False) -> DataFrame:
    """Observed and modelled amplitudes and phases with noise of a baseline, by pol, group and channel; by_source: divided
    by the source's coherency. res: ``calibrate.residuals`` of averages, with s_re and s_im."""
    rows = res.where((F.col("ant1") == ant1) & (F.col("ant2") == ant2) & F.col("pol").isin(*pols))
    v, m, s = ((F.col(f"{p}re"), F.col(f"{p}im")) for p in ("", "m_", "s_"))
    scale = F.lit(1.0)
    if by_source:
        rows, scale = rows.where(abs2(s) > 0), F.sqrt(abs2(s))
        v, m = div(v, s), div(m, s)
    amp = F.hypot(*v)
    sigma = 1 / F.sqrt("w") / scale
    return rows.select("pol", group, "chan", amp.alias("amp"), sigma.alias("amp_noise"), F.atan2(v[1], v[0]).alias("phase"), F.when(amp > 0, sigma / amp).otherwise(_NAN).alias("phase_noise"), F.hypot(*m).alias("model_amp"), F.atan2(m[1], m[0]).alias("model_phase"))


def baseline_residuals(res: DataFrame, ant1: int, ant2: int, group: str, pols: Sequence[str] = PARALLEL) -> DataFrame:
    """Residuals over their noise of a baseline: pol, group, chan, n_re, n_im, size and phase."""
    rows = normalised_residual(res.where((F.col("ant1") == ant1) & (F.col("ant2") == ant2) & F.col("pol").isin(*pols)))
    return rows.select("pol", group, "chan", "n_re", "n_im", F.hypot("n_re", "n_im").alias("size"), F.atan2("n_im", "n_re").alias("phase"))
