"""Queries of spectra, supports, choices and what figures show, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfera.functions import names
from interfera.functions.cplx import sampled
from interfera.operators import calibrate, reduce, reports, series
from interfera.plans.queries import _CELL, _M, _S, query, r
from interfera.plans.tables import ANTENNAS, gains
from interfera.solver import bandpass

_BL = ["ant1", "ant2", "pol"]
_NAN = "'nan'::DOUBLE"


def _spectra(by: str, of: str = "vis", w: str = "w", ok: str = "ok", ok2: str = "ok2") -> str:
    """SQL of ``series.with_noise(series.spectrum(...))``."""
    return f"""SELECT *, sqrt(re * re + im * im) AS amp, CASE WHEN isfinite(re) THEN atan2(im, re) ELSE {_NAN} END AS phase, CASE WHEN weight > 0 THEN 1 / sqrt(weight) ELSE {_NAN} END AS sigma FROM (
 SELECT {by}, chan, weight, CASE WHEN d > 0 THEN x / d ELSE {_NAN} END AS re, CASE WHEN d > 0 THEN y / d ELSE {_NAN} END AS im FROM (SELECT {by}, chan, sum(CASE WHEN {ok} THEN {w} ELSE 0.0 END) AS weight,
 sum(CASE WHEN {ok2} THEN {w} ELSE 0.0 END) AS d, sum(CASE WHEN {ok2} THEN {w} * re ELSE 0.0 END) AS x, sum(CASE WHEN {ok2} THEN {w} * im ELSE 0.0 END) AS y FROM {of} GROUP BY ALL))"""


_GOOD = "isfinite(amp) AND amp > 0"
_SPECTRA = f"sp AS ({_spectra('scan, ant1, ant2, pol')})"


def _relative(by: str, of: str) -> str:
    """SQL that adds ra (amplitude) and rp (phase) relative to the first good channels, and the amplitude's channel."""
    first = lambda what, good: f"(min(CASE WHEN {good} THEN {{'c': chan, 'v': {what}}} END) OVER (PARTITION BY {by}))"
    return f"""SELECT *, CASE WHEN {_GOOD} THEN amp / fa.v ELSE {_NAN} END AS ra, CASE WHEN isfinite(phase) THEN atan2(sin(phase - fp.v), cos(phase - fp.v)) ELSE {_NAN} END AS rp FROM (SELECT *, {first("amp", _GOOD)} AS fa, {first("phase", "isfinite(phase)")} AS fp FROM {of})"""


@query("amplitude_series", f"WITH t AS ({_spectra('ant1, ant2, pol')}) SELECT ant1, ant2, pol, chan, round(ra, 6) AS value, round(CASE WHEN chan = fa.c THEN 0.0 ELSE ra * sigma / amp END, 6) AS noise FROM ({_relative('ant1, ant2, pol', 't')})")
def _(vis):
    return series.series(vis, *_BL, quantity="amplitude").select(*_BL, "chan", *r("value", "noise"))


@query("phase_series", f"WITH t AS ({_spectra('ant1, ant2, pol')}) SELECT ant1, ant2, pol, chan, round(rp, 5) AS value, round(CASE WHEN chan = fa.c THEN 0.0 ELSE sigma / amp END, 6) AS noise FROM ({_relative('ant1, ant2, pol', 't')})")
def _(vis):
    return series.series(vis, *_BL, quantity="phase").select(*_BL, "chan", *r("value", digits=5), *r("noise"))


_AMPLITUDE = f"""SELECT ant1, ant2, pol, chan, CASE WHEN sum(weight) FILTER (isfinite(ra) AND weight > 0) > 0 THEN sum(weight * ra) FILTER (isfinite(ra) AND weight > 0) / sum(weight) FILTER (isfinite(ra) AND weight > 0) ELSE {_NAN} END AS amp FROM ({_relative('scan, ant1, ant2, pol', 'sp')}) GROUP BY ALL"""


@query("scan_averaged_amplitude", f"WITH {_SPECTRA} SELECT ant1, ant2, pol, chan, round(amp, 6) AS amp FROM ({_AMPLITUDE})")
def _(vis):
    return series.scan_averaged_amplitude(vis, "scan", *_BL, relative=True).select(*_BL, "chan", *r("amp"))


@query("amplitude_span", f"""WITH {_SPECTRA}, s AS (SELECT scan, ant1, ant2, pol, max(ra) - min(ra) AS x FROM ({_relative('scan, ant1, ant2, pol', 'sp')}) WHERE isfinite(ra) GROUP BY ALL HAVING count(*) >= 2)
SELECT ant1, ant2, pol, count(*) AS n, round(median(x), 6) AS span FROM s GROUP BY ALL""")  # fmt: skip
def _(vis):
    return series.amplitude_span(vis, "scan", *_BL).where("n > 0").select(*_BL, "n", *r("span"))


def _coherence(by: str, of: str) -> str:
    return f"""SELECT {by}, c AS coherence, 100 * (1 - c) AS loss, CASE WHEN c > 0 THEN degrees(sqrt(greatest(-2 * ln(c), 0.0))) ELSE 'inf'::DOUBLE END AS rms FROM (SELECT {by}, least(greatest(sqrt(pow(sum(weight * re / amp), 2) + pow(sum(weight * im / amp), 2)) / sum(weight), 0.0), 1.0) AS c FROM {of} WHERE weight > 0 AND isfinite(re) AND isfinite(im) AND amp > 0 GROUP BY ALL)"""


@query("residual_coherence", f"WITH {_SPECTRA} SELECT ant1, ant2, pol, round(avg(coherence), 6) AS coherence, round(avg(loss), 4) AS loss, round(avg(rms), 4) AS rms, count(*) AS n FROM ({_coherence('scan, ant1, ant2, pol', 'sp')}) GROUP BY ALL")
def _(vis):
    return series.residual_coherence(vis, "scan", *_BL).select(*_BL, *r("coherence"), *r("loss", "rms", digits=4), "n")


_APPLIED = f"""ap AS (SELECT scan, ant1, ant2, pol, chan, w, ok, CASE WHEN ok AND kr IS NOT NULL THEN coalesce((re * kr + im * ki) / nullif({_M}, 0), {_NAN}) ELSE re END AS re, CASE WHEN ok AND kr IS NOT NULL THEN coalesce((im * kr - re * ki) / nullif({_M}, 0), {_NAN}) ELSE im END AS im FROM vg)"""
_BEFORE_AFTER = f"""{_APPLIED}, {_SPECTRA}, sa AS ({_spectra('scan, ant1, ant2, pol', of='ap', ok2='ok AND isfinite(re) AND isfinite(im)')}),
cb AS (SELECT ant1, ant2, pol, avg(coherence) AS coherence, avg(loss) AS loss, avg(rms) AS rms, count(*) AS n FROM ({_coherence('scan, ant1, ant2, pol', 'sp')}) WHERE pol IN ('PP', 'QQ') GROUP BY ALL),
ca AS (SELECT ant1, ant2, pol, avg(coherence) AS coherence, avg(loss) AS loss, avg(rms) AS rms, count(*) AS n FROM ({_coherence('scan, ant1, ant2, pol', 'sa')}) WHERE pol IN ('PP', 'QQ') GROUP BY ALL),
tb AS (SELECT ant1, ant2, pol, greatest(cb.n, ca.n) AS n, cb.coherence AS coherence_before, ca.coherence AS coherence_after, cb.loss AS loss_before, ca.loss AS loss_after, ca.rms AS rms_after, cb.loss - ca.loss AS improvement FROM cb FULL JOIN ca USING (ant1, ant2, pol))"""


def _table(vis: DataFrame, g: DataFrame) -> DataFrame:
    # items stand for times: rows of one scan, baseline, product and channel are told apart by all that names them
    timed = vis.withColumn("ti", F.col("record"))
    return series.coherence_table(timed, calibrate.apply_gains(timed, g), "scan")


@query("coherence_table", f"WITH {_BEFORE_AFTER} SELECT ant1, ant2, pol, n, round(coherence_before, 6) AS coherence_before, round(coherence_after, 6) AS coherence_after, round(loss_before, 4) AS loss_before, round(loss_after, 4) AS loss_after, round(improvement, 4) AS improvement FROM tb", gain=True)
def _(vis, g):
    return _table(vis, g).select(*_BL, "n", *r("coherence_before", "coherence_after"), *r("loss_before", "loss_after", "improvement", digits=4))


@query("site_coherence", f"WITH {_BEFORE_AFTER} SELECT ant1, ant2, pol, n, round(loss_after, 4) AS loss_after FROM tb WHERE ant1 = 2 OR ant2 = 2 ORDER BY tb.loss_after DESC, improvement, ant1, ant2 LIMIT 5", gain=True)
def _(vis, g):
    """The five worst rows of a station."""
    return series.site_coherence(_table(vis, g), 2, limit=5).select(*_BL, "n", *r("loss_after", digits=4))


@query("coherence_report", f"WITH {_BEFORE_AFTER} SELECT rpad(ant1 || '-' || ant2, 8, ' ') || '  ' || rpad(pol, 3, ' ') || '  ' || lpad(CAST(n AS VARCHAR), 5, ' ') AS line FROM tb", gain=True)
def _(vis, g):
    return reports.coherence_lines(_table(vis, g)).select(F.substring("line", 1, 20).alias("line"))


@query("phase_mean", "SELECT scan, pol, round(atan2(sum(w * sin(atan2(im, re))), sum(w * cos(atan2(im, re)))), 5) AS mean FROM vis WHERE ok2 GROUP BY ALL")
def _(vis):
    rows = vis.where(sampled(im="im")).select("scan", "pol", F.col("w").alias("weight"), F.atan2("im", "re").alias("phase"))
    return series.phase_mean(rows, "scan", "pol").select("scan", "pol", *r("mean", digits=5))


@query("complex_correction", """SELECT scan, pol, round(exp(l) * cos(p), 5) AS re, round(exp(l) * sin(p), 5) AS im FROM (SELECT scan, pol, sum(w * ln(sqrt(re * re + im * im))) / sum(w) AS l,
 atan2(sum(w * sin(atan2(im, re))), sum(w * cos(atan2(im, re)))) AS p FROM vis WHERE ok2 GROUP BY ALL)""")  # fmt: skip
def _(vis):
    return series.complex_correction(vis.where(sampled(im="im")).withColumn("weight", F.col("w")), "scan", "pol").select("scan", "pol", *r("re", "im", digits=5))


@query("feed_support", "SELECT ant, feed, chan, round(sum(w), 6) AS support FROM (SELECT ant1 AS ant, CASE WHEN substr(pol, 1, 1) = 'P' THEN 1 ELSE 2 END AS feed, chan, w FROM vis WHERE ok UNION ALL SELECT ant2, CASE WHEN substr(pol, 2, 1) = 'P' THEN 1 ELSE 2 END, chan, w FROM vis WHERE ok) GROUP BY ALL")
def _(vis):
    return series.feed_support(vis, "chan").select("ant", "feed", "chan", *r("support"))


_MEAN = """av AS (SELECT scan, ant1, ant2, pol, chan, coalesce(sum(w) FILTER (ok1), 0.0) AS w, sum(w * re) FILTER (ok1) / sum(w) FILTER (ok1) AS re, sum(w * im) FILTER (ok1) / sum(w) FILTER (ok1) AS im FROM vis GROUP BY ALL),
ak AS (SELECT *, w > 0 AND isfinite(re) AND isfinite(im) AS ok2 FROM av)"""


def _mean(vis: DataFrame) -> DataFrame:
    return reduce.scan_average(vis, "scan", "ant1", "ant2", "pol", "chan").withColumnRenamed("weight", "w")


@query("parallel_hand_detail", f"""WITH {_MEAN}, p AS (SELECT * FROM ak WHERE substr(pol, 1, 1) = substr(pol, 2, 1)), n AS (SELECT count(DISTINCT scan) AS scans, count(DISTINCT chan) AS chans FROM ak),
b AS (SELECT ant1, ant2, pol, CAST(sum(CASE WHEN coalesce(ok2, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, sum(CASE WHEN coalesce(ok2, false) THEN w ELSE 0.0 END) AS weight FROM p GROUP BY ALL),
s AS (SELECT ant1, ant2, pol, count(*) AS n_group, min(k) AS low, max(k) AS most FROM (SELECT ant1, ant2, pol, scan, count(*) AS k FROM p WHERE ok2 GROUP BY ALL) GROUP BY ALL),
c AS (SELECT ant1, ant2, pol, count(*) AS n, min(k) AS low, max(k) AS most FROM (SELECT ant1, ant2, pol, chan, count(*) AS k FROM p WHERE ok2 GROUP BY ALL) GROUP BY ALL)
SELECT b.ant1, b.ant2, b.pol, n_valid, round(weight, 6) AS weight, coalesce(s.n_group, 0) AS n_group, CASE WHEN s.n_group = n.scans THEN s.low ELSE 0 END AS least_group, coalesce(s.most, 0) AS most_group, CASE WHEN c.n = n.chans THEN c.low ELSE 0 END AS least_chan, coalesce(c.most, 0) AS most_chan
FROM b CROSS JOIN n LEFT JOIN s USING (ant1, ant2, pol) LEFT JOIN c USING (ant1, ant2, pol)""")  # fmt: skip
def _(vis):
    return series.parallel_support(_mean(vis), "scan", *_BL).select(*_BL, "n_valid", *r("weight"), "n_group", "least_group", "most_group", "least_chan", "most_chan")


@query("mean_phase", f"WITH {_MEAN} SELECT ant1, ant2, pol, scan, round(atan2(sum(w * im / sqrt(re * re + im * im)), sum(w * re / sqrt(re * re + im * im))), 5) AS phase FROM ak WHERE ok2 AND sqrt(re * re + im * im) > 0 GROUP BY ALL")
def _(vis):
    return series.mean_phase(_mean(vis), *_BL, "scan").select(*_BL, "scan", *r("phase", digits=5))


@query("site_support", f"""WITH {_MEAN} SELECT ant1, ant2, n_pp, n_qq, round(w_pp, 6) AS w_pp, round(w_qq, 6) AS w_qq, round(n_qq / greatest(n_pp, 1), 6) AS count_ratio, round(w_qq / greatest(w_pp, 2.220446049250313e-16), 6) AS weight_ratio FROM (
 SELECT ant1, ant2, count(*) FILTER (ok2 AND pol = 'PP') AS n_pp, count(*) FILTER (ok2 AND pol = 'QQ') AS n_qq, coalesce(sum(w) FILTER (ok2 AND pol = 'PP'), 0.0) AS w_pp, coalesce(sum(w) FILTER (ok2 AND pol = 'QQ'), 0.0) AS w_qq FROM ak WHERE ant1 = 4 OR ant2 = 4 GROUP BY ALL)""")  # fmt: skip
def _(vis):
    return series.site_support(_mean(vis), 4).select("ant1", "ant2", "n_pp", "n_qq", *r("w_pp", "w_qq", "count_ratio", "weight_ratio"))


@query("phase_reference", "SELECT ant, round(sum(w), 4) AS weight FROM (SELECT ant1 AS ant, w FROM vis WHERE ok AND pol IN ('PP', 'QQ') UNION ALL SELECT ant2, w FROM vis WHERE ok AND pol IN ('PP', 'QQ')) WHERE ant NOT IN (3, 4) GROUP BY ant ORDER BY weight DESC, ant LIMIT 1")
def _(vis):
    return series.phase_reference(vis, (3, 4)).select("ant", *r("weight", digits=4))


@query("baselines_with_data", "SELECT spw, scan AS slot, ant, feed, count(*) AS n_baselines FROM (SELECT DISTINCT spw, scan, ant1, ant2, CASE WHEN pol = 'PP' THEN 1 ELSE 2 END AS feed, unnest([ant1, ant2]) AS ant FROM vis WHERE ok AND pol IN ('PP', 'QQ')) GROUP BY ALL")
def _(vis):
    return bandpass.baselines_with_data(vis.withColumnRenamed("scan", "slot"))


@query("series_limits", f"""WITH t AS ({_spectra('ant1, ant2, pol')}), v AS (SELECT ant1, ant2, pol, ra AS value, CASE WHEN chan = fa.c THEN 0.0 ELSE ra * sigma / amp END AS noise FROM ({_relative('ant1, ant2, pol', 't')})),
e AS (SELECT ant1, ant2, pol, min(value) FILTER (isfinite(value)) AS a, max(value) FILTER (isfinite(value)) AS b, coalesce(max(noise) FILTER (isfinite(noise) AND noise > 0), 0.0) AS n FROM v GROUP BY ALL),
s AS (SELECT *, CASE WHEN b > a THEN b - a ELSE greatest(abs(a), abs(b), 1.0) END AS scale FROM e WHERE a IS NOT NULL)
SELECT ant1, ant2, pol, round(a - greatest(0.001, 0.08 * scale) - least(n, 0.5 * scale), 6) AS lo, round(b + greatest(0.001, 0.08 * scale) + least(n, 0.5 * scale), 6) AS hi FROM s""")  # fmt: skip
def _(vis):
    return series.limits(series.series(vis, *_BL, quantity="amplitude"), *_BL).select(*_BL, *r("lo", "hi"))


_TRACKS = """SELECT ant, feed, chan, slot, CASE WHEN slot = 2 AND ant = 2 THEN NULL WHEN slot = 3 AND ant = 5 THEN sqrt(g_re * g_re + g_im * g_im) * 1.01 WHEN slot = 2 AND ant = 3 AND chan = 1 THEN NULL ELSE nullif(sqrt(g_re * g_re + g_im * g_im), 'nan'::DOUBLE) END AS v FROM g, (SELECT CAST(unnest(range(1, 4)) AS INT) AS slot)"""


@query("shared_tracks", f"""WITH t AS ({_TRACKS}), m AS (SELECT ant, feed, slot, list(chan ORDER BY chan) AS mask FROM t WHERE v IS NOT NULL GROUP BY ALL), a AS (SELECT ant, feed, min(slot) AS slot FROM m GROUP BY ALL HAVING count(DISTINCT mask) = 1),
f AS (SELECT t.* FROM t JOIN a USING (ant, feed, slot) WHERE v IS NOT NULL), bad AS (SELECT DISTINCT t.ant, t.feed FROM t JOIN f USING (ant, feed, chan) WHERE abs(t.v - f.v) > greatest(1e-12, 1e-9 * greatest(abs(t.v), abs(f.v))))
SELECT f.ant, f.feed, f.chan, round(f.v, 6) AS value FROM f ANTI JOIN bad USING (ant, feed)""", gain=True)  # fmt: skip
def _(vis, g):
    amp = F.hypot("g_re", "g_im")
    value = F.when(F.expr("slot = 2 AND ant = 2"), float("nan")).when(F.expr("slot = 3 AND ant = 5"), amp * 1.01).when(F.expr("slot = 2 AND ant = 3 AND chan = 1"), float("nan")).otherwise(amp)
    tracks = g.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("slot")).withColumn("value", value)
    return series.shared_track(tracks, "slot", "ant", "feed").select("ant", "feed", "chan", *r("value"))


@query("gain_solutions", "SELECT ant, feed, chan, round(CASE WHEN isfinite(a) THEN atan2(sin(p - first_value(p IGNORE NULLS) OVER w), cos(p - first_value(p IGNORE NULLS) OVER w)) ELSE 'nan'::DOUBLE END, 6) AS value FROM (SELECT ant, feed, chan, g_re AS a, CASE WHEN isfinite(g_re) THEN atan2(g_im, g_re) END AS p FROM g) WINDOW w AS (PARTITION BY ant, feed ORDER BY chan ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", gain=True)
def _(vis, g):
    return series.gain_series(g, by=("ant", "feed")).select("ant", "feed", "chan", *r("value"))


@query("segment_coordinate", """WITH x AS (SELECT scan, chan, sin(scan * chan) AS x, bool_or(w > 5 AND isfinite(w)) AS valid FROM vis GROUP BY ALL), c AS (SELECT *, (chan - 1) // 3 AS block, x - avg(x) FILTER (valid) OVER (PARTITION BY scan, (chan - 1) // 3) AS c FROM x),
s AS (SELECT *, max(abs(c)) FILTER (valid) OVER (PARTITION BY scan, block) AS sc, max(abs(x)) FILTER (valid) OVER (PARTITION BY scan) AS sx FROM c)
SELECT scan, chan, CAST(block AS INT) AS block, round(CASE WHEN sc > 0 THEN c / sc ELSE 0.0 END, 5) AS inside, round(CASE WHEN sx > 0 THEN x / sx ELSE 0.0 END, 5) AS overall FROM s""")  # fmt: skip
def _(vis):
    fine = (F.col("w") > 5) & ~F.isnan("w") & (F.col("w") < float("inf"))
    x = vis.groupBy("scan", "chan").agg(F.max(fine).alias("valid")).withColumn("x", F.sin(F.col("scan") * F.col("chan")))
    out = series.coordinate(series.coordinate(x, 3, "scan").withColumnRenamed("coordinate", "inside"), 0, "scan").withColumnRenamed("coordinate", "overall")
    return out.select("scan", "chan", series.blocks(F.col("chan"), 3).alias("block"), *r("inside", "overall", digits=5))


_STATS = "st AS (SELECT ant1, ant2, pol, count(*) AS nvis, sum(w * rr) / (2 * count(*)) AS chi2_per_real, sqrt(sum(w * rr) / count(*)) AS norm_rms, median(sqrt(w * rr)) AS median_norm, max(sqrt(w * rr)) AS max_norm FROM rr GROUP BY ALL)"


def _stats(vis: DataFrame, g: DataFrame) -> DataFrame:
    return calibrate.residual_stats(_res(vis, g), *_BL)


def _res(vis: DataFrame, g: DataFrame) -> DataFrame:
    return calibrate.residuals(vis, g, calibrate.source_coherency(vis, g, *_CELL), *_CELL)


@query("worst_residuals", f"WITH {_S}, {_STATS} SELECT ant1, ant2, pol, nvis, round(chi2_per_real, 4) AS chi2_per_real FROM st ORDER BY st.chi2_per_real DESC, ant1, ant2, pol LIMIT 10", gain=True)
def _(vis, g):
    """The ten worst."""
    return series.by_chi_square(_stats(vis, g), 10).select(*_BL, "nvis", *r("chi2_per_real", digits=4))


@query("residual_report", f"WITH {_S}, {_STATS} SELECT ant1, ant2, pol, rpad(ant1 || '-' || ant2, 8, ' ') || '  ' || rpad(pol, 3, ' ') || '  ' || lpad(CAST(nvis AS VARCHAR), 5, ' ') || '  ' || format('{{:10.3f}}', chi2_per_real) AS line FROM st", gain=True)
def _(vis, g):
    ends = F.split(F.substring("line", 1, 8), "-")
    pieces = [F.trim(ends[0]).cast("int").alias("ant1"), F.trim(ends[1]).cast("int").alias("ant2"), F.trim(F.substring("line", 11, 3)).alias("pol")]
    return reports.residual_lines(_stats(vis, g)).select(*pieces, F.substring("line", 1, 32).alias("line"))


@query("normalised_residuals", f"WITH {_S}, n AS (SELECT scan, chan, pol, sqrt(w) * (re - (kr * s_re - ki * s_im)) AS n_re, sqrt(w) * (im - (kr * s_im + ki * s_re)) AS n_im FROM rr JOIN s USING (scan, ant1, ant2, pol) WHERE ant1 = 1 AND ant2 = 2 AND pol IN ('PP', 'QQ')) SELECT pol, scan, chan, round(n_re, 4) AS n_re, round(n_im, 4) AS n_im, round(sqrt(n_re * n_re + n_im * n_im), 4) AS size FROM n", gain=True)
def _(vis, g):
    return series.baseline_residuals(_res(vis, g), 1, 2, "scan").select("pol", "scan", "chan", *r("n_re", "n_im", "size", digits=4))


@query("baseline_bandpass", f"""WITH {_S}, n AS (SELECT scan, chan, pol, w, s_re * s_re + s_im * s_im AS d, (re * s_re + im * s_im) / (s_re * s_re + s_im * s_im) AS a, (im * s_re - re * s_im) / (s_re * s_re + s_im * s_im) AS b, {_M} AS k FROM rr JOIN s USING (scan, ant1, ant2, pol) WHERE ant1 = 2 AND ant2 = 3 AND pol IN ('PP', 'QQ') AND s_re * s_re + s_im * s_im > 0)
SELECT pol, scan, chan, round(sqrt(a * a + b * b), 5) AS amp, round(1 / sqrt(w) / sqrt(d), 5) AS amp_noise, round(sqrt(k), 5) AS model_amp FROM n""", gain=True)  # fmt: skip
def _(vis, g):
    return series.baseline_bandpass(_res(vis, g), 2, 3, "scan", by_source=True).select("pol", "scan", "chan", *r("amp", "amp_noise", "model_amp", digits=5))


@query("stability", f"""WITH {_BEFORE_AFTER}, b AS (SELECT 'before' AS side, * FROM sp UNION ALL SELECT 'after', * FROM sa) SELECT side, pol, scan, chan, round(phase, 5) AS value, round(CASE WHEN {_GOOD} THEN sigma / amp ELSE {_NAN} END, 5) AS noise FROM b WHERE ant1 = 1 AND ant2 = 3 AND pol IN ('PP', 'QQ')""", gain=True)
def _(vis, g):
    timed = vis.withColumn("ti", F.col("record"))
    return series.baseline_phases(timed, calibrate.apply_gains(timed, g), 1, 3, "scan", relative=False).select("side", "pol", "scan", "chan", *r("value", "noise", digits=5))


@query("before_after", f"WITH {_APPLIED} SELECT b.scan, b.chan, count(*) AS n, round(sum(b.w) FILTER (isfinite(b.w)), 4) AS w FROM vis b WHERE ant1 = 1 AND ant2 = 2 AND pol = 'PP' GROUP BY ALL", gain=True)
def _(vis, g):
    timed = vis.withColumn("ti", F.col("record"))
    both = series.before_after(timed, calibrate.apply_gains(timed, g), 1, 2, "PP")
    fine = F.when(~F.isnan("w_b") & (F.col("w_b") < float("inf")), F.col("w_b"))
    return both.join(timed.select("partition_key", "ti", "chan", "scan"), ["partition_key", "ti", "chan"]).groupBy("scan", "chan").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(fine), 4).alias("w"))


@query("parallel_mask", "SELECT DISTINCT ant1, ant2, (ant1 % 3 = 0) = (ant2 % 3 = 0) AS mask_1, true AS mask_2 FROM vis")
def _(vis):
    spark = vis.sparkSession
    antennas = spark.createDataFrame([(a, "X" if a % 3 == 0 else "R", "L") for a in range(1, ANTENNAS + 1)], "ant int, feed_1 string, feed_2 string")
    return series.parallel_mask(vis.select("ant1", "ant2").distinct(), antennas)


@query("amplitude_notes", "SELECT ant, feed, count(*) AS n, 'channels=' || string_agg(CAST(chan AS VARCHAR), ',' ORDER BY chan) AS note FROM (SELECT ant, feed, chan FROM g WHERE sqrt(g_re * g_re + g_im * g_im) < 1.3 AND isfinite(g_re)) GROUP BY ALL", gain=True)
def _(vis, g):
    rows = g.withColumn("amp", F.hypot("g_re", "g_im")).where("amp < 1.3 AND NOT isnan(amp)").withColumn("scale", F.lit(1.0))
    return reports.amplitude_notes(rows, "neighbor_median").select("ant", "feed", "n", F.split("note", " ")[0].alias("note"))


@query("pol_products", "SELECT DISTINCT pol, CASE WHEN substr(pol, 1, 1) = 'P' THEN 1 ELSE 2 END AS fa, CASE WHEN substr(pol, 2, 1) = 'P' THEN 1 ELSE 2 END AS fb, substr(pol, 1, 1) = substr(pol, 2, 1) AS parallel FROM vis")
def _(vis):
    pol = F.col("pol")
    return vis.select("pol").distinct().select("pol", names.feed(pol, 1).alias("fa"), names.feed(pol, 2).alias("fb"), names.is_parallel(pol).alias("parallel"))


def _scan_gains(vis: DataFrame) -> DataFrame:
    """Gains of every scan of the first window but those of one source, a little late, and none but one for the other."""
    spark = vis.sparkSession
    hours = (F.unix_micros("ts") / 3.6e9).cast("double")
    ends = vis.groupBy("spw", "scan", "source_name").agg(F.min(hours).alias("lo"), F.max(hours).alias("hi"))
    kept = ends.where("(spw = 'spw_0' AND source_name <> '3C2') OR scan = 199801")
    slots = kept.select("spw", F.col("scan").alias("slot"), ((F.col("lo") + F.col("hi")) / 2 + 0.0004).alias("center"))
    return slots.join(F.broadcast(gains(spark).where("NOT isnan(g_re) AND g_re * g_re + g_im * g_im > 0")))  # 96 gains for each scan


_SCANS = "pt AS (SELECT spw, scan, source_name, partition_key, (min(epoch_us(ts) / 3.6e9) + max(epoch_us(ts) / 3.6e9)) / 2 AS center FROM vis GROUP BY ALL), sl AS (SELECT spw, scan AS slot, center + 0.0004 AS c FROM pt WHERE (spw = 'spw_0' AND source_name <> '3C2') OR scan = 199801)"


def _partitions(vis: DataFrame) -> DataFrame:
    hours = (F.unix_micros("ts") / 3.6e9).cast("double")
    ends = vis.groupBy("spw", "scan", "source_name", "partition_key").agg(F.min(hours).alias("lo"), F.max(hours).alias("hi"))
    return ends.withColumn("center", (F.col("lo") + F.col("hi")) / 2)


@query("scan_match", f"WITH {_SCANS} SELECT pt.spw, pt.scan, (SELECT min(slot) FROM sl WHERE sl.spw = pt.spw AND abs(sl.c - pt.center) <= 0.001) AS slot FROM pt")
def _(vis):
    return calibrate.match_scans(_partitions(vis), _scan_gains(vis)).select("spw", "scan", "slot")


@query("apply_bandpass_by_scan", f"""WITH {_SCANS}, ok_g AS (SELECT * FROM g WHERE isfinite(g_re) AND g_re * g_re + g_im * g_im > 0), m AS (SELECT v.*, EXISTS (SELECT 1 FROM sl WHERE sl.spw = v.spw AND sl.slot = v.scan) AS matched FROM vis v),
x AS (SELECT m.*, a.g_re * b.g_re + a.g_im * b.g_im AS kr, a.g_im * b.g_re - a.g_re * b.g_im AS ki FROM m LEFT JOIN ok_g a ON matched AND a.ant = ant1 AND a.chan = m.chan AND a.feed = CASE WHEN substr(pol, 1, 1) = 'P' THEN 1 ELSE 2 END LEFT JOIN ok_g b ON matched AND b.ant = ant2 AND b.chan = m.chan AND b.feed = CASE WHEN substr(pol, 2, 1) = 'P' THEN 1 ELSE 2 END)
SELECT record, round(CASE WHEN ok AND kr IS NOT NULL THEN (re * kr + im * ki) / ({_M}) ELSE re END, 5) AS re, round(CASE WHEN ok AND kr IS NOT NULL THEN w * ({_M}) ELSE w END, 5) AS w FROM x""", gain=True)  # fmt: skip
def _(vis, g):
    out = calibrate.apply_bandpass(vis, _partitions(vis), _scan_gains(vis))
    return out.select("record", *r("re", "w", digits=5))
