"""A query for each operator, and the same in SQL. Doubles are rounded, as sums depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interfera.functions import astro, names
from interfera.functions.cplx import finite, flagged, sampled, weighted
from interfera.operators import calibrate, catalog, diagnostics, reduce, select
from interfera.plans.tables import ANTENNAS, CALIBRATION_SQL, GAIN_SQL, MODEL_SQL, VIS_SQL, calibration, gains, visibilities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PARALLEL = "substr(pol, 1, 1) = substr(pol, 2, 1)"


def r(*columns: str | Column, digits: int = 6) -> list[Column]:
    return [rounded(F.col(c), digits).alias(c) if isinstance(c, str) else rounded(c, digits) for c in columns]


def rounded(x: Column, digits: int) -> Column:
    """As SQL's round of doubles does, from x * 10^digits with halves away from zero; Spark's takes the digits that it
    prints."""
    many = x * F.lit(10.0**digits)
    near = F.rint(many)
    out = F.when(F.abs(many - near) == 0.5, many + 0.5 * F.signum(many)).otherwise(near) / F.lit(10.0**digits)
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)  # NaN is larger


def query(name: str, sql: str | None = None, *, vis: bool = True, gain: bool = False):
    """Registers a function of (spark, sf_dir) or, with ``vis``, of the visibilities and gains."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = (lambda s, d: f(visibilities(s, d), gains(s)) if gain else f(visibilities(s, d))) if vis else f
        if sql:
            with_ = ", ".join(([VIS_SQL] if vis else []) + ([GAIN_SQL] if gain else []))
            SQL[name] = (f"WITH {with_}" + (", " + sql[5:] if sql.startswith("WITH ") else "\n" + sql)) if with_ else sql
        return f

    return add


@query("scan_average", """SELECT scan, ant1, ant2, pol, chan, round(W, 6) AS weight, CASE WHEN W > 0 THEN round(x / W, 6) ELSE 'nan'::DOUBLE END AS re, CASE WHEN W > 0 THEN round(y / W, 6) ELSE 'nan'::DOUBLE END AS im, W <= 0 AS flag
 FROM (SELECT scan, ant1, ant2, pol, chan, sum(CASE WHEN ok1 THEN w ELSE 0.0 END) AS W, sum(CASE WHEN ok1 THEN w * re ELSE 0.0 END) AS x, sum(CASE WHEN ok1 THEN w * im ELSE 0.0 END) AS y FROM vis GROUP BY ALL)""")  # fmt: skip
def _(vis):
    key = ["scan", "ant1", "ant2", "pol", "chan"]
    return reduce.scan_average(vis, *key).select(*key, *r("weight", "re", "im"), "flag")


@query("uvw_average", "SELECT scan, ant1, ant2, " + ", ".join(f"round(sum(CASE WHEN ok1 AND isfinite({c}) THEN w * {c} ELSE 0.0 END) / nullif(sum(CASE WHEN ok1 THEN w ELSE 0.0 END), 0), 6) AS {c}" for c in ("u", "v", "uw")) + " FROM vis GROUP BY ALL")
def _(vis):
    return reduce.uvw_average(vis, "scan", "ant1", "ant2").select("scan", "ant1", "ant2", *r("u", "v", "uw"))


@query("flag_derive", "SELECT scan, pol, w <= 0 AS flag, count(*) AS n FROM vis GROUP BY ALL")
def _(vis):
    return vis.groupBy("scan", "pol", flagged().alias("flag")).agg(F.count(F.lit(1)).alias("n"))


_SHOWN = ["ant1", "ant2", "chan", "pol", "scan"]
_ROWS = ", ".join(_SHOWN) + ", round(re, 6) AS re, round(w, 6) AS w"


def _rows(vis: DataFrame) -> DataFrame:
    return vis.select(*_SHOWN, *r("re", "w"))


@query("select_source", f"SELECT {_ROWS} FROM vis WHERE source_name = '3C2'")
def _(vis):
    return _rows(select.source(vis, "3C2"))


@query("select_scan", f"SELECT {_ROWS} FROM vis WHERE source_name = '3C1' AND scan = 199801")
def _(vis):
    return _rows(select.partition(vis, source_name="3C1", scan=199801))


@query("select_partition", f"SELECT {_ROWS} FROM vis WHERE source_name = '3C3' AND pol = 'PP'")
def _(vis):
    return _rows(select.partition(vis, source_name="3C3", scan=None, pol="PP"))


@query("select_station", f"SELECT {_ROWS} FROM vis WHERE ant1 = 3 OR ant2 = 3")
def _(vis):
    return _rows(select.station(vis, 3))


@query("select_baseline", f"SELECT {_ROWS} FROM vis WHERE ant1 = 2 AND ant2 = 5")
def _(vis):
    return _rows(select.baseline(vis, 2, 5))


@query("time_window", f"SELECT {_ROWS} FROM vis WHERE ts BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-09-30'")
def _(vis):
    return _rows(select.time_window(vis, "1997-03-01", "1997-09-30"))


@query("merge_union", "SELECT partition_key, count(*) AS n FROM vis GROUP BY ALL")
def _(vis):
    early = F.col("scan") < 199800
    return select.merge(vis.where(early), vis.where(~early)).groupBy("partition_key").agg(F.count(F.lit(1)).alias("n"))


@query("baseline_concat", "SELECT *, dense_rank() OVER (PARTITION BY ant1, ant2 ORDER BY scan) AS place FROM (SELECT ant1, ant2, pol, chan, scan, count(*) AS n FROM vis GROUP BY ALL)")
def _(vis):
    from pyspark.sql import Window as W

    some = vis.groupBy("ant1", "ant2", "pol", "chan", "scan").agg(F.count(F.lit(1)).alias("n"))
    return some.withColumn("place", F.dense_rank().over(W.partitionBy("ant1", "ant2").orderBy("scan")).cast("long"))


@query("sources_first_seen", "SELECT source_name, min(scan) AS first_scan FROM vis GROUP BY ALL")
def _(vis):
    return catalog.sources(vis)


@query("summary", "SELECT source_name, scan, count(DISTINCT chan) AS n_chan, count(DISTINCT ts) AS n_time, count(DISTINCT ant1 * 100 + ant2) AS n_baseline, count(DISTINCT pol) AS n_pol, count(*) AS n_record FROM vis GROUP BY ALL")
def _(vis):
    return catalog.summary(vis)


@query("scan_window", "SELECT scan, round(lo, 6) AS lo, round(hi, 6) AS hi, round((lo + hi) / 2, 6) AS center FROM (SELECT scan, min(epoch_us(ts) / 3.6e9) AS lo, max(epoch_us(ts) / 3.6e9) AS hi FROM vis GROUP BY ALL)")
def _(vis):
    return catalog.scan_window(vis).select("scan", *r("lo", "hi", "center"))


@query("participating_antennas", "SELECT scan, string_agg(CAST(ant AS VARCHAR), ',' ORDER BY ant) AS antennas FROM (SELECT scan, ant1 AS ant FROM vis UNION SELECT scan, ant2 FROM vis) GROUP BY scan")
def _(vis):
    return catalog.participating_antennas(vis)


@query("union_antennas", "SELECT n_name, n_regionkey FROM nation", vis=False)
def _(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey")
    return catalog.unique_or_error(nation.unionAll(nation), ["n_name"], ["n_regionkey"], "unlike antennas named ")


@query("sanitize_source", """SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'unknown' WHEN regexp_matches(trim(p_name), '^[0-9]') THEN 'M' || regexp_replace(trim(p_name), '[^A-Za-z0-9_]', '_', 'g') ELSE regexp_replace(trim(p_name), '[^A-Za-z0-9_]', '_', 'g') END AS source_key FROM part""", vis=False)
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", names.sanitize_source(F.col("p_name")).alias("source_key"))


@query("partition_key", "SELECT p_partkey, concat_ws('_', nullif(p_brand, ''), 'spw_0', nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, '')) AS k FROM part", vis=False)
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    sub = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_size").cast("string"))
    return part.select("p_partkey", names.partition_key(F.col("p_brand"), F.lit("spw_0"), sub).alias("k"))


@query("pol_fold", "SELECT p_partkey, translate(upper(trim(p_type)), 'RXLY', 'PPQQ') AS folded FROM part", vis=False)
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", names.fold_pol(F.col("p_type")).alias("folded"))


@query("baseline_code", "SELECT DISTINCT ant1, ant2, ant1 * 256 + ant2 AS code, ant1 AS a, ant2 AS b FROM vis")
def _(vis):
    coded = vis.select("ant1", "ant2").distinct().withColumn("code", names.encode_baseline(F.col("ant1"), F.col("ant2")))
    a, b = names.decode_baseline(F.col("code"))
    return coded.select("*", a.alias("a"), b.alias("b"))


_M = "kr * kr + ki * ki"
_S = f"""s AS (SELECT scan, ant1, ant2, pol, CASE WHEN d > 0 THEN x / d ELSE 0 END AS s_re, CASE WHEN d > 0 THEN y / d ELSE 0 END AS s_im FROM (SELECT scan, ant1, ant2, pol,
 sum(CASE WHEN {MODEL_SQL} THEN w * (re * kr + im * ki) ELSE 0.0 END) AS x, sum(CASE WHEN {MODEL_SQL} THEN w * (im * kr - re * ki) ELSE 0.0 END) AS y, sum(CASE WHEN {MODEL_SQL} THEN w * ({_M}) ELSE 0.0 END) AS d FROM vg GROUP BY ALL)),
rr AS (SELECT vg.*, pow(re - (kr * s_re - ki * s_im), 2) + pow(im - (kr * s_im + ki * s_re), 2) AS rr FROM vg JOIN s USING (scan, ant1, ant2, pol) WHERE {MODEL_SQL})"""
_CELL = ["scan", "ant1", "ant2", "pol"]


@query("apply_bandpass", f"SELECT {', '.join(_SHOWN)}, round(CASE WHEN ok AND kr IS NOT NULL THEN coalesce((re * kr + im * ki) / nullif({_M}, 0), 'nan'::DOUBLE) ELSE re END, 6) AS re, round(CASE WHEN ok AND kr IS NOT NULL THEN coalesce((im * kr - re * ki) / nullif({_M}, 0), 'nan'::DOUBLE) ELSE im END, 6) AS im, round(CASE WHEN ok AND kr IS NOT NULL THEN w * ({_M}) ELSE w END, 6) AS w FROM vg", gain=True)
def _(vis, g):
    return calibrate.apply_gains(vis, g).select(*_SHOWN, *r("re", "im", "w"))


@query("source_coherency", f"WITH {_S} SELECT scan, ant1, ant2, pol, round(s_re, 6) AS s_re, round(s_im, 6) AS s_im FROM s", gain=True)
def _(vis, g):
    return calibrate.source_coherency(vis, g, *_CELL).select(*_CELL, *r("s_re", "s_im"))


def _residuals(vis: DataFrame, g: DataFrame) -> DataFrame:
    return calibrate.residuals(vis, g, calibrate.source_coherency(vis, g, *_CELL), *_CELL)


@query("chi2", f"WITH {_S} SELECT ant1, ant2, round(sum(w * rr), 3) AS chi2 FROM rr GROUP BY ALL", gain=True)
def _(vis, g):
    return calibrate.chi_square(vis, g, _CELL, "ant1", "ant2").select("ant1", "ant2", F.round("chi2", 3).alias("chi2"))


@query("residual_stats", f"WITH {_S} SELECT ant1, ant2, pol, count(*) AS nvis, 2 * count(*) AS nreal, round(sum(w * rr), 3) AS chi2, round(sum(w), 6) AS sum_w, round(sqrt(avg(rr)), 6) AS rms, round(sqrt(sum(w * rr) / sum(w)), 6) AS wrms, round(sqrt(sum(w * rr) / count(*)), 6) AS norm_rms, round(sum(w * rr) / count(*), 6) AS chi2_per_vis, round(sum(w * rr) / (2 * count(*)), 6) AS chi2_per_real, round(median(sqrt(w * rr)), 6) AS median_norm, round(max(sqrt(w * rr)), 6) AS max_norm FROM rr GROUP BY ALL", gain=True)
def _(vis, g):
    out = calibrate.residual_stats(_residuals(vis, g), "ant1", "ant2", "pol")
    return out.select("ant1", "ant2", "pol", "nvis", "nreal", F.round("chi2", 3).alias("chi2"), *r("sum_w", "rms", "wrms", "norm_rms", "chi2_per_vis", "chi2_per_real", "median_norm", "max_norm"))


@query("fit_stats", f"WITH {_S} SELECT (SELECT count(*) FROM vis WHERE ok) AS nvis_weighted, count(*) AS nvis, round(sum(w * rr), 2) AS chi2 FROM rr", gain=True)
def _(vis, g):
    stats = _residuals(vis, g).agg(F.count(F.lit(1)).alias("nvis"), F.round(F.sum(F.col("w") * F.col("rr")), 2).alias("chi2"))
    return stats.crossJoin(vis.agg(F.sum(weighted().cast("long")).alias("nvis_weighted")))  # one row by one row


_AMP = "sqrt(re * re + im * im)"


@query("coherence", f"""SELECT ant1, ant2, pol, round(c, 6) AS coherence, round(100 * (1 - c), 4) AS loss, CASE WHEN c > 0 THEN round(degrees(sqrt(greatest(-2 * ln(c), 0.0))), 4) ELSE 'inf'::DOUBLE END AS rms, n
 FROM (SELECT ant1, ant2, pol, least(greatest(sqrt(pow(sum(w * re / {_AMP}), 2) + pow(sum(w * im / {_AMP}), 2)) / sum(w), 0.0), 1.0) AS c, count(*) AS n FROM vis WHERE ok2 AND {_AMP} > 0 GROUP BY ALL)""")  # fmt: skip
def _(vis):
    return diagnostics.coherence(vis, "ant1", "ant2", "pol").select("ant1", "ant2", "pol", *r("coherence"), *r("loss", "rms", digits=4), "n")


@query("noise_series", """SELECT ant1, ant2, pol, chan, round(sqrt(x * x + y * y) / W, 6) AS amp, round(1 / sqrt(W), 6) AS sigma, round(1 / sqrt(W) / (sqrt(x * x + y * y) / W), 6) AS sigma_phase
 FROM (SELECT ant1, ant2, pol, chan, sum(w) AS W, sum(w * re) AS x, sum(w * im) AS y FROM vis WHERE ok2 GROUP BY ALL)""")  # fmt: skip
def _(vis):
    return reduce.noise(vis, "ant1", "ant2", "pol", "chan").select("ant1", "ant2", "pol", "chan", *r("amp", "sigma", "sigma_phase"))


_ENDS = "(SELECT *, unnest([ant1, ant2]) AS ant FROM vis)"


@query("support", f"SELECT ant, chan, round(sum(CASE WHEN ok2 THEN w * (re * re + im * im) ELSE 0.0 END), 4) AS support FROM {_ENDS} GROUP BY ALL")
def _(vis):
    value = F.when(sampled(im="im"), F.col("w") * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).otherwise(0.0)
    return reduce.support(vis, value, "chan").select("ant", "chan", *r("support", digits=4))


@query("amplitude_support", f"SELECT ant, chan, pol, round(sum(CASE WHEN ok THEN w ELSE 0.0 END), 6) AS support FROM {_ENDS} WHERE {_PARALLEL} GROUP BY ALL")
def _(vis):
    rows = vis.where(names.is_parallel(F.col("pol")))
    return reduce.support(rows, F.when(weighted(), F.col("w")).otherwise(0.0), "chan", "pol").select("ant", "chan", "pol", *r("support"))


@query("ref_channel", f"SELECT chan, round(sum(w), 6) AS weight FROM vis WHERE ok AND {_PARALLEL} GROUP BY chan ORDER BY weight DESC, chan LIMIT 1")
def _(vis):
    return diagnostics.reference_channel(vis).select("chan", *r("weight"))


@query("diag_baseline", f"SELECT ant1, ant2, round(sum(w), 6) AS weight FROM vis WHERE ok1 AND {_PARALLEL} GROUP BY ALL ORDER BY weight DESC, ant1, ant2 LIMIT 1")
def _(vis):
    return diagnostics.diagnostic_baseline(vis).select("ant1", "ant2", *r("weight"))


@query("parallel_hand_support", "SELECT ant1, ant2, CAST(a AS BIGINT) AS n_pp, CAST(b AS BIGINT) AS n_qq, round(p, 6) AS w_pp, round(q, 6) AS w_qq, round(b / greatest(a, 1), 6) AS count_ratio, round(q / greatest(p, 2.220446049250313e-16), 6) AS weight_ratio FROM (SELECT ant1, ant2, sum(CASE WHEN ok2 AND pol = 'PP' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN ok2 AND pol = 'QQ' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN ok2 AND pol = 'PP' THEN w ELSE 0.0 END) AS p, sum(CASE WHEN ok2 AND pol = 'QQ' THEN w ELSE 0.0 END) AS q FROM vis GROUP BY ALL)")
def _(vis):
    return diagnostics.parallel_support(vis, "ant1", "ant2").select("ant1", "ant2", "n_pp", "n_qq", *r("w_pp", "w_qq", "count_ratio", "weight_ratio"))


_TRACK = "SELECT ant1, ant2, pol, chan, {x} FROM (SELECT ant1, ant2, pol, chan, sum(w) AS W, sum(w * re) AS x, sum(w * im) AS y FROM vis WHERE ok2 GROUP BY ALL)"


def _track(vis: DataFrame, *what: str) -> DataFrame:
    mean = reduce.scan_average(vis.where(sampled(im="im")), "ant1", "ant2", "pol", "chan")
    shown = {"phase": F.atan2("im", "re") * 3, "amp": F.hypot("re", "im"), "weight": F.col("weight")}
    return mean.select("ant1", "ant2", "pol", "chan", *[shown[w].alias(w) for w in what])


_BROKEN = "(ant1 + ant2 + chan) % 5 = 0"


@query("unwrap", f"""WITH t AS ({_TRACK.format(x="CASE WHEN " + _BROKEN + " THEN NULL ELSE 3 * atan2(y, x) END AS phase, W AS weight")}),
d AS (SELECT *, coalesce(round_even((phase - lag(phase) OVER (PARTITION BY ant1, ant2, pol ORDER BY chan)) / (2 * pi()), 0), 0.0) AS k FROM t WHERE phase IS NOT NULL),
e AS (SELECT *, sum(k) OVER (PARTITION BY ant1, ant2, pol ORDER BY chan) AS s FROM d), m AS (SELECT *, first_value(s) OVER (PARTITION BY ant1, ant2, pol ORDER BY weight DESC, chan) AS seed FROM e)
SELECT ant1, ant2, pol, chan, round(phase - 2 * pi() * (s - seed), 5) AS unwrapped FROM m UNION ALL SELECT ant1, ant2, pol, chan, 'nan'::DOUBLE FROM t WHERE phase IS NULL""")  # fmt: skip
def _(vis):
    track = _track(vis, "phase", "weight").withColumn("phase", F.when(F.expr(_BROKEN), float("nan")).otherwise(F.col("phase")))
    return diagnostics.unwrap(track, "ant1", "ant2", "pol", weight="weight").select("ant1", "ant2", "pol", "chan", *r("unwrapped", digits=5))


_SCALE = f"""t AS ({_TRACK.format(x="CASE WHEN " + _BROKEN + " THEN CASE WHEN chan % 2 = 0 THEN 0.0 ELSE 'nan'::DOUBLE END WHEN (ant1 + chan) % 4 = 0 THEN sqrt(x * x + y * y) / W / 50 ELSE sqrt(x * x + y * y) / W END AS amp, atan2(y, x) AS phase")}),
n AS (SELECT a.ant1, a.ant2, a.pol, a.chan, a.amp, a.phase, CASE WHEN count(b.amp) FILTER (abs(a.chan - b.chan) <= 2) >= 2 THEN median(b.amp) FILTER (abs(a.chan - b.chan) <= 2) ELSE median(b.amp) END AS scale
FROM t a LEFT JOIN t b ON a.ant1 = b.ant1 AND a.ant2 = b.ant2 AND a.pol = b.pol AND a.chan <> b.chan AND isfinite(b.amp) AND b.amp > 0 GROUP BY ALL)"""


def _amplitudes(vis: DataFrame) -> DataFrame:
    """Tracks with broken and with low amplitudes."""
    low = F.when(F.expr("(ant1 + chan) % 4 = 0"), F.col("amp") / 50).otherwise(F.col("amp"))
    broken = F.when(F.col("chan") % 2 == 0, 0.0).otherwise(float("nan"))
    return _track(vis, "amp", "phase").withColumn("amp", F.when(F.expr(_BROKEN), broken).otherwise(low))


@query("neighbor_median", f"WITH {_SCALE} SELECT ant1, ant2, pol, chan, round(scale, 6) AS scale FROM n")
def _(vis):
    return diagnostics.neighbour_median(_amplitudes(vis), "ant1", "ant2", "pol").select("ant1", "ant2", "pol", "chan", *r("scale"))


@query("collapsed", f"WITH {_SCALE} SELECT ant1, ant2, pol, chan, round(amp, 6) AS amp, round(scale, 6) AS scale FROM n WHERE isfinite(amp) AND amp > 0 AND scale IS NOT NULL AND (amp < 0.01 OR amp < 0.05 * scale)")
def _(vis):
    return diagnostics.collapsed(_amplitudes(vis), "ant1", "ant2", "pol").select("ant1", "ant2", "pol", "chan", *r("amp", "scale"))


@query("sanitize_amplitudes", f"WITH {_SCALE} SELECT ant1, ant2, pol, chan, NOT (isfinite(amp) AND amp > 0) AND scale IS NOT NULL AS repaired, round(CASE WHEN NOT (isfinite(amp) AND amp > 0) AND scale IS NOT NULL THEN scale ELSE amp END, 6) AS amp, round(3 * phase, 5) AS phase FROM n")
def _(vis):
    return diagnostics.sanitized(_amplitudes(vis), "ant1", "ant2", "pol").select("ant1", "ant2", "pol", "chan", "repaired", *r("amp"), *r("phase", digits=5))


@query("log_ratio_weight", """WITH t AS (SELECT ant1, ant2, pol, scan, chan, max(re * re + im * im) AS v2, max(w) AS w FROM vis WHERE ok2 GROUP BY ALL)
SELECT a.ant1, a.ant2, a.pol, a.scan, a.chan, round(CASE WHEN a.v2 * a.w > 0 AND b.v2 * b.w > 0 THEN 1 / (1 / (a.v2 * a.w) + 1 / (b.v2 * b.w)) ELSE 0.0 END, 6) AS weight FROM t a JOIN t b ON a.ant1 = b.ant1 AND a.ant2 = b.ant2 AND a.pol = b.pol AND a.scan = b.scan AND b.chan = 1""")  # fmt: skip
def _(vis):
    t = vis.where(sampled(im="im")).groupBy("ant1", "ant2", "pol", "scan", "chan").agg(F.max(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v2"), F.max("w").alias("w"))
    ref = t.where("chan = 1").select("ant1", "ant2", "pol", "scan", F.col("v2").alias("v0"), F.col("w").alias("w0"))
    weight = astro.log_ratio_weight(F.col("v2"), F.col("w"), F.col("v0"), F.col("w0"))
    return t.join(ref, ["ant1", "ant2", "pol", "scan"]).select("ant1", "ant2", "pol", "scan", "chan", F.round(weight, 6).alias("weight"))


@query("design_matrix", "SELECT DISTINCT ant1, ant2, a AS ant, CASE WHEN a IN (ant1, ant2) THEN 1 ELSE 0 END AS amp, CASE WHEN a = ant1 THEN 1 WHEN a = ant2 THEN -1 ELSE 0 END AS phase FROM vis, (SELECT CAST(unnest(range(1, 8)) AS INT) AS a)")
def _(vis):
    rows = vis.select("ant1", "ant2").distinct().withColumn("ant", F.explode(F.sequence(F.lit(1), F.lit(ANTENNAS))))
    a, b = F.col("ant") == F.col("ant1"), F.col("ant") == F.col("ant2")
    return rows.select("*", (a | b).cast("int").alias("amp"), F.when(a, 1).when(b, -1).otherwise(0).alias("phase"))


@query("horner", "SELECT s_suppkey, round(0.81::DOUBLE + 0.0071::DOUBLE * el - 0.000063::DOUBLE * el * el, 6) AS gain FROM (SELECT s_suppkey, 45 + 40 * sin(s_acctbal) AS el FROM supplier)", vis=False)
def _(spark, sf_dir):
    poly = F.array(F.lit(0.81), F.lit(0.0071), F.lit(-0.000063))
    el = 45 + 40 * F.sin("s_acctbal")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.round(astro.elevation_gain(poly, el), 6).alias("gain"))


_XYZ = ("6378000 * cos(c_custkey) * cos(c_acctbal)", "6378000 * cos(c_custkey) * sin(c_acctbal)", "6356000 * sin(c_custkey)")


@query("geodetic", f"""SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT c_custkey, atan2(y, x) AS lon, atan2(z + ep2 * b * pow(sin(t), 3), p - e2 * a * pow(cos(t), 3)) AS lat FROM (
 SELECT *, atan2(z * a, p * b) AS t FROM (SELECT *, sqrt(x * x + y * y) AS p, 6378137.0::DOUBLE AS a, 6378137.0::DOUBLE * (1 - f) AS b, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep2 FROM (SELECT c_custkey, {_XYZ[0]} AS x, {_XYZ[1]} AS y, {_XYZ[2]} AS z, 1 / 298.257223563::DOUBLE AS f FROM customer))))""", vis=False)  # fmt: skip
def _(spark, sf_dir):
    c, a = F.col("c_custkey").cast("double"), F.col("c_acctbal")
    lat, lon, _ = astro.geodetic(6378000.0 * F.cos(c) * F.cos(a), 6378000.0 * F.cos(c) * F.sin(a), 6356000.0 * F.sin(c))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("tsys_window_mean", f"""WITH {CALIBRATION_SQL}, w AS (SELECT DISTINCT station, CAST(floor(t / 86400) AS BIGINT) AS name FROM cal)
SELECT w.station, name, round(coalesce(avg(value), 'nan'::DOUBLE), 6) AS mean, count(value) AS n FROM w LEFT JOIN cal e ON e.station = w.station AND isfinite(value) AND t BETWEEN name * 86400.0 AND name * 86400.0 + 1200.0 GROUP BY ALL""", vis=False)  # fmt: skip
def _(spark, sf_dir):
    rows = calibration(spark, sf_dir)
    days = rows.select("station", F.floor(F.col("t") / 86400).alias("name")).distinct()
    windows = days.select("station", "name", (F.col("name") * 86400.0).cast("double").alias("lo"), (F.col("name") * 86400.0 + 1200.0).cast("double").alias("hi"))
    return calibrate.window_mean(rows, windows).select("station", "name", *r("mean"), "n")


@query("tsys_asof_interp", f"""WITH {CALIBRATION_SQL}, r AS (SELECT station, t, min(value) AS v FROM cal WHERE isfinite(value) GROUP BY ALL), p AS (SELECT DISTINCT station, CAST(floor(t / 86400) AS BIGINT) AS day FROM r),
q AS (SELECT station, day, day * 86400.0::DOUBLE + 43200 AS t FROM p), a AS (SELECT q.*, r.t AS ta, r.v AS va FROM q ASOF LEFT JOIN r ON q.station = r.station AND q.t >= r.t),
b AS (SELECT a.*, r.t AS tb, r.v AS vb FROM a ASOF LEFT JOIN r ON a.station = r.station AND a.t <= r.t)
SELECT station, day, round(CASE WHEN ta IS NULL OR tb IS NULL THEN 'nan'::DOUBLE WHEN ta = tb THEN va ELSE va + (t - ta) / (tb - ta) * (vb - va) END, 5) AS value FROM b""", vis=False)  # fmt: skip
def _(spark, sf_dir):
    rows = calibration(spark, sf_dir).where(finite(F.col("value"))).select("station", "t", "value")
    days = rows.select("station", F.floor(F.col("t") / 86400).alias("day")).distinct()
    points = days.select("station", "day", (F.col("day") * 86400.0 + 43200).cast("double").alias("t"))
    return calibrate.interpolate(rows, points).select("station", "day", *r("value", digits=5))


@query("column_priority", """WITH c AS (SELECT event_type AS station, event_id AS "at", CAST(user_id % 5 AS INT) AS channel, CASE event_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'L' ELSE 'both' END AS pol FROM events),
g AS (SELECT station, channel, pol, min("at") AS "at" FROM c GROUP BY ALL),
w AS (SELECT station, ch AS channel, p AS pol FROM (SELECT DISTINCT station FROM c), (SELECT CAST(unnest(range(1, 8)) AS INT) AS ch), (VALUES ('R'), ('L')) t(p))
SELECT w.station, w.channel, w.pol, coalesce(g1."at", g2."at", g3."at", g4."at", 0) AS place FROM w
 LEFT JOIN g g1 ON g1.station = w.station AND g1.channel = w.channel AND g1.pol = w.pol LEFT JOIN g g2 ON g2.station = w.station AND g2.channel = w.channel AND g2.pol = 'both'
 LEFT JOIN g g3 ON g3.station = w.station AND g3.channel = 0 AND g3.pol = w.pol LEFT JOIN g g4 ON g4.station = w.station AND g4.channel = 0 AND g4.pol = 'both'""", vis=False)  # fmt: skip
def _(spark, sf_dir):
    return _column_priority(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _column_priority(events: DataFrame) -> DataFrame:
    pol = F.when(F.col("event_id") % 3 == 0, "R").when(F.col("event_id") % 3 == 1, "L").otherwise("both")
    columns = events.select(F.col("event_type").alias("station"), F.col("event_id").alias("at"), (F.col("user_id") % 5).cast("int").alias("channel"), pol.alias("pol"))
    wanted = columns.select("station").distinct().select("station", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("channel")).select("*", F.explode(F.array(F.lit("R"), F.lit("L"))).alias("pol"))
    return calibrate.pick_column(columns, wanted).withColumnRenamed("at", "place")
