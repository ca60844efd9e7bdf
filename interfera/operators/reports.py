"""Tables as lines of text: a column ``line``, in the order of the rows given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interfera.functions.cplx import finite


def _number(c: str, digits: int, width: int) -> Column:
    return F.when(finite(F.col(c)), F.format_string(f"%{width}.{digits}f", F.col(c))).otherwise("n/a".rjust(width))


def _baseline() -> Column:
    return F.rpad(F.concat_ws("-", "ant1", "ant2"), 8, " ")


def _pol() -> Column:
    return F.rpad("pol", 3, " ")


def coherence_lines(table: DataFrame) -> DataFrame:
    parts = [_baseline(), _pol(), F.lpad(F.col("n").cast("string"), 5, " "), _number("coherence_before", 3, 10), _number("loss_before", 2, 14), _number("coherence_after", 3, 9), _number("loss_after", 2, 13), _number("improvement", 2, 10), _number("rms_after", 2, 14)]
    return table.select(F.concat_ws("  ", *parts).alias("line"))


def site_lines(table: DataFrame, ant: int) -> DataFrame:
    partner = F.when(F.col("ant1") == ant, F.col("ant2")).otherwise(F.col("ant1")).cast("string")
    parts = [_baseline(), F.rpad(partner, 7, " "), _pol(), F.lpad(F.col("n").cast("string"), 5, " "), _number("loss_before", 2, 14), _number("loss_after", 2, 13), _number("improvement", 2, 10), _number("rms_after", 2, 14)]
    return table.select(F.concat_ws("  ", *parts).alias("line"))


def residual_lines(stats: DataFrame) -> DataFrame:
    parts = [_baseline(), _pol(), F.lpad(F.col("nvis").cast("string"), 5, " "), _number("chi2_per_real", 3, 10), _number("norm_rms", 3, 8), _number("median_norm", 3, 15), _number("max_norm", 3, 15)]
    return stats.select(F.concat_ws("  ", *parts).alias("line"))


def support_lines(support: DataFrame) -> DataFrame:
    pair = lambda a, b, n: F.lpad(F.concat_ws("/", a, b), n, " ")
    parts = [_baseline(), F.lpad("pol", 3, " "), F.lpad(F.col("n_valid").cast("string"), 13, " "), F.format_string("%12.6g", "weight"), F.lpad(F.col("n_group").cast("string"), 15, " "), pair("least_group", "most_group", 18), pair("least_chan", "most_chan", 16)]
    return support.select(F.concat_ws("  ", *parts).alias("line"))


def coherence_note(stats: DataFrame, *by: str) -> DataFrame:
    """by, note: what a figure says of ``series.residual_coherence``."""
    loss = F.when(finite(F.col("loss")), F.format_string("scan loss %.2f%%", "loss")).otherwise("scan loss n/a")
    rms = F.when(finite(F.col("rms")), F.format_string("scan rms %.1f deg", "rms")).otherwise("scan rms n/a")
    return stats.select(*by, F.when(F.col("n") == 0, "no valid scans").otherwise(F.concat_ws("\n", loss, rms)).alias("note"))


def residual_note(stats: DataFrame, *by: str) -> DataFrame:
    return stats.select(*by, F.format_string("chi2/real %.2f\nnorm rms %.2f\nmed |r|sqrt(w) %.2f", "chi2_per_real", "norm_rms", "median_norm").alias("note"))


def amplitude_notes(rows: DataFrame, what: str) -> DataFrame:
    """ant, feed, n, note: of repaired or collapsed amplitudes (ant, feed, chan, amp, scale) their channels, the least
    amplitude and the largest scale."""
    channels = F.array_join(F.array_sort(F.collect_list("chan")), ",")
    note = F.format_string(f"channels=%s min_amp=%.4f {what}<=%.4f", channels, F.min("amp"), F.max("scale"))
    return rows.groupBy("ant", "feed").agg(F.count(F.lit(1)).alias("n"), note.alias("note")).orderBy("ant", "feed")
