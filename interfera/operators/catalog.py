"""What a set holds: sources, partitions, antennas, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sources(vis: DataFrame) -> DataFrame:
    """Distinct sources, by their first partition."""
    return vis.groupBy("source_name").agg(F.min("scan").alias("first_scan"))


def summary(vis: DataFrame) -> DataFrame:
    """A row for each partition with its shape: channels, times, baselines, polarisations, records."""
    key, few = ["source_name", "scan"], lambda c, name: F.size(F.collect_set(c)).cast("long").alias(name)
    # channels, baselines and polarisations are sets of a few values, so only times need a second aggregation
    return vis.groupBy(*key).agg(few("chan", "n_chan"), F.countDistinct("ts").alias("n_time"), few(F.struct("ant1", "ant2"), "n_baseline"), few("pol", "n_pol"), F.count(F.lit(1)).alias("n_record"))


def scan_window(vis: DataFrame) -> DataFrame:
    hours = (F.unix_micros(F.col("ts")) / 3.6e9).cast("double")
    return vis.groupBy("scan").agg(F.min(hours).alias("lo"), F.max(hours).alias("hi")).withColumn("center", (F.col("lo") + F.col("hi")) / 2)


def participating_antennas(vis: DataFrame) -> DataFrame:
    """Of each partition, the antennas of its baselines in order."""
    both = vis.select("scan", F.explode(F.array("ant1", "ant2")).alias("ant")).distinct()
    return both.groupBy("scan").agg(F.array_join(F.array_sort(F.collect_list("ant")), ",").alias("antennas"))


def unique_or_error(df: DataFrame, by: list[str], what: list[str], message: str) -> DataFrame:
    """A row for each ``by`` with its ``what``; two unlike ones are an error."""
    found = df.groupBy(*by).agg(F.countDistinct(F.struct(*what)).alias("n_"), *[F.min(c).alias(c) for c in what])
    return found.where(F.when(F.col("n_") == 1, True).otherwise(F.raise_error(F.concat(F.lit(message), F.concat_ws(",", *by))))).drop("n_")
