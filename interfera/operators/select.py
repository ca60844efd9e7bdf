"""Selections. Each keeps rows; what isn't there gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source(vis: DataFrame, name: str) -> DataFrame:
    return vis.where(F.col("source_name") == name)


def partition(vis: DataFrame, **wanted: str | int | None) -> DataFrame:
    """Rows that equal every value given by column; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            vis = vis.where(F.col(name) == F.lit(value))
    return vis


def station(vis: DataFrame, ant: int) -> DataFrame:
    return vis.where((F.col("ant1") == ant) | (F.col("ant2") == ant))


def baseline(vis: DataFrame, a: int, b: int) -> DataFrame:
    """The ordered pair."""
    return vis.where((F.col("ant1") == a) & (F.col("ant2") == b))


def time_window(vis: DataFrame, low: str, high: str) -> DataFrame:
    """Both ends included."""
    return vis.where(F.col("ts").between(F.to_timestamp(F.lit(low)), F.to_timestamp(F.lit(high))))


def merge(*sets: DataFrame, key: str = "partition_key") -> DataFrame:
    """The union of sets without a partition in common; one that is in two is an error, found as it is read."""
    keys = sets[0].select(key).distinct()
    for other in sets[1:]:  # of each set its partitions alone are compared
        keys = keys.unionAll(other.select(key).distinct())
    twice = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.min(key).alias("twice_"))
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    # one row by all: the smallest partition that is in two sets, or null
    checked = out.join(F.broadcast(twice), F.lit(True))
    return checked.where(F.when(F.col("twice_").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("partition in two sets: "), "twice_")).cast("boolean"))).drop("twice_")
