"""Connected components of a graph given by its links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfera.llm.store import checkpoint, tidy


def forest(u: list, v: list) -> dict:
    """Of each node of the links, the smallest node that it's linked with, directly or not."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for a, b in zip(u, v):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def _thin(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes, at most one for a node in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            held = forest([*held, *batch.column(0).to_pylist()], [*held.values(), *batch.column(1).to_pylist()])
        pairs = [(x, y) for x, y in held.items() if x != y]
        for i in range(0, len(pairs), 1 << 16):
            a = np.array(pairs[i : i + (1 << 16)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])

    return links.mapInArrow(tidy(run), "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """``links``: columns u and v (bigint, not null). Returns node and component, the smallest node reachable.

    Links with both ends alike are left out. Each step keeps the components and is written to the checkpoint folder;
    they end when nothing changes. A node of very many links is never in one task as a group: minima are aggregated
    and joined back, and Spark may divide such joins.
    """
    now = checkpoint(_thin(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")).distinct())
    while True:
        before = _state(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = checkpoint(small)
        if _state(now) == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
