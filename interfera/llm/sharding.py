"""Sharding by proportional stratified interleaving, in DataFrame operations alone.

Rows of each source are shuffled by a seeded digest and ranked; all rows are then ordered by their fractional rank
within the source and cut into equal runs, so each shard holds every source in the proportion of the whole.

No rank needs the rows of a source together. A source is divided into ``bins`` by the leading digits of the digest;
rows are ranked within a bin and the sizes of the bins before it are added. The order by fractional rank is divided
into ``cuts`` equal stretches; how many rows lie before a stretch follows from the sizes of the sources alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from interfera.llm.store import table

SEED = "interleave-1"
#: Bins of a source, by three hexadecimal digits of the digest.
BINS = 4096
#: Rows alike in source, key, checksum and size that stay in one bin. There are at most 1 / MANY as many groups of more
#: rows as rows, so these groups (50 bytes each) are broadcast.
MANY = 100_000
#: Stretches of the order by fractional rank.
CUTS = 4096


def _stratum(source: str) -> Column:
    s = F.col(source).cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), s))


def interleave(docs: DataFrame, shards: int, seed: str = SEED, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, size, text_crc32, stratum, rank (from 1, within its source), shard and slot for each row.

    Shard sizes in rows differ by one at most. Null sources form a source of their own; a null text has no bytes
    (size 8, checksum 0); null keys are shuffled as one value. Rows with the same key are ordered by checksum and
    size; rows that are alike in all of them stand next to each other and get different slots. An empty table gives
    none. Other columns are ignored, whatever their names.
    """
    t = F.col(text).cast("string")
    facts = [(F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("crc")]
    keyed = docs.select(F.col(key).alias("k"), _stratum(source).alias("s"), *facts)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("crc"), F.col("size")).cast("binary"))
    keyed = keyed.withColumn("d", digest)
    # rows that are alike in all, which may be many, are dealt over bins by their place in the table
    times = keyed.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("s", "d", F.lit(True).alias("many"))
    keyed = keyed.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(times), ["s", "d"], "left")
    keyed = keyed.withColumn("d", F.when(F.col("many"), F.md5(F.concat_ws(":", "d", "at").cast("binary"))).otherwise(F.col("d"))).withColumn("b", F.substring("d", 1, 3))
    size = keyed.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("s").orderBy("b")
    offset = size.withColumn("o", F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1))).withColumn("ns", F.sum("n").over(W.partitionBy("s")))
    offset = offset.select("s", "b", F.coalesce("o", F.lit(0)).alias("o"), "ns")
    rows = keyed.select("k", "s", "b", "d", "size", "crc")
    order = W.partitionBy("s", "b").orderBy("d", "k", "crc", "size")
    ranked = rows.withColumn("r", F.row_number().over(order)).join(offset, ["s", "b"]).withColumn("r", (F.col("r") + F.col("o")).cast("long"))
    ranked = ranked.withColumn("c", F.expr(f"((2 * r - 1) * {CUTS}) div (2 * ns)"))

    # A source of n rows has as many in stretch c as there are ranks r with (2r - 1) * CUTS div 2n = c. Small sources
    # name the stretches of their ranks, large ones count all stretches: no more rows than the table has.
    per_source = size.groupBy("s").agg(F.sum("n").alias("ns"))
    upto = "(({c} * 2 * ns + {g} - 1) div {g}) div 2"
    large = per_source.filter(F.col("ns") >= CUTS).select("ns", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))).alias("c"))
    large = large.select("c", (F.expr(upto.format(c="(c + 1)", g=CUTS)) - F.expr(upto.format(c="c", g=CUTS))).alias("n"))
    little = per_source.filter(F.col("ns") < CUTS).select("ns", F.explode(F.expr("sequence(1L, ns)")).alias("r"))
    little = little.select(F.expr(f"((2 * r - 1) * {CUTS}) div (2 * ns)").alias("c"), F.lit(1).cast("long").alias("n"))
    stretch = large.select(F.col("c").cast("long"), "n").unionByName(little).groupBy("c").agg(F.sum("n").alias("n"))
    # CUTS rows at most, whatever the input
    all_before = W.orderBy("c")
    stretch = stretch.withColumn("o", F.coalesce(F.sum("n").over(all_before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(all_before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    stretch = stretch.select("c", F.col("o").alias("before"), "total")

    inside = W.partitionBy("c").orderBy(F.expr("(r - 0.5D) / ns"), "s", "r")
    placed = ranked.withColumn("p", F.row_number().over(inside)).join(stretch, "c").withColumn("p", F.expr("p - 1 + before"))
    placed = placed.withColumn("shard", F.expr(f"p * {shards} div total"))
    return placed.select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("s").alias("stratum"), F.col("r").alias("rank"),
        F.col("shard").cast("int"), (F.col("p") - F.expr(f"(shard * total + {shards} - 1) div {shards}")).cast("long").alias("slot"),
    )


def op5_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, by the law of rows."""
    out = interleave(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.substring("stratum", 2, 1 << 30).alias("source"), "rank")
