"""A corpus from raw documents: good ones, one of each group of near copies, none of the benchmark, without personal
data, and fit for the tokenizer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interfera.llm import bpe, decontam, minhash, pii, quality
from interfera.llm.langid import remainder
from interfera.llm.store import checkpoint, folder, small, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over the classifier's cut; null and empty texts are judged as any others, repeated rows alike."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.learn(docs, labels))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row: of those of the smallest id (null: largest) any one.

    Rows are numbered and written first, so that they're told apart whatever their ids.
    """
    row = "row_" + uuid.uuid4().hex
    path = f"{folder(spark)}/unique-{uuid.uuid4().hex}"
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path)
    found = minhash.near_duplicates(held, row).select(row, "component_id").join(held.select(row, "doc_id"), row)
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")).select(f"first.{row}")
    gone = checkpoint(found.select(row).join(kept, row, "left_anti"))
    return held.join(small(gone, gone.count()), row, "left_anti").select(*docs.columns)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; null and empty texts stay, repeated rows stay or go alike."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced; null texts stay null, and their n_chars as it was."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and the digest of what they decode to; a null text has no ids."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True).drop("offsets")


STAGES = [("quality", good), ("near-dedup", unique), ("decontamination", unseen), ("pii", private), ("bpe", tokens)]

#: Stages learn from data, which SQL can't express; tests/test_pipeline.py holds them and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
