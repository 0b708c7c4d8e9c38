"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept for evaluation: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Up to ``most`` distinct labelled texts outside the held-out rows: text, label.

    The sample is bounded (``most`` ids, by a hash of the id), so it may be broadcast; documents are
    only filtered by it, not shuffled.  Copies of a text count once, and a text labelled both ways
    not at all.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("top")).where("label = top")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").select("text", F.col("label").cast("int").alias("label"))
