"""A corpus pipeline from five of the operators: each stage takes what its predecessor kept.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``documents``; the last returns each remaining
document's tokens as digests.  ``run`` writes every stage's result to the shared folder and reads
it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import bagminhash, bpe, decontam, linespread, queries, toxicity
from ledgerloom.llm.common import cut, table

#: SQL can't express the learned and sampled stages; tests hold ``run`` against plain Python instead.
ORACLE_SQL = None


def _apart(docs: DataFrame, *named: str) -> tuple[DataFrame, list]:
    """``docs`` with all columns but ``named`` renamed, so that no operator's own columns meet them, and what names them back."""
    new = {c: c if c in named else f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in new.items())), [F.col(n).alias(c) for c, n in new.items()]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the lexicon calls toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = _apart(docs, "doc_id", "text")
    return toxicity.score(rows, model, keep=tuple(rows.columns)).where("predicted = 0").select(*back)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut cross-site boilerplate lines; a document of nothing else goes."""
    rows, back = _apart(docs, "text", "source", "n_chars")
    cleaned = linespread.clean(rows)
    kept = cleaned.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return kept.withColumn("n_chars", length.cast("bigint")).select(*back)


def duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return bagminhash.keep_one(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    rows, back = _apart(docs)
    whole = rows.columns[docs.columns.index("text")]
    found = decontam.decontaminate(rows.withColumn("text", F.col(whole)), table(spark, sf_dir, "benchmark"), id_cols=tuple(rows.columns))
    return found.where("not contaminated").select(*back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every remaining text."""
    return bpe.digests(docs, queries.vocabulary())


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_out),
    ("near_duplicates", duplicates_out),
    ("decontamination", leaks_out),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
