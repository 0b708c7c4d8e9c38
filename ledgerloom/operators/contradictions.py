"""Claims in text against verified figures.  Rows of a question keep its ``query_id``, where they have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import growth_pct
from ..functions.rules import crore_claims, direction, severity


def _keys(*frames: DataFrame) -> list[str]:
    return ["query_id", "chunk_id"] if all("query_id" in x.columns for x in frames) else ["chunk_id"]


def magnitude_flags(rows: DataFrame) -> DataFrame:
    """chunk_id, claim, verified, difference_pct, severity of claims beyond the tolerance.  ``rows``: chunk_id, text, verified."""
    claims = rows.where(F.col("verified").isNotNull() & (F.col("verified") != 0)).select(*_keys(rows), "verified", F.explode(crore_claims(F.col("text"))).alias("claim"))
    diff = growth_pct(F.col("claim"), F.col("verified"))
    return claims.select(*_keys(rows), "claim", "verified", F.round(diff, 2).alias("difference_pct"), severity(diff).alias("severity")).where("severity is not null")


def direction_flags(rows: DataFrame) -> DataFrame:
    """chunk_id, said, yoy_pct, severity (high) of chunks whose words go against the verified change.  ``rows``: chunk_id, text, yoy_pct."""
    said = rows.select(*_keys(rows), direction(F.col("text")).alias("said"), "yoy_pct")
    against = ((F.col("said") == "positive") & (F.col("yoy_pct") < 0)) | ((F.col("said") == "negative") & (F.col("yoy_pct") > 0))
    return said.where(against).withColumn("severity", F.lit("high"))


def all_flags(magnitude: DataFrame, directions: DataFrame) -> DataFrame:
    """Both kinds with an order: high before medium before low."""
    keys = _keys(magnitude, directions)
    one = magnitude.select(*keys, F.lit("magnitude").alias("kind"), "severity")
    two = directions.select(*keys, F.lit("direction").alias("kind"), "severity")
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return one.unionByName(two).withColumn("severity_rank", rank)
