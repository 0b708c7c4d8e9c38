"""Figures over the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import share_pct


def _places(x: Column, n: int) -> Column:
    return F.round(x, n)


def summary(audit: DataFrame) -> DataFrame:
    """Queries, cache hits in per cent, mean and 95th percentile of latency, refusals in per cent (no confidence is no refusal)."""
    return audit.agg(
        F.count("*").alias("total_queries"),
        _places(share_pct(F.count_if(F.col("cache_hit")), F.count("*")), 1).alias("cache_hit_pct"),
        _places(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
        F.expr("percentile_cont(0.95) within group (order by latency_ms)").alias("p95_latency_ms"),
        _places(share_pct(F.count_if(F.col("confidence") < 0.5), F.count("*")), 1).alias("refusal_pct"),
    )


def paths(audit: DataFrame) -> DataFrame:
    """Queries by path.  A missing path and one that is called unknown stay two rows."""
    return audit.groupBy("query_path").count().select(F.coalesce("query_path", F.lit("unknown")).alias("path"), F.col("count").alias("n"))


def by_day(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.to_date("created_at").alias("d")).count().select(F.col("d").cast("string").alias("day"), F.col("count").alias("n"))


def tier(confidence: Column) -> Column:
    """High from 0.8, medium from 0.5, else low; so is a missing one."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def tiers(audit: DataFrame) -> DataFrame:
    return audit.groupBy(tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


def latency_by_path(audit: DataFrame) -> DataFrame:
    rows = audit.where("latency_ms > 0").groupBy("query_path").agg(F.avg("latency_ms").alias("x"))
    return rows.select(F.coalesce("query_path", F.lit("unknown")).alias("path"), _places(F.col("x"), 0).alias("avg_latency_ms"))


def ordered_lists(audit: DataFrame) -> dict[str, DataFrame]:
    """The lists as a page shows them: the largest first, days in order; ties by name."""
    return {
        "paths": paths(audit).orderBy(F.desc("n"), "path"),
        "days": by_day(audit).orderBy("day"),
        "tiers": tiers(audit).orderBy(F.desc("n"), "tier"),
        "latency": latency_by_path(audit).orderBy(F.desc("avg_latency_ms"), "path"),
    }
