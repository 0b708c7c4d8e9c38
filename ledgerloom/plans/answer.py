"""Answers in words from verified rows, as column expressions over a result of ``dsl.plan``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import label


def money(value: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(value, 1), F.lit(" Cr"))


def _named(metric: Column) -> Column:
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))


def _period() -> Column:
    return F.concat_ws(" ", F.col("quarter"), label(F.col("fiscal_year")))


def point_in_time(rows: DataFrame) -> DataFrame:
    told = F.concat(F.col("company"), F.lit("'s "), F.col("financial_type"), F.lit(" "), _named(F.col("metric")), F.lit(" for "), _period(), F.lit(" was "), money(F.col("value")), F.lit("."))
    return rows.withColumn("answer", told)


def year_over_year(rows: DataFrame) -> DataFrame:
    """No growth at all reads as a decline, as does an undetermined one."""
    grew = F.when(F.col("yoy_pct") > 0, "grew").otherwise("declined")
    size = F.coalesce(F.concat(F.format_number(F.abs("yoy_pct"), 2), F.lit("%")), F.lit("an undetermined amount"))
    told = F.concat(F.col("company"), F.lit("'s "), F.col("financial_type"), F.lit(" "), _named(F.col("metric")), F.lit(" "), grew, F.lit(" "), size, F.lit(" year-over-year, from "), money(F.col("prior_value")), F.lit(" in "), label(F.col("fiscal_year") - 1), F.lit(" to "), money(F.col("current_value")), F.lit(" in "), label(F.col("fiscal_year")), F.lit("."))
    return rows.withColumn("answer", F.coalesce(told, F.lit("Could not compute year-over-year growth.")))


def comparison(rows: DataFrame) -> DataFrame:
    """Equal values name the second entity; a zero lower value gives no percentage."""
    low, high = F.least("value1", "value2"), F.greatest("value1", "value2")
    more = F.coalesce(F.concat(F.format_number(F.abs(F.try_divide(high - low, F.when(high != 0, low))) * 100, 1), F.lit("% higher")), F.lit("different"))
    higher = F.when(F.col("value1") > F.col("value2"), F.col("entity1")).otherwise(F.col("entity2"))
    told = F.concat(F.col("entity1"), F.lit("'s "), _named(F.col("metric")), F.lit(" was "), money(F.col("value1")), F.lit(", compared to "), F.col("entity2"), F.lit("'s "), money(F.col("value2")), F.lit(" — "), higher, F.lit(" reported "), more, F.lit(" "), F.lower(_named(F.col("metric"))), F.lit("."))
    return rows.withColumn("answer", told)


def growth_comparison(rows: DataFrame) -> DataFrame:
    def side(name: str, entity: str) -> Column:
        pct = F.concat(F.when(F.col(f"yoy_{name}_pct") >= 0, "+").otherwise("-"), F.format_number(F.abs(f"yoy_{name}_pct"), 2), F.lit("%"))
        return F.concat(F.col(entity), F.lit("'s "), _named(F.col("metric")), F.lit(" grew "), pct, F.lit(" ("), money(F.col(f"{name}_prior_value")), F.lit(" → "), money(F.col(f"{name}_current_value")), F.lit(") year-over-year"))

    told = F.concat(F.lit("In "), label(F.col("fiscal_year")), F.lit(", "), side("a", "entity_a"), F.lit(", while "), side("b", "entity_b"), F.lit(". "), F.col("faster_growing_entity"), F.lit(" grew faster."))
    return rows.withColumn("answer", F.coalesce(F.concat(F.lit("Could not compare growth rates: "), F.col("error")), told))


def compound(rows: DataFrame) -> DataFrame:
    told = F.concat(F.col("company"), F.lit("'s "), _named(F.col("metric")), F.lit(" grew at a CAGR of "), F.format_number("cagr_pct", 2), F.lit("% from "), label(F.col("start_fy")), F.lit(" to "), label(F.col("end_fy")), F.lit(" ("), money(F.col("start_value")), F.lit(" → "), money(F.col("end_value")), F.lit(")."))
    return rows.withColumn("answer", F.coalesce(F.concat(F.lit("Could not compute CAGR: "), F.col("error")), told))


ANSWERS = {"point_in_time": point_in_time, "yoy_growth": year_over_year, "comparison": comparison, "growth_comparison": growth_comparison, "cagr": compound}


def excerpts(hits: DataFrame, n: int = 200) -> DataFrame:
    """One numbered block of citations a query, best first, each with the start of its text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, n))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("query_id", F.array_join(F.col("x.line"), "\n").alias("citations"))


def prompt_block(hits: DataFrame) -> DataFrame:
    """query_id, block: the retrieved texts of a query, numbered, each with its page, type and year."""
    head = F.concat(F.lit("[Excerpt "), F.col("rank").cast("string"), F.lit(" — page "), F.col("page_number").cast("string"), F.lit(", "), F.col("financial_type"), F.lit(" "), F.col("fiscal_year").cast("string"), F.lit("]\n"), F.col("text"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("part")))).alias("x"))
    return rows.select("query_id", F.array_join(F.col("x.part"), "\n\n").alias("block"))


def sources_block(hits: DataFrame) -> DataFrame:
    """query_id, block, n_sources: the sources of an answer as its readers see them, and how many distinct chunks they are."""
    line = F.concat(F.lit("  ["), F.col("rank").cast("string"), F.lit("] "), F.col("company"), F.lit(" "), F.col("fiscal_year").cast("string"), F.lit(" ("), F.col("financial_type"), F.lit(") — page "), F.col("page_number").cast("string"), F.lit(", filed "), F.col("filing_date").cast("string"), F.lit(" (relevance score: "), F.format_number("score", 2), F.lit(")"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"), F.count_distinct("chunk_id").alias("n_sources"))
    return rows.select("query_id", F.concat(F.lit("\n\nSources:\n"), F.array_join(F.col("x.line"), "\n")).alias("block"), "n_sources")


def contradictions_block(flags: DataFrame) -> DataFrame:
    """query_id, block: what the sources and the verified figures disagree on, worst first.  ``flags``: query_id, kind, metric, value, delta_pct, severity, severity_rank."""
    size = lambda x, places: F.concat(F.when(x >= 0, "+").otherwise("-"), F.format_number(F.abs(x), places), F.lit("%"))
    told = F.when(F.col("kind") == "magnitude", F.concat(F.lit("  • Qualitative source claims a figure differing by "), size(F.col("delta_pct"), 1), F.lit(" from the verified "), F.col("metric"), F.lit(" value of "), money(F.col("value")), F.lit(". (severity: "), F.col("severity"), F.lit(")")))
    told = told.otherwise(F.concat(F.lit("  • Qualitative text uses language inconsistent with the "), F.when(F.col("value") > 0, "positive").otherwise("negative"), F.lit(" "), F.col("metric"), F.lit(" trend ("), size(F.col("value"), 2), F.lit("). (severity: "), F.col("severity"), F.lit(")")))
    rows = flags.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("severity_rank", told.alias("line")))).alias("x"))
    return rows.select("query_id", F.concat(F.lit("\n\n⚠ Sources disagree on this topic:\n"), F.array_join(F.col("x.line"), "\n"), F.lit("\n  Review the cited sources directly before drawing conclusions.")).alias("block"))
