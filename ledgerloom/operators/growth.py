"""Growth and comparison over long facts: one scan each, whatever the number of periods or entities.

Facts have company, metric, financial_type, fiscal_year (number), quarter (null: annual) and value.
Where they name their owners (``OWNERS``), those are part of every key and of every result, so
that facts of two tenants, or of two documents, never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import compound_pct, growth_pct, number

OWNERS = ["tenant_id", "doc"]
SERIES = ["company", "metric", "financial_type", "quarter"]


def owners(facts: DataFrame) -> list[str]:
    return [c for c in OWNERS if c in facts.columns]


def select_facts(facts: DataFrame, company: str | list[str] | None = None, metric: str | None = None, fiscal_year: int | list[int] | None = None, financial_type: str | None = None, quarter: str | None = "any") -> DataFrame:
    """Conjunction of predicates that reach the scan; ``quarter=None`` asks for annual facts."""

    def among(column: str, wanted) -> Column:
        return F.col(column).isin(wanted) if isinstance(wanted, list) else F.col(column) == wanted

    for column, wanted in (("company", company), ("metric", metric), ("fiscal_year", fiscal_year), ("financial_type", financial_type)):
        if wanted is not None:
            facts = facts.where(among(column, wanted))
    return facts if quarter == "any" else facts.where(F.col("quarter").eqNullSafe(F.lit(quarter)))


def point_in_time(facts: DataFrame, **keys) -> DataFrame:
    """The facts that the keys name; callers treat more than one row as ambiguous."""
    return select_facts(facts, **keys).select(*owners(facts), "company", "metric", "financial_type", "fiscal_year", "quarter", number(F.col("value")).alias("value"))


def year_over_year(facts: DataFrame) -> DataFrame:
    """Every fact with its predecessor of the year before in the same series; null where that year is missing."""
    w = Window.partitionBy(*owners(facts), *SERIES).orderBy("fiscal_year")
    before = F.when(F.col("fiscal_year") - F.lag("fiscal_year").over(w) == 1, F.lag("value").over(w))
    rows = facts.withColumn("prior", before)
    return rows.select(*owners(facts), "company", "metric", "financial_type", "quarter", "fiscal_year", number(F.col("value")).alias("current_value"), number(F.col("prior")).alias("prior_value"), F.round(growth_pct(F.col("value"), F.col("prior")), 2).alias("yoy_pct"))


def prior_period(facts: DataFrame) -> DataFrame:
    """The same pairing as a null-safe self-join, for facts whose series are spread over partitions already."""
    own = owners(facts)
    before = facts.select(*own, "company", "metric", "financial_type", F.col("quarter").alias("q"), (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("value").alias("prior"))
    rows = facts.join(before.withColumnRenamed("q", "quarter_"), [*own, "company", "metric", "financial_type", "fiscal_year"]).where(F.col("quarter").eqNullSafe(F.col("quarter_")))
    return rows.select(*own, "company", "metric", "financial_type", "quarter", "fiscal_year", number(F.col("value")).alias("current_value"), number(F.col("prior")).alias("prior_value"))


def _pick(condition: Column) -> Column:
    return F.max(F.when(condition, number(F.col("value"))))


def compare(facts: DataFrame, first: str, second: str) -> DataFrame:
    """Two companies in every common period, by one conditional aggregation."""
    rows = facts.where(F.col("company").isin(first, second)).groupBy(*owners(facts), "metric", "financial_type", "fiscal_year", "quarter").agg(_pick(F.col("company") == first).alias("value1"), _pick(F.col("company") == second).alias("value2"))
    both = rows.where(F.col("value1").isNotNull() & F.col("value2").isNotNull())
    return both.select(*owners(facts), F.lit(first).alias("entity1"), F.lit(second).alias("entity2"), "metric", "financial_type", "fiscal_year", "quarter", "value1", "value2", F.round(F.col("value1") - F.col("value2"), 2).alias("difference"), F.round(growth_pct(F.col("value1"), F.col("value2")), 2).alias("difference_pct"))


def compare_growth(facts: DataFrame, first: str, second: str) -> DataFrame:
    """Growth of two companies over the same years; a tie names the second as the faster, a zero base gives an error."""
    yoy = year_over_year(facts.where(F.col("company").isin(first, second)))
    pick = lambda column, who: F.max(F.when(F.col("company") == who, F.col(column)))
    rows = yoy.where(F.col("prior_value").isNotNull()).groupBy(*owners(facts), "metric", "financial_type", "fiscal_year", "quarter").agg(*(pick(c, who).alias(f"{side}_{c}") for side, who in (("a", first), ("b", second)) for c in ("current_value", "prior_value", "yoy_pct")), F.count_distinct("company").alias("n"))
    zero = (F.col("a_prior_value") == 0) | (F.col("b_prior_value") == 0)
    faster = F.when(~zero, F.when(F.col("a_yoy_pct") > F.col("b_yoy_pct"), first).otherwise(second))
    return rows.where("n = 2").select(*owners(facts), F.lit(first).alias("entity_a"), F.lit(second).alias("entity_b"), "metric", "financial_type", "fiscal_year", "quarter", "a_current_value", "a_prior_value", F.col("a_yoy_pct").alias("yoy_a_pct"), "b_current_value", "b_prior_value", F.col("b_yoy_pct").alias("yoy_b_pct"), faster.alias("faster_growing_entity"), F.when(zero, "prior value is zero").alias("error"))


def compound_growth(facts: DataFrame, by: str = "rows") -> DataFrame:
    """First to last year of every series; ``by`` counts the steps in rows or in years (``span``)."""
    rows = facts.groupBy(*owners(facts), *SERIES).agg(F.min("fiscal_year").alias("start_fy"), F.max("fiscal_year").alias("end_fy"), F.min_by("value", "fiscal_year").alias("first"), F.max_by("value", "fiscal_year").alias("last"), F.count("*").alias("n"))
    steps = F.col("n") - 1 if by == "rows" else F.col("end_fy") - F.col("start_fy")
    error = F.when(F.col("n") < 2, "insufficient_data_for_cagr").when(number(F.col("first")) <= 0, "start value is not positive").when(number(F.col("last")) <= 0, "end value is not positive")
    return rows.select(*owners(facts), *SERIES, "start_fy", "end_fy", number(F.col("first")).alias("start_value"), number(F.col("last")).alias("end_value"), F.round(compound_pct(F.col("first"), F.col("last"), steps), 2).alias("cagr_pct"), error.alias("error"))


def widen(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a period with a column for each of the named metrics: naming them spares the scan that finds them."""
    return facts.groupBy(*owners(facts), "company", "financial_type", "fiscal_year", "quarter").pivot("metric", metrics).agg(F.max("value"))


def lengthen(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Back to long facts; absent metrics give no row."""
    return wide.unpivot([*owners(wide), "company", "financial_type", "fiscal_year", "quarter"], metrics, "metric", "value").where("value is not null")


def roll_up(lines: DataFrame) -> DataFrame:
    """Annual and quarterly sums of signed line values in one pass: the annual row has no quarter."""
    rows = lines.groupingSets([["company", "fiscal_year"], ["company", "fiscal_year", "quarter"]], "company", "fiscal_year", "quarter").agg(F.sum("value").alias("value"), F.grouping("quarter").alias("annual"))
    return rows.select("company", "fiscal_year", F.when(F.col("annual") == 0, F.col("quarter")).alias("quarter"), "value")
