"""Statement arithmetic: totals that follow from others, and identities that must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import number
from .growth import owners, widen

PERIOD = ["company", "financial_type", "fiscal_year", "quarter"]
USED = ["revenue", "other_income", "other_operating_revenue", "total_income", "total_expenses", "profit_before_exceptional_items", "exceptional_items", "profit_before_tax", "tax_expense", "current_tax", "deferred_tax", "pat"]
#: Per cent of difference that is reported, and that stops a load; the least difference of expenses that is overwritten.
TOLERANCE, GATE, LEAST = 0.5, 5.0, 1.0


def _or_zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast("decimal(28,6)"))


def derive_totals(facts: DataFrame) -> DataFrame:
    """Facts with total income, total expenses, profit before tax and tax made consistent.

    Total income follows from its parts whenever revenue is there; expenses from the *stated* profit
    before tax, overwriting a stated value that is off by more than ``LEAST``; then a missing profit
    before tax and a missing tax are filled.
    """
    amount = lambda x: F.round(x, 2).cast("decimal(28,6)")
    income = F.when(F.col("revenue").isNotNull(), amount(F.col("revenue") + _or_zero("other_income") + _or_zero("other_operating_revenue"))).otherwise(F.col("total_income"))
    rows = widen(facts, USED).withColumn("total_income", income)
    expenses = amount(F.col("total_income") - F.col("profit_before_tax") + _or_zero("exceptional_items"))
    off = F.col("total_expenses").isNull() | (F.abs(expenses - F.col("total_expenses")) > LEAST)
    rows = rows.withColumn("total_expenses", F.when(F.col("profit_before_tax").isNotNull() & F.col("total_income").isNotNull() & off, expenses).otherwise(F.col("total_expenses")))
    rows = rows.withColumn("profit_before_tax", F.coalesce("profit_before_tax", amount(F.col("profit_before_exceptional_items") + _or_zero("exceptional_items"))))
    return rows.withColumn("tax_expense", F.coalesce("tax_expense", amount(F.col("profit_before_tax") - F.col("pat"))))


def identity_failures(facts: DataFrame) -> DataFrame:
    """One row for each identity that a period breaks: check, expected, actual, diff_pct."""
    rows, period = widen(facts, USED), [*owners(facts), *PERIOD]
    parts = F.col("revenue") + F.col("other_income") + _or_zero("other_operating_revenue")
    net, extra, before = F.col("total_income") - F.col("total_expenses"), _or_zero("exceptional_items"), F.col("profit_before_tax")
    rescued = F.when((F.abs(net - before) > LEAST) & (extra != 0) & (F.abs(net + extra - before) <= LEAST), net + extra).when((F.abs(net - before) > LEAST) & (extra != 0) & (F.abs(net - extra - before) <= LEAST), net - extra).otherwise(net)
    split = F.col("current_tax").isNotNull() | F.col("deferred_tax").isNotNull()
    tax = F.when((_or_zero("tax_expense") == 0) & split, _or_zero("current_tax") + _or_zero("deferred_tax")).otherwise(_or_zero("tax_expense"))
    checks = [("total_income", parts, F.col("total_income")), ("profit_before_tax", rescued, before), ("pat", before - tax, F.col("pat"))]
    told = F.array(*(F.struct(F.lit(name).alias("check"), number(expected).alias("expected"), number(actual).alias("actual")) for name, expected, actual in checks))
    rows = rows.select(*period, F.explode(told).alias("c")).select(*period, "c.*").where("expected is not null and actual is not null")
    diff = F.try_divide(F.abs(F.col("expected") - F.col("actual")), F.abs("actual")) * 100
    broken = F.when(F.col("actual") == 0, F.abs("expected") > LEAST).otherwise(diff > TOLERANCE)
    return rows.where(broken).select(*period, "check", F.round("expected", 2).alias("expected"), F.round("actual", 2).alias("actual"), F.round(diff, 2).alias("diff_pct"))


def gate_failures(failures: DataFrame) -> DataFrame:
    """Failures beyond the hard gate, which stop a load."""
    return failures.where(F.col("diff_pct") > GATE)


def require_gate(facts: DataFrame, failures: DataFrame) -> DataFrame:
    """``facts``, or an error when any failure is beyond the hard gate."""
    if not gate_failures(failures).isEmpty():
        raise ValueError("identity gate: a stated total differs by more than 5 %")
    return facts


def first_of_each(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first record of each key in the given order: order is explicit, so reruns agree."""
    w = Window.partitionBy(*key).orderBy(*order)
    return records.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
