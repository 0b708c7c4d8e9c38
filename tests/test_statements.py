from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import derive, growth, kpi

SCHEMA = "company string, financial_type string, fiscal_year int, quarter string, metric string, value decimal(28,6)"


def facts(spark, **metrics):
    return spark.createDataFrame([("A", "consolidated", 2024, None, k, D(str(v))) for k, v in metrics.items()], SCHEMA)


def totals(spark, **metrics):
    r = derive.derive_totals(facts(spark, **metrics)).first()
    return {k: None if r[k] is None else float(r[k]) for k in ("total_income", "total_expenses", "profit_before_tax", "tax_expense")}


def test_totals(spark):
    assert totals(spark, revenue=100, other_income=5, other_operating_revenue=1, total_income=90, total_expenses=50, profit_before_tax=40, exceptional_items=-2, pat=30) == {"total_income": 106.0, "total_expenses": 64.0, "profit_before_tax": 40.0, "tax_expense": 10.0}
    assert totals(spark, revenue=100, total_expenses=60.5, profit_before_tax=40)["total_expenses"] == 60.5  # within one
    # expenses follow from a stated profit only, not from one that is derived afterwards
    assert totals(spark, revenue=100, profit_before_exceptional_items=40, exceptional_items=-3, pat=30) == {"total_income": 100.0, "total_expenses": None, "profit_before_tax": 37.0, "tax_expense": 7.0}
    assert totals(spark, total_income=10)["total_income"] == 10.0


def failures(spark, **metrics):
    return {r["check"]: r["diff_pct"] for r in derive.identity_failures(facts(spark, **metrics)).collect()}


def test_identities(spark):
    assert failures(spark, revenue=100, other_income=5, total_income=105, total_expenses=60, profit_before_tax=45, tax_expense=5, pat=40) == {}
    assert failures(spark, revenue=100, other_income=5, total_income=100) == {"total_income": 5.0}
    assert failures(spark, total_income=100, total_expenses=60, profit_before_tax=37, exceptional_items=3) == {}
    assert failures(spark, profit_before_tax=40, current_tax=6, deferred_tax=4, pat=30) == {}
    assert failures(spark, profit_before_tax=40, pat=0) == {"pat": None}


def test_gate(spark):
    bad = derive.identity_failures(facts(spark, revenue=100, other_income=5, total_income=90))
    with pytest.raises(ValueError):
        derive.require_gate(facts(spark, revenue=100), bad)
    fine = derive.identity_failures(facts(spark, revenue=100, other_income=5, total_income=104))
    assert derive.require_gate(facts(spark, revenue=100), fine).count() == 1


def test_pivot_and_back(spark):
    rows = facts(spark, revenue=1, pat=2)
    back = growth.lengthen(growth.widen(rows, ["revenue", "pat", "missing"]), ["revenue", "pat", "missing"])
    assert sorted((r["metric"], float(r["value"])) for r in back.collect()) == [("pat", 2.0), ("revenue", 1.0)]


def test_kpi(spark):
    rows = spark.createDataFrame([("semantic", 10, 0.9, True), (None, 0, None, False), ("unknown", 30, 0.3, False)], "query_path string, latency_ms int, confidence double, cache_hit boolean")
    assert kpi.summary(rows).first().asDict() == pytest.approx({"total_queries": 3, "cache_hit_pct": 33.3, "avg_latency_ms": 13.0, "p95_latency_ms": 28.0, "refusal_pct": 33.3})
    assert sorted(tuple(r) for r in kpi.paths(rows).collect()) == [("semantic", 1), ("unknown", 1), ("unknown", 1)]
    assert {r["tier"]: r["n"] for r in kpi.tiers(rows).collect()} == {"high": 1, "low": 2}
    assert kpi.latency_by_path(rows).count() == 2


def test_growth_of_gaps(spark):
    rows = spark.createDataFrame([("t", "A", "m", "c", y, None, D(v)) for y, v in ((2020, 1), (2022, 4))], "tenant_id string, company string, metric string, financial_type string, fiscal_year int, quarter string, value decimal(28,6)")
    assert growth.year_over_year(rows).where("prior_value is not null").count() == 0
    assert growth.compound_growth(rows).first()["cagr_pct"] == 300.0
    assert growth.compound_growth(rows, by="span").first()["cagr_pct"] == 100.0
    assert rows.groupBy("company").agg(F.count("*")).count() == 1
