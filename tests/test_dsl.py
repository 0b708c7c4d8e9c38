import pytest

from ledgerloom.plans import answer, dsl

GOOD = {"metric": "Turnover", "entity": "a", "fiscal_year": "FY26", "financial_type": "Consolidated", "operation": "point_in_time"}


@pytest.mark.parametrize(
    "change,error",
    [
        ({"metric": ""}, "missing fields: metric"),
        ({"financial_type": "both"}, "financial_type 'both' is unknown"),
        ({"metric": "weather"}, "metric 'weather' is unknown"),
        ({"metric": "ebitda"}, "metric 'ebitda' is not in the corpus yet"),
        ({"operation": "sum"}, "operation 'sum' is unknown"),
        ({"fiscal_year": "soon"}, "fiscal_year 'soon' is no year"),
        ({"comparison_period": "FY25"}, "point_in_time spans two periods"),
        ({"operation": "comparison"}, "comparison needs comparison_entity"),
        ({"operation": "growth_comparison", "comparison_entity": "A "}, "growth_comparison needs two different entities"),
    ],
)
def test_rules(change, error):
    verdict = dsl.validate(GOOD | change)
    assert not verdict.valid and verdict.error == error
    assert (verdict.hint is None) == ("corpus" in error)


def test_resolution_and_preference():
    q = dsl.validate(GOOD | {"quarter": " q3 ", "comparison_period": "fy26"}).query
    assert (q.metric, q.entity, q.fiscal_year, q.quarter, q.financial_type) == ("revenue", "A", 2026, "Q3", "consolidated")
    assert dsl.validate(GOOD, preferred_operation="cagr").query.operation == "cagr"


FACTS = "tenant_id string, company string, metric string, financial_type string, fiscal_year int, quarter string, value decimal(28,6)"


@pytest.fixture(scope="module")
def facts(spark):
    from decimal import Decimal as D

    rows = [("t", c, "revenue", "consolidated", fy, None, D(v)) for c, fy, v in (("A", 2024, 100), ("A", 2025, 0), ("A", 2026, 150), ("B", 2025, 50), ("B", 2026, 75), ("N", 2025, -10), ("N", 2026, -5))]
    return spark.createDataFrame(rows + [("t", "A", "revenue", "consolidated", 2026, "Q1", D(40))], FACTS)


def run(facts, **change):
    return dsl.run(dsl.validate(GOOD | change).query, facts)


def test_operations(facts):
    assert run(facts)[0][0]["value"] == 150.0
    assert run(facts, quarter="Q1")[0][0]["value"] == 40.0
    assert run(facts, fiscal_year="FY20") == ([], "no_data_found")
    rows, error = run(facts, operation="yoy_growth")
    assert error is None and rows[0]["prior_value"] == 0 and rows[0]["yoy_pct"] is None  # zero base
    assert run(facts, operation="yoy_growth", fiscal_year="FY24")[1] == "no_data_found"
    assert run(facts, operation="comparison", comparison_entity="B")[0][0]["difference_pct"] == 100.0
    assert run(facts, operation="growth_comparison", comparison_entity="B")[1] == "prior value is zero"
    assert run(facts, operation="cagr")[0][0]["cagr_pct"] == 22.47
    assert run(facts, operation="cagr", entity="N")[1] == "start value is not positive"


def test_two_rows_are_ambiguous(facts):
    assert run(facts.union(facts))[1] == "ambiguous_result"


def test_tie_names_the_second(spark):
    from decimal import Decimal as D

    rows = [("t", c, "revenue", "consolidated", fy, None, D(v)) for c, fy, v in (("A", 2025, 10), ("A", 2026, 20), ("B", 2025, 5), ("B", 2026, 10))]
    got, error = run(spark.createDataFrame(rows, FACTS), operation="growth_comparison", comparison_entity="B")
    assert error is None and got[0]["faster_growing_entity"] == "B"


def test_answers(facts):
    def told(**change):
        q = dsl.validate(GOOD | change).query
        return answer.ANSWERS[q.operation](dsl.plan(q, facts)).first()["answer"]

    assert told() == "A's consolidated Revenue for FY26 was ₹150.0 Cr."
    assert told(operation="yoy_growth", entity="B") == "B's consolidated Revenue grew 50.00% year-over-year, from ₹50.0 Cr in FY25 to ₹75.0 Cr in FY26."
    assert told(operation="comparison", comparison_entity="B") == "A's Revenue was ₹150.0 Cr, compared to B's ₹75.0 Cr — A reported 100.0% higher revenue."
    assert told(operation="cagr").startswith("A's Revenue grew at a CAGR of 22.47% from FY24 to FY26")
    assert "prior value is zero" in told(operation="growth_comparison", comparison_entity="B")


def test_questions_become_queries():
    raw = dsl.parse_question("How did Zomato's net profit grow in FY26 versus Paytm?")
    assert raw == {"metric": "net profit", "entity": "ETERNAL", "comparison_entity": "PAYTM", "fiscal_year": "fy26", "quarter": None, "financial_type": "consolidated", "operation": "growth_comparison"}
