"""The query language: a small typed object, validated, then planned as one lazy DataFrame.

A query names a metric, an entity, a fiscal year, a financial type and one of five operations.  The
validator applies its rules in a fixed order and says how to repair what it rejects; the planner
turns a valid query into a single scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import growth
from .registry import COMPANIES, METRICS, alias_rows

OPERATIONS = {
    "point_in_time": "one value of one entity and period",
    "yoy_growth": "change on the year before",
    "comparison": "two entities in one period",
    "cagr": "compound growth over all years",
    "growth_comparison": "growth of two entities on the year before",
}
PAIRED = ("comparison", "growth_comparison")


@dataclass(frozen=True)
class Query:
    metric: str
    entity: str
    fiscal_year: int
    financial_type: str
    operation: str
    quarter: str | None = None
    comparison_entity: str | None = None
    comparison_period: str | None = None


@dataclass(frozen=True)
class Verdict:
    """A query, or what is wrong with it; without a hint a retry is of no use."""

    query: Query | None = None
    error: str | None = None
    hint: str | None = None

    @property
    def valid(self) -> bool:
        return self.query is not None


def year_of(text: str | int) -> int | None:
    """Four-digit year of FY26, FY2026 or 2026."""
    m = re.fullmatch(r"(?:FY\s*)?(\d{4}|\d{2})", str(text).upper().strip())
    if not m:
        return None
    n = int(m[1])
    return n if n > 99 else n + (1900 if n >= 70 else 2000)


def quarter_of(text: str | None) -> str | None:
    name = (text or "").strip().upper()
    if name in ("", "NONE", "NULL"):
        return None
    m = re.search(r"Q[1-4]", name)
    return m[0] if m else None


def validate(raw: dict, preferred_operation: str | None = None) -> Verdict:
    """Check a raw query.  A preferred operation replaces a different one."""
    missing = [f for f in ("metric", "entity", "fiscal_year", "financial_type", "operation") if not raw.get(f)]
    if missing:
        return Verdict(error=f"missing fields: {', '.join(missing)}", hint=f"give {', '.join(missing)}")
    kind = str(raw["financial_type"]).lower().strip()
    if kind not in ("consolidated", "standalone"):
        return Verdict(error=f"financial_type {kind!r} is unknown", hint="use 'consolidated' or 'standalone'")
    asked = str(raw["metric"]).lower().strip()
    known = {m.name: m for m in METRICS if m.queryable}
    name = {a: n for a, n, _ in alias_rows(queryable_only=True)}.get(asked, asked)
    if name not in known:
        return Verdict(error=f"metric {asked!r} is unknown", hint=f"use one of {', '.join(known)}")
    if known[name].derived:
        return Verdict(error=f"metric {name!r} is not in the corpus yet")
    operation = str(raw["operation"]).lower().strip()
    if preferred_operation in OPERATIONS:
        operation = preferred_operation
    if operation not in OPERATIONS:
        return Verdict(error=f"operation {operation!r} is unknown", hint=f"use one of {', '.join(OPERATIONS)}")
    year = year_of(raw["fiscal_year"])
    if year is None:
        return Verdict(error=f"fiscal_year {raw['fiscal_year']!r} is no year", hint="use FY and two digits")
    period = raw.get("comparison_period")
    if operation == "point_in_time" and period and year_of(period) != year:
        return Verdict(error="point_in_time spans two periods", hint="use yoy_growth for two years of one entity")
    entity, other = str(raw["entity"]).upper().strip(), str(raw.get("comparison_entity") or "").upper().strip()
    if operation in PAIRED and not other:
        return Verdict(error=f"{operation} needs comparison_entity", hint="give the second company")
    if operation in PAIRED and other == entity:
        return Verdict(error=f"{operation} needs two different entities", hint="give two different companies")
    return Verdict(Query(name, entity, year, kind, operation, quarter_of(raw.get("quarter")), other or None, period))


def plan(query: Query, facts: DataFrame) -> DataFrame:
    """The query as a DataFrame of at most one row in sound data, from one scan of the facts."""
    pair = [query.entity, query.comparison_entity] if query.operation in PAIRED else query.entity
    years = None if query.operation == "cagr" else [query.fiscal_year - 1, query.fiscal_year] if query.operation in ("yoy_growth", "growth_comparison") else query.fiscal_year
    rows = growth.select_facts(facts, company=pair, metric=query.metric, fiscal_year=years, financial_type=query.financial_type, quarter=query.quarter)
    if query.operation == "point_in_time":
        return growth.point_in_time(rows)
    if query.operation == "comparison":
        return growth.compare(rows, query.entity, query.comparison_entity)
    if query.operation == "cagr":
        return growth.compound_growth(rows)
    if query.operation == "yoy_growth":
        return growth.year_over_year(rows).where(F.col("fiscal_year") == query.fiscal_year)
    return growth.compare_growth(rows, query.entity, query.comparison_entity).where(F.col("fiscal_year") == query.fiscal_year)


def run(query: Query, facts: DataFrame) -> tuple[list[dict], str | None]:
    """Rows of a query and its error code, if any.  Two rows are read at most: more than one is ambiguous."""
    rows = [r.asDict() for r in plan(query, facts).limit(2).collect()]
    if not rows:
        return [], "no_data_found"
    if len(rows) > 1:
        return rows, "ambiguous_result"
    if query.operation == "yoy_growth" and rows[0]["prior_value"] is None:
        return rows, "no_data_found"
    return rows, rows[0].get("error")


def parse_question(text: str) -> dict:
    """A raw query from plain words by the registries: no model, only names, years and a few signal words."""
    low = f" {text.lower()} "
    found = [c.ticker for c in COMPANIES if any(re.search(rf"(?<!\w){re.escape(a)}(?!\w)", low) for a in c.aliases)]
    metric = max((a for a, _, _ in alias_rows(queryable_only=True) if re.search(rf"(?<!\w){re.escape(a)}(?!\w)", low)), key=len, default=None)
    year, quarter = re.search(r"\bfy\s*\d{2,4}\b", low), re.search(r"\bq[1-4]\b", low)
    grows = bool(re.search(r"grow|grew|yoy|year.over.year", low))
    operation = ("growth_comparison" if grows else "comparison") if len(found) > 1 else "cagr" if "cagr" in low or "compound" in low else "yoy_growth" if grows else "point_in_time"
    return {"metric": metric, "entity": found[0] if found else None, "comparison_entity": found[1] if len(found) > 1 else None, "fiscal_year": year[0].replace(" ", "") if year else None, "quarter": quarter[0] if quarter else None, "financial_type": "standalone" if "standalone" in low else "consolidated", "operation": operation}
