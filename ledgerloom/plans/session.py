"""Sessions of a tenant: every relation comes filtered, whatever the query says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROLES = {"viewer": 0, "analyst": 1, "admin": 2}
# Columns that each role sees on top of those of the role below.
COLUMNS = {
    "viewer": ["request_id", "query", "path", "is_blocked", "block_reason", "company", "fiscal_year", "quarter", "financial_type", "response_text", "confidence_tier", "has_contradictions", "citations", "contradictions", "error"],
    "analyst": ["confidence_score", "crag_triggered", "crag_count", "dsl_object", "sql_query", "sql_result", "sql_verified", "error_node"],
    "admin": ["latency_ms", "tokens_used", "cache_hit"],
}
VIEWER_CITATION = ["doc_id", "page_number", "company", "fiscal_year", "financial_type"]
VIEWER_CONTRADICTION = ["type", "severity"]


def visible_rows(rows: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of the tenant; without a tenant none, since nothing equals null."""
    return rows.where(F.col("tenant_id") == F.lit(tenant).cast("string"))


class TenantSession:
    """Relations as one tenant and role may see them.  The filter is part of the plan, so it reaches the scan."""

    def __init__(self, spark: SparkSession, tenant: str | None, role: str = "viewer"):
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        self.spark, self.tenant, self.role = spark, tenant, role

    def own(self, rows: DataFrame) -> DataFrame:
        return visible_rows(rows, self.tenant)

    def users(self, rows: DataFrame) -> DataFrame:
        """Signing in comes before a tenant is known: then all users are visible, else the tenant's."""
        return rows if self.tenant is None else self.own(rows)

    def require(self, least: str) -> None:
        if ROLES[self.role] < ROLES[least]:
            raise PermissionError(f"{least} needed, {self.role} given")

    def shape(self, responses: DataFrame) -> DataFrame:
        return for_role(responses, self.role)


def _only(fields: list[str]):
    return lambda c: F.struct(*(c[f].alias(f) for f in fields))


def for_role(responses: DataFrame, role: str) -> DataFrame:
    """The columns of a response that a role sees; viewers get citations and contradictions without figures."""
    names = [c for r, n in ROLES.items() if n <= ROLES[role] for c in COLUMNS[r]]
    rows = responses
    if role == "viewer":
        for column, fields in (("citations", VIEWER_CITATION), ("contradictions", VIEWER_CONTRADICTION)):
            if column in rows.columns:
                rows = rows.withColumn(column, F.transform(column, _only(fields)))
    return rows.select(*(c for c in names if c in rows.columns))
