"""All queries of the engine proper, by name, with their SQL twins.

Each query plans an operator over the relations of ``sources.views``; its twin says the same in SQL
from the same view definitions, for another engine to check.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import labels as L
from .functions import numbers, periods
from .functions import rules as R
from .operators import chunks as C
from .operators import contradictions as X
from .operators import derive as D
from .operators import growth as G
from .operators import kpi as K
from .operators import latest as V
from .operators import layout as Y
from .operators import pages as P
from .operators import postings, quantiles, quantized
from .operators import retrieval as T
from .plans import answer, dsl, evaluation, registry, replies, router, session
from .sources import ingest, snapshots, store
from .sources.views import relation, table, with_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str = ""):
    """Register a function under its name, with its SQL twin if there is one."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _sql_list(rows: list[tuple]) -> str:
    told = lambda x: "null" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(told, r)) + ")" for r in rows)


def _fresh(spark, name: str) -> str:
    return f"{snapshots.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- facts -----------------------------------------------------------------------------------------
FACTS = with_sql("v_facts")
ONE = "quarter is null and financial_type = 'consolidated' and metric = 'revenue'"


@query(FACTS + f"select tenant_id, company, metric, financial_type, fiscal_year, quarter, cast(value as double) as value from v_facts where company = 'BUILDING' and fiscal_year = 1997 and {ONE}")
def point_in_time(spark, d):
    q = dsl.validate({"metric": "Turnover", "entity": "building", "fiscal_year": "FY97", "financial_type": "Consolidated", "operation": "point_in_time"}).query
    return dsl.plan(q, relation(spark, d, "v_facts"))


YOY = "select c.tenant_id, c.company, c.metric, c.financial_type, c.quarter, c.fiscal_year, cast(c.value as double) as current_value, cast(p.value as double) as prior_value, round((cast(c.value as double) - cast(p.value as double)) / nullif(abs(cast(p.value as double)), 0) * 100, 2) as yoy_pct from v_facts c left join v_facts p on p.tenant_id = c.tenant_id and p.company = c.company and p.metric = c.metric and p.financial_type = c.financial_type and p.quarter is not distinct from c.quarter and p.fiscal_year = c.fiscal_year - 1"


@query(FACTS + YOY + " where c.company = 'MACHINERY' and c.metric = 'pat' and c.financial_type = 'standalone' and c.quarter = 'Q2' and c.fiscal_year = 1999")
def yoy_growth(spark, d):
    q = dsl.validate({"metric": "net profit", "entity": "MACHINERY", "fiscal_year": "FY99", "quarter": "q2", "financial_type": "standalone", "operation": "yoy_growth"}).query
    return dsl.plan(q, relation(spark, d, "v_facts"))


@query(FACTS + YOY)
def yoy_all_periods(spark, d):
    return G.year_over_year(relation(spark, d, "v_facts"))


@query(FACTS + "select c.tenant_id, c.company, c.metric, c.financial_type, c.quarter, c.fiscal_year, cast(c.value as double) as current_value, cast(p.value as double) as prior_value from v_facts c join v_facts p on p.tenant_id = c.tenant_id and p.company = c.company and p.metric = c.metric and p.financial_type = c.financial_type and p.quarter is not distinct from c.quarter and p.fiscal_year = c.fiscal_year - 1")
def prior_period_join(spark, d):
    return G.prior_period(relation(spark, d, "v_facts"))


PAIR = "select a.tenant_id, 'BUILDING' as entity1, 'FURNITURE' as entity2, a.metric, a.financial_type, a.fiscal_year, a.quarter, cast(a.value as double) as value1, cast(b.value as double) as value2, round(cast(a.value as double) - cast(b.value as double), 2) as difference, round((cast(a.value as double) - cast(b.value as double)) / nullif(abs(cast(b.value as double)), 0) * 100, 2) as difference_pct from v_facts a join v_facts b on a.tenant_id = b.tenant_id and a.metric = b.metric and a.financial_type = b.financial_type and a.fiscal_year = b.fiscal_year and a.quarter is not distinct from b.quarter where a.company = 'BUILDING' and b.company = 'FURNITURE'"


@query(FACTS + PAIR)
def comparison(spark, d):
    return G.compare(relation(spark, d, "v_facts"), "BUILDING", "FURNITURE")


@query(
    FACTS
    + f", yoy as ({YOY} where p.value is not null and c.company in ('BUILDING', 'FURNITURE')) select a.tenant_id, 'BUILDING' as entity_a, 'FURNITURE' as entity_b, a.metric, a.financial_type, a.fiscal_year, a.quarter, a.current_value as a_current_value, a.prior_value as a_prior_value, a.yoy_pct as yoy_a_pct, b.current_value as b_current_value, b.prior_value as b_prior_value, b.yoy_pct as yoy_b_pct, case when a.prior_value = 0 or b.prior_value = 0 then null when a.yoy_pct > b.yoy_pct then 'BUILDING' else 'FURNITURE' end as faster_growing_entity, case when a.prior_value = 0 or b.prior_value = 0 then 'prior value is zero' end as error from yoy a join yoy b on a.tenant_id = b.tenant_id and a.metric = b.metric and a.financial_type = b.financial_type and a.fiscal_year = b.fiscal_year and a.quarter is not distinct from b.quarter where a.company = 'BUILDING' and b.company = 'FURNITURE'"
)
def growth_comparison(spark, d):
    return G.compare_growth(relation(spark, d, "v_facts"), "BUILDING", "FURNITURE")


def _cagr(steps: str) -> str:
    return FACTS + f", s as (select tenant_id, company, metric, financial_type, quarter, min(fiscal_year) as start_fy, max(fiscal_year) as end_fy, cast(arg_min(value, fiscal_year) as double) as first, cast(arg_max(value, fiscal_year) as double) as last, count(*) as n from v_facts group by all) select tenant_id, company, metric, financial_type, quarter, start_fy, end_fy, first as start_value, last as end_value, case when first > 0 and last > 0 and ({steps}) > 0 then round((power(last / first, 1.0 / ({steps})) - 1) * 100, 2) end as cagr_pct, case when n < 2 then 'insufficient_data_for_cagr' when first <= 0 then 'start value is not positive' when last <= 0 then 'end value is not positive' end as error from s"


@query(_cagr("n - 1"))
def cagr(spark, d):
    return G.compound_growth(relation(spark, d, "v_facts"))


@query(_cagr("end_fy - start_fy"))
def cagr_by_span(spark, d):
    return G.compound_growth(relation(spark, d, "v_facts"), by="span")


@query(FACTS + "select tenant_id, company, metric, financial_type, fiscal_year, cast(value as double) as value from v_facts where quarter is not distinct from null and fiscal_year >= 1998")
def quarter_null_safe(spark, d):
    rows = G.select_facts(relation(spark, d, "v_facts"), quarter=None).where("fiscal_year >= 1998")
    return rows.select("tenant_id", "company", "metric", "financial_type", "fiscal_year", numbers.number(F.col("value")).alias("value"))


@query("select o_orderkey, cast(year(o_orderdate) + case when month(o_orderdate) >= 4 then 1 else 0 end as int) as fiscal_year, 'Q' || cast(cast(floor(((month(o_orderdate) + 8) % 12) / 3) as int) + 1 as varchar) as quarter, 'FY' || lpad(cast((year(o_orderdate) + case when month(o_orderdate) >= 4 then 1 else 0 end) % 100 as varchar), 2, '0') as label from orders")
def fiscal_period(spark, d):
    rows = table(spark, d, "orders").withColumn("fy", periods.fiscal_year(F.col("o_orderdate")))
    return rows.select("o_orderkey", F.col("fy").alias("fiscal_year"), periods.quarter(F.col("o_orderdate")).alias("quarter"), periods.label(F.col("fy")).alias("label"))


@query(FACTS + "select tenant_id, company, financial_type, fiscal_year, quarter, cast(max(value) filter (metric = 'revenue') as double) as revenue, cast(max(value) filter (metric = 'total_income') as double) as total_income, cast(max(value) filter (metric = 'pat') as double) as pat from v_facts group by 1, 2, 3, 4, 5")
def long_to_wide_pivot(spark, d):
    names = ["revenue", "total_income", "pat"]
    rows = G.widen(relation(spark, d, "v_facts"), names)
    return rows.select("tenant_id", "company", "financial_type", "fiscal_year", "quarter", *(numbers.number(F.col(n)).alias(n) for n in names))


@query(FACTS + "select tenant_id, company, financial_type, fiscal_year, quarter, metric, cast(value as double) as value from v_facts where metric in ('revenue', 'pat')")
def wide_to_long_unpivot(spark, d):
    rows = G.lengthen(G.widen(relation(spark, d, "v_facts"), ["revenue", "pat"]), ["revenue", "pat"])
    return rows.withColumn("value", numbers.number(F.col("value")))


@query(with_sql("v_lines") + "select company, fiscal_year, case when grouping(quarter) = 0 then quarter end as quarter, cast(sum(ext * (1 - disc)) as double) as value from v_lines group by grouping sets ((company, fiscal_year), (company, fiscal_year, quarter))")
def annual_quarter_rollup(spark, d):
    rows = relation(spark, d, "v_lines").select("company", "fiscal_year", "quarter", (F.col("ext") * (1 - F.col("disc"))).alias("value"))
    return G.roll_up(rows).withColumn("value", numbers.number(F.col("value")))


# -- restatements ----------------------------------------------------------------------------------
FILINGS = with_sql("v_filings") + ", f as (select *, make_date(filed_year, 3 + filed_order, 1) as filing_date, version as seq from v_filings) "
FILING_KEY = "tenant_id, company, metric, fiscal_year, financial_type, quarter"


def _filings(spark, d):
    rows = relation(spark, d, "v_filings")
    return rows.withColumn("filing_date", F.make_date("filed_year", F.col("filed_order") + 3, F.lit(1))).withColumn("seq", F.col("version"))


@query(FILINGS + f"select company, fiscal_year, doc_id, filing_date, cast(value as double) as value from f qualify row_number() over (partition by {FILING_KEY} order by filing_date desc, seq desc, doc_id desc) = 1")
def latest_resolution(spark, d):
    return V.latest(_filings(spark, d)).select("company", "fiscal_year", "doc_id", "filing_date", numbers.number(F.col("value")).alias("value"))


@query(
    FILINGS
    + f", h as (select *, max(filing_date) over w as seen, max(strftime(filing_date, '%Y-%m-%d') || lpad(cast(seq as varchar), 9, '0') || doc_id) over w as held from f window w as (partition by {FILING_KEY} order by seq, doc_id rows between unbounded preceding and 1 preceding)) select company, fiscal_year, doc_id, case when seen is null then 'inserted' when substr(held, 20) = doc_id or filing_date < seen then 'skipped' when filing_date > seen then 'restated' else 'reingested' end as outcome from h"
)
def restatement_outcomes(spark, d):
    return V.outcomes(_filings(spark, d)).select("company", "fiscal_year", "doc_id", "outcome")


AT_VERSION = "select company, fiscal_year, doc_id, cast(value as double) as value, {part} from f where {when} qualify row_number() over (partition by {key} order by filing_date desc, seq desc, doc_id desc) = 1"


def _committed(spark, d) -> tuple[str, int]:
    """The filings as a table in versions, one commit for each number that filings have; its path and the version of the second commit.

    The filings are written down once, so that the commits do not each join the lines anew.
    """
    path = _fresh(spark, "facts")
    _filings(spark, d).drop("version", "filed_year", "filed_order").write.parquet(f"{path}-filings")
    rows = spark.read.parquet(f"{path}-filings")
    for number in (1, 2, 3, 4):
        store.commit_facts(rows.where(F.col("seq") == number), path, ("filings", number))
    return path, 1


@query(FILINGS + AT_VERSION.format(part="cast(filing_date as date) as valid_from", when="seq <= 2", key=FILING_KEY))
def facts_at_version(spark, d):
    path, version = _committed(spark, d)
    rows = store.facts_at(spark, path, "t1", version).where("is_latest")
    return rows.select("company", "fiscal_year", "doc_id", numbers.number(F.col("value")).alias("value"), "valid_from")


@query(FILINGS + AT_VERSION.format(part="filing_date as valid_from", when="filing_date <= date '1996-04-15'", key=FILING_KEY))
def facts_as_of_date(spark, d):
    path, _ = _committed(spark, d)
    rows = V.as_of(store.facts_at(spark, path), "1996-04-15")
    return rows.select("company", "fiscal_year", "doc_id", numbers.number(F.col("value")).alias("value"), "valid_from")


@query(FILINGS + "select n.company, n.fiscal_year, n.doc_id from f n where n.version <= 2 and not exists (select 1 from f o where o.version = 1 and o.doc_id = n.doc_id and o.metric = n.metric and o.fiscal_year = n.fiscal_year and o.financial_type = n.financial_type and o.quarter is not distinct from n.quarter)")
def idempotent_insert(spark, d):
    rows = _filings(spark, d)
    return V.insert_new(rows.where("version = 1"), rows.where("version <= 2")).select("company", "fiscal_year", "doc_id")


@query(
    FILINGS
    + f", r as (select *, row_number() over (partition by {FILING_KEY} order by filing_date, seq, doc_id) as up, row_number() over (partition by {FILING_KEY} order by filing_date desc, seq desc, doc_id desc) as down, count(*) over (partition by {FILING_KEY}) as n from f) select a.company, a.fiscal_year, cast(a.value as double) as first_value, cast(b.value as double) as latest_value, a.n as n_versions, round((cast(b.value as double) - cast(a.value as double)) / nullif(abs(cast(a.value as double)), 0) * 100, 2) as change_pct from r a join r b on a.company = b.company and a.fiscal_year = b.fiscal_year where a.up = 1 and b.down = 1 and a.value <> b.value"
)
def restated_delta(spark, d):
    return V.restatements(_filings(spark, d))


# -- statements ------------------------------------------------------------------------------------
BROKEN = with_sql("v_broken")
WIDE = "w as (select tenant_id, company, financial_type, fiscal_year, quarter, " + ", ".join(f"max(value) filter (metric = '{m}') as {m}" for m in ("revenue", "other_income", "total_income", "total_expenses", "profit_before_tax", "tax_expense", "pat")) + " from v_broken group by 1, 2, 3, 4, 5)"


@query(
    BROKEN
    + f", {WIDE}, a as (select *, case when revenue is not null then round(revenue + coalesce(other_income, 0), 2) else total_income end as ti from w), b as (select *, case when profit_before_tax is not null and ti is not null and (total_expenses is null or abs(round(ti - profit_before_tax, 2) - total_expenses) > 1) then round(ti - profit_before_tax, 2) else total_expenses end as te from a) select tenant_id, company, financial_type, fiscal_year, quarter, cast(ti as double) as total_income, cast(te as double) as total_expenses, cast(profit_before_tax as double) as profit_before_tax, cast(coalesce(tax_expense, round(profit_before_tax - pat, 2)) as double) as tax_expense from b"
)
def derived_totals(spark, d):
    rows = D.derive_totals(relation(spark, d, "v_broken"))
    return rows.select("tenant_id", *D.PERIOD, *(numbers.number(F.col(n)).alias(n) for n in ("total_income", "total_expenses", "profit_before_tax", "tax_expense")))


FAILURES = (
    BROKEN
    + f", {WIDE}, c as (select tenant_id, company, financial_type, fiscal_year, quarter, 'total_income' as \"check\", cast(revenue + other_income as double) as expected, cast(total_income as double) as actual from w union all select tenant_id, company, financial_type, fiscal_year, quarter, 'profit_before_tax', cast(total_income - total_expenses as double), cast(profit_before_tax as double) from w union all select tenant_id, company, financial_type, fiscal_year, quarter, 'pat', cast(profit_before_tax - coalesce(tax_expense, 0) as double), cast(pat as double) from w), x as (select *, abs(expected - actual) / nullif(abs(actual), 0) * 100 as diff from c where expected is not null and actual is not null), bad as (select tenant_id, company, financial_type, fiscal_year, quarter, \"check\", round(expected, 2) as expected, round(actual, 2) as actual, round(diff, 2) as diff_pct from x where case when actual = 0 then abs(expected) > 1 else diff > 0.5 end) "
)


@query(FAILURES + "select * from bad")
def identity_failures(spark, d):
    return D.identity_failures(relation(spark, d, "v_broken"))


@query(FAILURES + "select \"check\", count(*) as n from bad where diff_pct > 5 group by 1")
def hard_gate_count(spark, d):
    return D.gate_failures(D.identity_failures(relation(spark, d, "v_broken"))).groupBy("check").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_quantity) = 1")
def first_wins_dedupe(spark, d):
    return D.first_of_each(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


# -- audit -----------------------------------------------------------------------------------------
AUDIT = with_sql("v_audit") + ", a as (select *, cast(raw_confidence as double) as confidence from v_audit) "


def _audit(spark, d):
    return relation(spark, d, "v_audit").withColumn("confidence", F.col("raw_confidence").cast("double"))


@query(AUDIT + "select count(*) as total_queries, round(count(*) filter (cache_hit) * 100.0::double / count(*), 1) as cache_hit_pct, round(avg(latency_ms), 0) as avg_latency_ms, quantile_cont(latency_ms, 0.95) as p95_latency_ms, round(count(*) filter (confidence < 0.5) * 100.0::double / count(*), 1) as refusal_pct from a")
def kpi_summary(spark, d):
    return K.summary(_audit(spark, d))


@query(AUDIT + "select coalesce(query_path, 'unknown') as path, n from (select query_path, count(*) as n from a group by 1)")
def path_distribution(spark, d):
    return K.paths(_audit(spark, d))


@query(AUDIT + "select strftime(created_at, '%Y-%m-%d') as day, count(*) as n from a group by 1")
def volume_by_day(spark, d):
    return K.by_day(_audit(spark, d))


@query(AUDIT + "select case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as tier, count(*) as n from a group by 1")
def confidence_tiers(spark, d):
    return K.tiers(_audit(spark, d))


@query(AUDIT + "select coalesce(query_path, 'unknown') as path, round(x, 0) as avg_latency_ms from (select query_path, avg(latency_ms) as x from a where latency_ms > 0 group by 1)")
def latency_by_path(spark, d):
    return K.latency_by_path(_audit(spark, d))


@query(AUDIT + "select audit_id, tenant_id from a where tenant_id = 't1'")
def tenant_isolation(spark, d):
    return session.TenantSession(spark, "t1").own(_audit(spark, d)).select("audit_id", "tenant_id")


@query(AUDIT + "select audit_id, tenant_id from a where tenant_id = null")
def tenant_unset(spark, d):
    return session.TenantSession(spark, None).own(_audit(spark, d)).select("audit_id", "tenant_id")


@query(AUDIT + "select cast(audit_id as varchar) as request_id, query_path as path, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as confidence_tier, confidence as confidence_score from a")
def role_projection(spark, d):
    rows = _audit(spark, d).select(F.col("audit_id").cast("string").alias("request_id"), F.col("query_path").alias("path"), K.tier(F.col("confidence")).alias("confidence_tier"), F.col("confidence").alias("confidence_score"), "latency_ms", "cache_hit")
    return session.TenantSession(spark, "t1", "analyst").shape(rows)


# -- retrieval -------------------------------------------------------------------------------------
def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


DOT = "select q.vec_id as query_id, v.vec_id as chunk_id, list_inner_product(v.embedding::double[], q.embedding::double[]) as score, v.label from embeddings v, embeddings q where q.vec_id % 20 = 0"


def _ranked(source: str, k: int) -> str:
    return f"select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ({source}) x) y where rank <= {k}"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_ranked(DOT, 20))
def dense_topk(spark, d):
    return _rounded(T.dense(_asked(spark, d), _vectors(spark, d), dim=64))


@query(_ranked(DOT + " and v.label in (1, 2)", 20))
def dense_topk_filtered(spark, d):
    return _rounded(T.dense(_asked(spark, d), _vectors(spark, d).where("label in (1, 2)")))


@query(_ranked(DOT, 20))
def quantized_topk(spark, d):
    """The same questions asked of stored codes."""
    path = _fresh(spark, "codes")
    quantized.encode(_vectors(spark, d)).write.parquet(path)
    return _rounded(quantized.search(_asked(spark, d), spark.read.parquet(path)))


@query(_ranked(DOT + " and v.label in (1, 2)", 20))
def quantized_topk_filtered(spark, d):
    path = _fresh(spark, "codes")
    quantized.encode(_vectors(spark, d)).write.parquet(path)
    return _rounded(quantized.search(_asked(spark, d), spark.read.parquet(path).where("label in (1, 2)")))


USERS = "select conv_id * 1000 + turn as query_id, string_agg(text, ' ' order by text) as question from conversations where role = 'user' and conv_id % 20 = 0 group by 1"
WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
BM25 = f"asked as (select query_id, unnest(list_distinct(list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda t: t <> ''))) as term from ({USERS}) q), c as (select doc_id as chunk_id, {WORDS} as tokens from documents), s as (select count(*) as chunks, avg(len(tokens)) as mean from c), e as (select chunk_id, len(tokens) as n, unnest(tokens) as term from c), f as (select chunk_id, n, term, count(*) as tf from e where term in (select term from asked) group by 1, 2, 3), g as (select term, count(*) as df from f group by 1), bm as (select query_id, chunk_id, round(sum(ln(1 + (chunks - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / mean)))), 6) as score from f join g using (term) join asked using (term), s group by 1, 2)"


def _questions(spark, d):
    """What users said in every conversation with an id divisible by 20."""
    said = table(spark, d, "conversations").where("role = 'user' and conv_id % 20 = 0")
    return said.groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id")).agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("question"))


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"with {BM25} " + _ranked("select * from bm", 20))
def bm25_topk(spark, d):
    return _rounded(T.bm25(_questions(spark, d), _chunks(spark, d)))


@query(f"with {BM25} " + _ranked("select * from bm", 20))
def indexed_topk(spark, d):
    """The same questions asked of an index that took its chunks in two steps."""
    index = postings.Index(spark, _fresh(spark, "index"))
    for part in (0, 1):
        index.add(_chunks(spark, d).where(F.pmod("chunk_id", F.lit(2)) == part))
    return _rounded(index.search(_questions(spark, d)))


LEGS = f"dense as ({_ranked(DOT, 20)}), other as ({_ranked(DOT + ' and v.label in (1, 2)', 20)})"
FUSED = f"{LEGS}, fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from dense union all select * from other) u group by 1, 2)"


@query(f"with {FUSED} select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused) x where rank <= 20")
def rrf_fusion(spark, d):
    rows = T.fuse([T.dense(_asked(spark, d), _vectors(spark, d)), T.dense(_asked(spark, d), _vectors(spark, d).where("label in (1, 2)"))])
    return rows.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"with {BM25}, hits as ({_ranked('select * from bm', 20)}), r as (select h.query_id, h.chunk_id, h.rank as fused_rank, round(len(list_intersect(list_distinct({WORDS.replace('text', 'q.question')}), list_distinct({WORDS.replace('text', 'd.text')})))::double / len(list_distinct({WORDS.replace('text', 'q.question')})), 6) as score from hits h join documents d on d.doc_id = h.chunk_id join ({USERS}) q on q.query_id = h.query_id) select query_id, chunk_id, fused_rank, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from r) x where rank <= 5"
)
def rerank_topk(spark, d):
    rows = T.rerank(T.bm25(_questions(spark, d), _chunks(spark, d)), _questions(spark, d), _chunks(spark, d))
    return rows.select("query_id", "chunk_id", F.col("fused_rank").cast("bigint").alias("fused_rank"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"with dense as ({_ranked(DOT, 5)}), s as (select query_id, max(score) * 8 - 12 as top, min(score) * 8 - 12 as bottom from dense group by 1) select query_id, round(least(1.0::double, greatest(0.0::double, least(1.0::double, (top + 12) / 10)) + least(0.05::double, 0.005::double * abs(top - bottom))), 4) as score, case when top >= -4.5 then 'high' when top >= -7.5 then 'medium' else 'low' end as tier from s")
def retrieval_confidence(spark, d):
    hits = _rounded(T.dense(_asked(spark, d), _vectors(spark, d), k=5)).groupBy("query_id").agg((F.max("score") * 8 - 12).alias("top"), (F.min("score") * 8 - 12).alias("bottom"))
    score, tier = R.confidence(F.col("top"), F.col("bottom"))
    return hits.select("query_id", F.round(score, 4).alias("score"), tier.alias("tier"))


LEVELS = ["v.label = 3 and v.vec_id % 4 = 1", "v.label = 3", "v.label in (3, 4, 5)"]
TIERS = ", ".join(f"l{i} as (select query_id, {i} as level, max(score) as best, case when max(score) >= 0.9 then 'high' when max(score) >= 0.25 then 'medium' else 'low' end as tier from ({DOT} and {w}) x group by 1)" for i, w in enumerate(LEVELS))


@query(f"with {TIERS}, a as (select * from l0 union all select * from l1 union all select * from l2), w as (select *, max(tier) filter (level = 0) over (partition by query_id) as t0, max(tier) filter (level = 1) over (partition by query_id) as t1 from a) select query_id, level, round(best, 6) as best, tier, tier = 'low' as refused from w where level = case when t0 = 'high' then 0 when t0 = 'medium' then 1 when t1 = 'low' then 2 else 1 end")
def crag_levels(spark, d):
    def level(where: str) -> DataFrame:
        hits = T.dense(_asked(spark, d), _vectors(spark, d).withColumn("vec_id", F.col("chunk_id")).where(where.replace("v.", "")), k=1)
        return hits.select("query_id", F.col("score").alias("best"), F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.25, "medium").otherwise("low").alias("tier"))

    return T.broadened([level(w) for w in LEVELS]).select("query_id", "level", F.round("best", 6).alias("best"), "tier", "refused")


@query(_SQL["crag_levels"])
def crag_rounds(spark, d):
    """The same levels, each asked only for the questions that need it."""

    def level(where: str):
        vectors = _vectors(spark, d).withColumn("vec_id", F.col("chunk_id")).where(where.replace("v.", ""))
        tier = F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.25, "medium").otherwise("low")
        return lambda asked: T.dense(asked, vectors, k=1).select("query_id", F.col("score").alias("best"), tier.alias("tier"))

    def keep(rows: DataFrame) -> DataFrame:
        path = _fresh(spark, "level")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    return T.broaden(_asked(spark, d), [level(w) for w in LEVELS], keep)[0].select("query_id", "level", F.round("best", 6).alias("best"), "tier", "refused")


@query(with_sql("v_chunks") + "select chunk_id from v_chunks where is_latest and tenant_id = 't1' and financial_type in ('consolidated', 'unknown') and fiscal_year = 2021")
def metadata_filter(spark, d):
    return T.visible(relation(spark, d, "v_chunks"), "t1", "consolidated", fiscal_year=2021).select("chunk_id")


@query("select vec_id as chunk_id, len(embedding) as dim from embeddings where len(embedding) = 64")
def dimension_check(spark, d):
    return store.embeddings_of_size(_vectors(spark, d), 64).select("chunk_id", F.size("embedding").cast("bigint").alias("dim"))


# -- replies and percentiles -----------------------------------------------------------------------
REPLY = {f: f"nullif(nullif(nullif(lower(trim(coalesce(j ->> '$.{f}', j ->> '$.query.{f}'))), ''), 'null'), 'none')" for f in replies.FIELDS}


@query(
    with_sql("v_replies") + r", p as (select reply_id, reply, coalesce(try_cast(trim(reply) as json), try_cast(nullif(regexp_extract(reply, '```[A-Za-z]*\s*(.*?)\s*```', 1, 's'), '') as json), try_cast(nullif(regexp_extract(reply, '\{.*\}', 0, 's'), '') as json)) as j from v_replies)"
    + ", f as (select *, " + ", ".join(f"{REPLY[f]} as {f}" for f in replies.FIELDS) + " from p)"
    + r", y as (select *, try_cast(nullif(regexp_extract(upper(fiscal_year), '^(?:FY\s*)?(\d{4}|\d{2})$', 1), '') as int) as n, concat_ws(',', " + ", ".join(f"case when {f} is null then '{f}' end" for f in replies.REQUIRED) + ") as missing from f)"
    + f" select reply_id, case when not regexp_matches(coalesce(reply, ''), '\\S') then 'empty' when j is null then 'unparsed' when json_type(j) <> 'OBJECT' then 'no_object' when missing <> '' then 'incomplete' when operation not in {tuple(dsl.OPERATIONS)} or financial_type not in {replies.KINDS} or n is null then 'unknown' else 'sound' end as state, missing, metric, upper(entity) as entity, cast(case when n > 99 then n when n >= 70 then n + 1900 else n + 2000 end as int) as fiscal_year, financial_type, operation, upper(quarter) as quarter, upper(comparison_entity) as comparison_entity, comparison_period from y"
)
def reply_records(spark, d):
    return replies.records(relation(spark, d, "v_replies"))


SHARES = [0.5, 0.95, 0.99]


@query(AUDIT + " " + " union all ".join(f"select tenant_id, query_path, {s}::double as share, round(quantile_cont(latency_ms, {s}), 6) as latency_ms from a where latency_ms is not null group by 1, 2" for s in SHARES))
def latency_percentiles(spark, d):
    """From sketches by tenant, path and day, merged by tenant and path, then made exact."""
    rows = relation(spark, d, "v_audit").withColumn("day", F.to_date("created_at"))
    stored = quantiles.sketches(rows, ["tenant_id", "query_path", "day"], "latency_ms")
    return quantiles.exact(rows, ["tenant_id", "query_path"], "latency_ms", SHARES, stored).select("tenant_id", "query_path", "share", F.round("value", 6).alias("latency_ms"))


# -- text ------------------------------------------------------------------------------------------
def _first(pairs: list[tuple[str, str]], column: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '(?i){p.replace(chr(39), chr(39) * 2)}') then '{c}'" for c, p in pairs) + " end"


@query(with_sql("v_questions") + ", q as (select question_id, trim(coalesce(question, '')) as t from v_questions union all select conv_id * 1000 + turn + 100000, trim(text) from conversations where role = 'user') select question_id, case when t = '' then 'empty_query' else " + _first(R.BLOCKED, "t") + " end as category from q")
def shield_classify(spark, d):
    asked = relation(spark, d, "v_questions").select(F.col("question_id").cast("bigint").alias("question_id"), "question")
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 100000).alias("question_id"), F.col("text").alias("question"))
    return asked.unionByName(turns).select("question_id", R.blocked_category(F.col("question")).alias("category"))


FILED = with_sql("v_pages") + ", f as (select page_id, 'Regulation 33 of the ' || case when page_id % 3 = 0 then 'SEBI rules. Statement of Profit and Loss. Auditor''s Report' when page_id % 3 = 1 then 'club. Balance sheet of the season' else 'town' end || html as text from pages) "


@query(FILED + "select page_id, score, n_categories, score >= 6 and n_categories >= 2 as accepted from (select page_id, cast(" + " + ".join(f"case when regexp_matches(substr(text, 1, 6000), '(?i){p.replace(chr(39), chr(39) * 2)}') then {w} else 0 end" for _, p, w in R.GATE_SIGNALS) + " as int) as score, cast(" + " + ".join("case when " + " or ".join(f"regexp_matches(substr(text, 1, 6000), '(?i){p.replace(chr(39), chr(39) * 2)}')" for c2, p, _ in R.GATE_SIGNALS if c2 == c) + " then 1 else 0 end" for c in dict.fromkeys(c for c, _, _ in R.GATE_SIGNALS)) + " as int) as n_categories from f) x")
def gate_score(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "SEBI rules. Statement of Profit and Loss. Auditor's Report").when(F.col("page_id") % 3 == 1, "club. Balance sheet of the season").otherwise("town")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("Regulation 33 of the "), kind, F.col("html")).alias("text"))
    return rows.select("page_id", *(c.alias(n) for n, c in R.gate(F.col("text")).items()))


def _count(phrases: list[str], text: str) -> str:
    return "cast(" + " + ".join(f"case when contains({text}, '{p.replace(chr(39), chr(39) * 2)}') then 1 else 0 end" for p in phrases) + " as int)"


@query(with_sql("v_pages") + f"select doc, page, {_count(P.RISK, 'lower(content)')} as risk, {_count(P.DISCUSSION, 'lower(content)')} as discussion, {_count(P.FINANCIAL, 'lower(content)')} as financial from v_pages")
def keyword_counts(spark, d):
    low = F.lower("content")
    return relation(spark, d, "v_pages").select("doc", "page", P.count_phrases(low, P.RISK).alias("risk"), P.count_phrases(low, P.DISCUSSION).alias("discussion"), P.count_phrases(low, P.FINANCIAL).alias("financial"))


COMMENTARY = with_sql("v_commentary")
CLAIMS = ", claims as (select chunk_id, verified, try_cast(replace(unnest(regexp_extract_all(text, '(?i)" + R.CRORE_CLAIM.replace("'", "''") + "', 1)), ',', '') as double) as claim from v_commentary) "


@query(COMMENTARY + CLAIMS + "select chunk_id, claim from claims where claim is not null")
def claims_extract(spark, d):
    return relation(spark, d, "v_commentary").select("chunk_id", F.explode(R.crore_claims(F.col("text"))).alias("claim"))


FLAGS = COMMENTARY + CLAIMS + ", m as (select chunk_id, claim, verified, (claim - verified) / abs(verified) * 100 as diff from claims where claim is not null and verified <> 0), mag as (select chunk_id, claim, verified, round(diff, 2) as difference_pct, case when abs(diff) >= 20 then 'high' when abs(diff) >= 10 then 'medium' else 'low' end as severity from m where abs(diff) > 5) "


@query(FLAGS + "select * from mag")
def magnitude_flags(spark, d):
    return X.magnitude_flags(relation(spark, d, "v_commentary"))


def _said(text: str) -> str:
    up, down = (f"len(regexp_extract_all({text}, '(?i){p}'))" for p in (R.RISE, R.FALL))
    return f"case when {up} > {down} then 'positive' when {down} > {up} then 'negative' end"


DIRECTIONS = f", v as (select company, fiscal_year, round((verified - lag(verified) over w) / abs(lag(verified) over w) * 100, 2) as yoy_pct, chunk_id, {_said('text')} as said from v_commentary window w as (partition by company order by fiscal_year)), dir as (select chunk_id, said, yoy_pct, 'high' as severity from v where (said = 'positive' and yoy_pct < 0) or (said = 'negative' and yoy_pct > 0)) "


def _with_change(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("company").orderBy("fiscal_year")
    return relation(spark, d, "v_commentary").withColumn("yoy_pct", F.round(numbers.growth_pct(F.col("verified"), F.lag("verified").over(w)), 2))


@query(COMMENTARY + DIRECTIONS + "select * from dir")
def direction_flags(spark, d):
    return X.direction_flags(_with_change(spark, d))


@query(FLAGS + DIRECTIONS + "select chunk_id, 'magnitude' as kind, severity, case severity when 'high' then 0 when 'medium' then 1 else 2 end as severity_rank from mag union all select chunk_id, 'direction', severity, 0 from dir")
def contradiction_union(spark, d):
    return X.all_flags(X.magnitude_flags(relation(spark, d, "v_commentary")), X.direction_flags(_with_change(spark, d)))


@query(FLAGS + DIRECTIONS + ", n as (select chunk_id, count(*) filter (severity = 'high') as n_high from (select chunk_id, severity from mag union all select chunk_id, severity from dir) u group by 1) select c.chunk_id, coalesce(n_high, 0) as n_high, round(case when coalesce(n_high, 0) > 0 then least(0.9::double, 0.75) else 0.9 end, 4)::double as score, case when coalesce(n_high, 0) > 0 then 'medium' else 'high' end as tier from v_commentary c left join n on n.chunk_id = c.chunk_id")
def confidence_cap(spark, d):
    flags = X.all_flags(X.magnitude_flags(relation(spark, d, "v_commentary")), X.direction_flags(_with_change(spark, d)))
    n = flags.groupBy("chunk_id").agg(F.count_if(F.col("severity") == "high").alias("n_high"))
    rows = relation(spark, d, "v_commentary").select("chunk_id").join(n, "chunk_id", "left").withColumn("n_high", F.coalesce("n_high", F.lit(0)))
    score, tier = R.capped(F.lit(0.9), F.lit("high"), F.col("n_high"), F.lit(False))
    return rows.select("chunk_id", "n_high", F.round(score, 4).alias("score"), tier.alias("tier"))


REFUSED = "select doc_id, case when doc_id % 4 = 0 then 'The excerpts do not answer: ' when doc_id % 4 = 1 then 'There is insufficient  information. ' else 'Revenue was found. ' end || text as text from documents"


@query(f"select doc_id, regexp_matches(text, '(?i)({'|'.join(R.REFUSALS)})') as refused from ({REFUSED}) x")
def refusal_detect(spark, d):
    opening = F.when(F.col("doc_id") % 4 == 0, "The excerpts do not answer: ").when(F.col("doc_id") % 4 == 1, "There is insufficient  information. ").otherwise("Revenue was found. ")
    return table(spark, d, "documents").select("doc_id", R.refuses(F.concat(opening, F.col("text"))).alias("refused"))


# -- pages -----------------------------------------------------------------------------------------
KIND = "case when regexp_matches(lower(content), '" + "|".join(R.PAGE_SIGNALS) + "') then 'table' else 'text' end"


def _any(phrases: list[str], text: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


PAGES = with_sql("v_pages") + f", p as (select *, {KIND} as kind, lower(content) as low from v_pages), m as (select doc, min(page) filter (kind = 'table' and {_any(P.STANDALONE, 'low')} and not {_any(P.CONSOLIDATED, 'low')}) as s, min(page) filter (kind = 'table' and {_any(P.CONSOLIDATED, 'low')} and not {_any(P.STANDALONE, 'low')}) as c, max(page) as last from p group by 1), sec as (select doc, case when s is null or s = c then 'consolidated' when c is null then 'standalone' when s < c then 'standalone' else 'consolidated' end as financial_type, 1 as page_start, cast(case when s is null or c is null or s = c then last when s < c then c - 1 else s - 1 end as int) as page_end from m union all select doc, case when s < c then 'consolidated' else 'standalone' end, cast(greatest(s, c) as int), last from m where s <> c) "


def _pages(spark, d):
    rows = relation(spark, d, "v_pages")
    return rows.withColumn("kind", F.when(R.looks_tabular(F.col("content")), "table").otherwise("text"))


@query(PAGES + "select * from sec")
def section_boundaries(spark, d):
    return P.sections(_pages(spark, d))


@query(PAGES + "select p.doc, p.page, p.kind, sec.financial_type as section from p left join sec on p.doc = sec.doc and p.page between page_start and page_end")
def page_section_range_join(spark, d):
    pages = _pages(spark, d)
    return P.place(pages, P.sections(pages)).select("doc", "page", "kind", "section")


HEAD = "substr(low, 1, 400)"
CLASSES = PAGES + (
    f", a as (select p.*, sec.financial_type as section, {_any(P.AUDITOR, HEAD)} as auditor, {_any(P.AUDITOR, HEAD)} or {_any(P.NOTES, HEAD)} as veto, {_count(P.RISK, 'low')} as risk, {_count(P.DISCUSSION, 'low')} as discussion from p left join sec on p.doc = sec.doc and p.page between page_start and page_end)"
    ", b as (select *, last_value(case when auditor and section is not null then page end ignore nulls) over w as ap, last_value(case when auditor and section is not null then section end ignore nulls) over w as aft from a window w as (partition by doc order by page rows between unbounded preceding and 1 preceding))"
    ", c as (select *, coalesce(aft = section and page - ap between 1 and 6, false) as after_auditor from b)"
    f", d as (select *, risk >= 2 and not (veto or after_auditor) as is_risk, discussion >= 2 as is_md, {_any(P.TITLES, 'low')} as titled, contains(low, 'particulars') as lists, {_any(P.TITLES, HEAD)} as head_title from c)"
    ", e as (select *, kind = 'table' and section is not null and not veto and titled and lists and not is_risk and not is_md as own, kind = 'table' and not veto and head_title as anchor from d)"
    ", f as (select *, last_value(case when anchor then page end ignore nulls) over w as tp, last_value(case when anchor then case when own then section else 'unknown' end end ignore nulls) over w as tft from e window w as (partition by doc order by page rows between unbounded preceding and 1 preceding))"
    f", g as (select *, case when {_count(P.FINANCIAL, HEAD)} > 0 then {_count(P.FINANCIAL, HEAD)} else {_count(P.FINANCIAL, 'low')} end as words from f)"
    ", h as (select *, case when is_risk then 'risk_disclosure' when is_md then 'management_discussion' when own or (kind = 'table' and section is not null and not veto and not titled and coalesce(tft = section and page - tp between 1 and 4, false) and words >= 2 and lists) then 'financial_statement' when kind = 'table' then 'table' else 'text' end as block from g) "
)


def _classified(spark, d):
    pages = _pages(spark, d)
    return P.classify(P.place(pages, P.sections(pages)))


@query(CLASSES + "select doc, page, block, case when block = 'financial_statement' then section else 'unknown' end as financial_type from h")
def block_class(spark, d):
    return _classified(spark, d).select("doc", "page", "block", "financial_type")


@query(CLASSES + "select doc, page, after_auditor from h")
def auditor_continuation(spark, d):
    return _classified(spark, d).select("doc", "page", "after_auditor")


@query(CLASSES + "select doc, page from h where block = 'financial_statement' and not own")
def statement_continuation(spark, d):
    return _classified(spark, d).where("block = 'financial_statement' and not own").select("doc", "page")


@query(CLASSES + "select block, count(*) as n from h group by 1")
def block_counts(spark, d):
    return _classified(spark, d).groupBy("block").agg(F.count("*").alias("n"))


@query(with_sql("v_pages") + "select doc, string_agg(content, chr(10) order by page) as text from v_pages where page <= 2 group by 1")
def first_pages_text(spark, d):
    return P.first_pages(relation(spark, d, "v_pages"))


@query(with_sql("v_pages") + "select doc, max(page) as pages from v_pages group by 1")
def page_count(spark, d):
    return P.page_counts(relation(spark, d, "v_pages"))


# -- chunks and layout -------------------------------------------------------------------------------
@query("select doc_id, regexp_replace(md5(cast(doc_id as varchar) || ':1:0:' || substr(text, 1, 100)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as chunk_id from documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", C.chunk_id(F.col("doc_id"), F.lit(1), F.lit(0), F.col("text")).alias("chunk_id"))


@query("with s as (select doc_id, text, unnest(range(0, length(text), 400)) as start from documents where length(text) > 0) select doc_id, cast(start / 400 as int) as position, substr(text, start + 1, 500) as text from s")
def fixed_chunks(spark, d):
    return C.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 500, 100)


def _split_sql(size: int = 800, overlap: int = C.OVERLAP, least: int = C.LEAST) -> str:
    """The recursive splitter as SQL: every chunk is a stretch of what it was split from, so a fold over the lengths of the parts finds where chunks begin and end."""
    steps = ["l0 as (select doc_id, [0::bigint] as path, text from documents where text is not null)"]
    for i, sign in enumerate(C.SEPARATORS):
        lit, n = "'" + sign.replace("\n", "'||chr(10)||'") + "'", len(sign)
        cut = f"length(text) > {size} and contains(text, {lit})"
        # at: where the next part begins; a, b: the open chunk; done: chunks that are closed.
        part = f"list_transform(string_split(text, {lit}), lambda p: {{'at': length(p)::bigint, 'a': 0::bigint, 'b': 0::bigint, 'done': []::bigint[][]}})"
        fits = f"(case when s.b > s.a then s.at + x.at - s.a else x.at end) <= {size}"
        start = f"case when s.b <= s.a then s.at when {fits} then s.a else greatest(s.a, s.b - {overlap}) end"
        done = f"case when {fits} then s.done else list_append(s.done, [s.a, s.b]) end"
        fold = f"list_reduce({part}, lambda s, x: {{'at': s.at + x.at + {n}, 'a': {start}, 'b': s.at + x.at, 'done': {done}}}, {{'at': 0::bigint, 'a': 0::bigint, 'b': 0::bigint, 'done': []::bigint[][]}})"
        steps.append(f"f{i} as (select doc_id, path, text, {fold} as r from l{i} where {cut})")
        steps.append(f"c{i} as (select doc_id, path, text, unnest(list_append(r.done, [r.a, r.b])) as ab, generate_subscripts(list_append(r.done, [r.a, r.b]), 1) as j from f{i})")
        steps.append(f"l{i + 1} as (select doc_id, list_append(path, 0) as path, text from l{i} where not ({cut}) union all select doc_id, list_append(path, j), substr(text, ab[1] + 1, ab[2] - ab[1]) from c{i})")
    steps.append(f"w as (select doc_id, path, text, unnest(case when length(text) > {size} then range(0, length(text), {size - overlap}) else [0] end) as start from l{len(C.SEPARATORS)})")
    steps.append(f"p as (select doc_id, path, start, substr(text, start + 1, greatest(length(text), {size}) * (length(text) <= {size})::int + {size} * (length(text) > {size})::int) as text from w)")
    steps.append("o as (select doc_id, cast(row_number() over (partition by doc_id order by path, start) - 1 as int) as position, text from p where regexp_matches(text, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'))")
    digest = "md5(cast(doc_id as varchar) || ':1:' || cast(position as varchar) || ':' || substr(text, 1, 100))"
    return f"with {', '.join(steps)} select doc_id as doc, 1 as page, 'text' as block, position, text, regexp_replace({digest}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') as chunk_id from o where length(trim(text, ' ')) >= {least}"


@query(_split_sql())
def recursive_chunks(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.lit("text").alias("block"), F.col("text").alias("content"))
    return C.recursive_chunks(rows)


def _words(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("string").alias("text"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 6).alias("x1"), (F.col("l_partkey") % 17).cast("double").alias("top"))


@query(
    "with p as (select l_orderkey as doc, list({'ord': l_linenumber, 'q': l_quantity, 'top': (l_partkey % 17)::double} order by l_linenumber, l_quantity::varchar, l_partkey % 17) as words from lineitem group by 1), a as (select doc, words, list_reduce(list_transform(words, lambda w: [w.top]), lambda s, x: case when len(list_filter(s, lambda a: abs(a - x[1]) <= 3)) > 0 then s else list_concat(s, x) end) as anchors from p), w as (select doc, anchors, unnest(words) as w from a) select doc, 1 as page, w.ord as ord, cast(w.q as varchar) as text, w.q as x0, w.q + 6 as x1, w.top as top, cast(list_position(list_transform(anchors, lambda a: abs(a - w.top) <= 3), true) - 1 as int) as row from w"
)
def row_cluster(spark, d):
    return Y.rows_of_words(_words(spark, d))


@query("select l_orderkey as doc, l_linenumber as ord, cast(sum(apart) over (partition by l_orderkey order by l_quantity, l_linenumber rows unbounded preceding) as int) as cluster from (select *, case when l_quantity - lag(l_quantity + 6) over (partition by l_orderkey order by l_quantity, l_linenumber) > 8 then 1 else 0 end as apart from lineitem) x")
def fragment_clusters(spark, d):
    return Y.fragments(_words(spark, d).withColumn("row", F.lit(0))).select("doc", "ord", "cluster")


@query(
    "with c as (select l_orderkey as doc, l_quantity as x, row_number() over (partition by l_orderkey order by l_quantity) - 1 as cluster from lineitem), n as (select c.*, j, abs(x - col) as far from c left join (values (0, 10.0::double), (1, 25.0), (2, 40.0)) k(j, col) on abs(x - col) <= 0.95 * 15 / 2) select doc, cast(cluster as int) as cluster, x, case when j is not null and row_number() over (partition by doc, j order by far, cluster) = 1 then j else -1 end as placed from n"
)
def greedy_columns(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list("l_quantity")).alias("centres")).withColumn("columns", F.array(F.lit(10.0), F.lit(25.0), F.lit(40.0)))
    rows = Y.columns_of_clusters(rows.withColumn("tolerance", Y.column_tolerance(F.col("columns"))))
    return rows.select("doc", F.posexplode(F.arrays_zip("centres", "placed")).alias("cluster", "z")).select("doc", "cluster", F.col("z.centres").alias("x"), "z.placed")


@query("with x as (select l_orderkey as doc, list_reduce(list([l_extendedprice] order by l_extendedprice), lambda s, x: case when x[1] - s[-1] > 5000 then list_concat(s, x) else s end) as kept from lineitem group by 1) select doc, cast(unnest(range(len(kept))) as int) as nth, unnest(kept) as x from x")
def header_spacing(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list("l_extendedprice").alias("x"))
    return rows.select("doc", F.posexplode(Y.spaced(F.col("x"), 5000.0)).alias("nth", "x"))


# -- labels, companies, evaluation -------------------------------------------------------------------
RAW_LABELS = ["Revenue from Operations", "profil before tax", "Total Income (I+II)", "(a) Revenue from operations (refer note 3)", "D&A", "syntax", "sale of products / services", "Finance  costs*", "Fina nee costs", "Other income", "1. Employee benefits expense", "Total expenses (₹ in crore)", "Watches", "", "EBITDA", "Profit for the year - restated", "unknown thing"]


#: What normalising should give, label by label.
NORMAL_LABELS = ["revenue from operations", "profit before tax", "total income (i+ii)", "revenue from operations", "danda", "syntax", "sale of products/services", "finance costs", "finance costs", "other income", "employee benefits expense", "total expenses", "watches", "", "ebitda", "profit for the year-restated", "unknown thing"]


@query(f"select p_partkey, coalesce(label, lower(p_type)) as label from part left join (values {_sql_list(list(enumerate(NORMAL_LABELS)))}) x(id, label) on id = p_partkey % {len(RAW_LABELS) + 1}")
def nfkc_labels(spark, d):
    """A label of the list, or its type in wide letters, for every part."""
    wide = F.translate("p_type", string.ascii_uppercase, "".join(chr(ord(c) + 0xFEE0) for c in string.ascii_uppercase))
    raw = F.coalesce(F.get(F.array(*map(F.lit, RAW_LABELS)), (F.col("p_partkey") % (len(RAW_LABELS) + 1)).cast("int")), wide)
    return table(spark, d, "part").select("p_partkey", L.normal_label(raw, unicode_forms=True).alias("label"))


ALIASES = f"(values {_sql_list(registry.alias_rows())}) a(alias, metric, ord)"
TYPES = "select p_partkey, case p_partkey % 9 when 0 then 'net sales' when 1 then 'profit before tax' when 2 then 'other income of the group' when 3 then 'tax' when 4 then 'sale of products/services' when 5 then 'basic' when 6 then 'nothing known' when 7 then '' else lower(p_type) end as label from part"


def _labels(spark, d):
    k = F.col("p_partkey") % 9
    label = F.when(k == 0, "net sales").when(k == 1, "profit before tax").when(k == 2, "other income of the group").when(k == 3, "tax").when(k == 4, "sale of products/services").when(k == 5, "basic").when(k == 6, "nothing known").when(k == 7, "").otherwise(F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", label.alias("label"))


@query(f"select p_partkey, label, metric from ({TYPES}) t left join {ALIASES} on alias = label")
def alias_exact(spark, d):
    return registry.resolve_exact(_labels(spark, d), registry.aliases(spark)).select("p_partkey", "label", "metric")


SPLIT = "list_distinct(list_filter(string_split_regex({}, '[\\s/]+'), lambda w: w <> ''))"


@query(
    f"with t as ({TYPES}), l as (select distinct label, {SPLIT.format('label')} as words from t), a as (select *, {SPLIT.format('alias')} as alias_words from {ALIASES}), j as (select label, metric, row_number() over (partition by label order by case when alias = label then 0 else 1 end, len(alias_words) desc, ord) as n from l join a on len(words) > 0 and (list_has_all(alias_words, words) or list_has_all(words, alias_words))) select p_partkey, t.label, case when trim(t.label) = '' then 'unmapped_metric' else coalesce(metric, replace(t.label, ' ', '_')) end as metric from t left join j on j.label = t.label and n = 1"
)
def alias_token_subset(spark, d):
    return registry.resolve_by_words(_labels(spark, d), registry.aliases(spark)).select("p_partkey", "label", "metric")


NAMES = "select s_suppkey, case s_suppkey % 5 when 0 then 'Zomato Limited' when 1 then 'shares of Titan Company ltd' when 2 then ' PAYTM ' when 3 then 'PB Fintech group' else s_name end as name from supplier"
COMPANIES = f"(values {_sql_list(registry.company_rows())}) c(alias, company, ticker, ord)"


@query(f"with n as ({NAMES}), j as (select name, company, ticker, row_number() over (partition by name order by case when alias = lower(trim(name)) then 0 else 1 end, ord) as k from (select distinct name from n) x join {COMPANIES} on contains(lower(trim(name)), alias)) select s_suppkey, n.name, company, ticker from n left join j on j.name = n.name and k = 1")
def company_contains(spark, d):
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "Zomato Limited").when(k == 1, "shares of Titan Company ltd").when(k == 2, " PAYTM ").when(k == 3, "PB Fintech group").otherwise(F.col("s_name"))
    rows = table(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    return registry.resolve_company(rows, registry.company_aliases(spark)).select("s_suppkey", "name", "company", "ticker")


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'BLINKIT' else 'TITAN' end as entity, case when s_suppkey % 3 = 0 then 'ETERNAL' else 'TITAN' end as parent from supplier")
def parent_lookup(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "BLINKIT").otherwise("TITAN").alias("entity"))
    return registry.resolve_parent(rows).select("s_suppkey", "entity", "parent")


GOLDEN = "select case doc_id % 4 when 0 then 'point' when 1 then 'yoy' when 2 then 'adversarial' else 'semantic' end as category, quality as expected, toxic as actual, toxic = 1 as blocked, case when quality = 1 then 'high' else 'low' end as tier from labels"


@query(f"with g as ({GOLDEN}), s as (select category, case when category = 'point' then abs(expected - actual) <= 0.01 when category = 'yoy' then abs(expected - actual) <= 0.5 when category = 'adversarial' then blocked else tier <> 'low' end as passed from g) select case when grouping(category) = 1 then 'all' else category end as category, count(*) as n, count(*) filter (passed) as n_passed from s group by rollup (category)")
def eval_report(spark, d):
    k = F.col("doc_id") % 4
    category = F.when(k == 0, "point").when(k == 1, "yoy").when(k == 2, "adversarial").otherwise("semantic")
    passed = evaluation.passes(category, F.col("quality"), F.col("toxic"), F.col("toxic") == 1, F.when(F.col("quality") == 1, "high").otherwise("low"))
    return evaluation.report(table(spark, d, "labels").select(category.alias("category"), passed.alias("passed")))


NAMED = "array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
MONEY = "'₹' || format('{{:,.1f}}', {}) || ' Cr'"
YEAR = "'FY' || lpad(cast(({}) % 100 as varchar), 2, '0')"
GREW = f"company || chr(39) || 's ' || financial_type || ' ' || {NAMED} || case when yoy_pct > 0 then ' grew ' else ' declined ' end || coalesce(format('{{:,.2f}}', abs(yoy_pct)) || '%', 'an undetermined amount') || ' year-over-year, from ' || {MONEY.format('prior_value')} || ' in ' || {YEAR.format('fiscal_year - 1')} || ' to ' || {MONEY.format('current_value')} || ' in ' || {YEAR.format('fiscal_year')} || '.'"


@query(FACTS + f", yoy as ({YOY} where c.quarter is null) select tenant_id, company, metric, financial_type, fiscal_year, coalesce({GREW}, 'Could not compute year-over-year growth.') as answer from yoy")
def answer_text(spark, d):
    return answer.year_over_year(G.year_over_year(relation(spark, d, "v_facts").where("quarter is null"))).select("tenant_id", "company", "metric", "financial_type", "fiscal_year", "answer")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then -(o_orderkey % 1000)::double when o_orderkey % 3 = 1 then (o_orderkey * 1000 + 634)::double else 0.0::double end as value from orders")
def filing_numbers(spark, d):
    k, n = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("("), (F.col("o_orderkey") % 1000).cast("string"), F.lit(")"))).when(k == 1, F.concat(n, F.lit(".634"))).otherwise("-")
    return table(spark, d, "orders").select("o_orderkey", numbers.filing_number(text).alias("value"))


# -- documents, states, small rules ------------------------------------------------------------------
@query("with k as (select md5(text) as digest, min(doc_id) as known from documents where doc_id % 3 = 0 group by 1) select d.doc_id as given, coalesce(known, d.doc_id) as doc_id from documents d left join k on k.digest = md5(d.text) where d.doc_id % 3 <> 0")
def document_registration(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    known = rows.where("doc_id % 3 = 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return store.register_documents(known, rows.where("doc_id % 3 <> 0").withColumn("given", F.col("doc_id"))).select("given", "doc_id")


@query("select doc_id, case when doc_id in (select doc_id from labels where quality = 1) then 'indexed' else 'pending' end as ingestion_state from documents")
def document_states(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("pending").alias("ingestion_state"))
    return store.set_state(docs, table(spark, d, "labels").where("quality = 1"), "indexed")


@query("select doc_id as chunk_id, case when doc_id % 4 = 0 then 'new' else 'old' end as origin from documents union all select -page_id - 1, 'new' from pages")
def chunk_upsert(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("origin"))
    new = table(spark, d, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("chunk_id"), F.lit("new").alias("origin"))
    return store.upsert_chunks(old, new.unionByName(table(spark, d, "pages").select((-F.col("page_id") - 1).alias("chunk_id"), F.lit("new").alias("origin"))))


@query(with_sql("v_pages") + f"select doc, page, {KIND} as kind from v_pages")
def page_kind(spark, d):
    return _pages(spark, d).select("doc", "page", "kind")


@query("select doc, ord, text from (select conv_id as doc, turn as ord, text, max(case when regexp_matches(lower(text), 'revenue|income|sale|the ') then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as on_ from conversations) x where on_ = 1")
def latched_lines(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), F.col("turn").alias("ord"), F.regexp_replace("text", "(?i)the ", "sale ").alias("marked"), F.col("text").alias("original"))
    return Y.from_first_figure(rows.withColumnRenamed("marked", "text")).select("doc", "ord", F.col("original").alias("text"))


@query("with v as (select l_orderkey as label, list(l_quantity order by l_linenumber, l_partkey, l_quantity) as v from lineitem group by 1), k as (select label, case when len(v) > 2 then v[len(v) - 1:] else v end as v from v) select label, 0 as col, cast(2024 as int) as fiscal_year, 'Q1' as quarter, v[1] as value from k where len(v) >= 1 union all select label, 1, 2023, null, v[2] from k where len(v) >= 2")
def row_records(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"]).alias("values"))
    periods_ = F.array(F.struct(F.lit(2024).alias("fiscal_year"), F.lit("Q1").alias("quarter")), F.struct(F.lit(2023).alias("fiscal_year"), F.lit(None).cast("string").alias("quarter")))
    return Y.records(rows.withColumn("periods", periods_))


@query(with_sql("v_commentary") + f"select chunk_id, regexp_matches(text, '(?i){R.HEDGING}') as hedged, {_said('text')} as said from v_commentary")
def hedging_and_direction(spark, d):
    return relation(spark, d, "v_commentary").select("chunk_id", R.hedged(F.col("text")).alias("hedged"), R.direction(F.col("text")).alias("said"))


@query(AUDIT + "select audit_id, case when cache_hit then least(confidence, 1.0) else least(confidence, 0.75) end as score, case when tier = 'high' and (not cache_hit or latency_ms % 3 <= 1) then 'medium' else tier end as tier from (select *, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as tier from a where confidence is not null and latency_ms is not null) x")
def cross_and_single_source(spark, d):
    rows = _audit(spark, d).where("confidence is not null and latency_ms is not null")
    score, tier = R.cross_confidence(F.col("cache_hit"), F.col("confidence"), K.tier(F.col("confidence")))
    return rows.select("audit_id", score.alias("score"), R.single_source(tier, F.col("latency_ms") % 3).alias("tier"))


@query("select l_orderkey, l_linenumber, 'Revenue from line ' || l_linestatus as description, 2716.0::double as value1, -l_linenumber::double as value2, l_quantity as value3, 3 as n_values from lineitem")
def parsed_lines(spark, d):
    from .operators import extract

    line = F.concat(F.lit("II Revenue from line "), F.col("l_linestatus"), F.lit(" 2 716 ("), F.col("l_linenumber").cast("string"), F.lit(") "), F.col("l_quantity").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", extract.parse_line(line).alias("p")).select("l_orderkey", "l_linenumber", "p.description", *(F.get("p.values", F.lit(i)).alias(f"value{i + 1}") for i in range(3)), F.size("p.values").alias("n_values"))


HASHED = f"with r as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents), w as (select r, md5(unnest({WORDS})) as h from r), c as (select r, ('0x' || substr(h, 1, 6))::int % 64 as component, sum(1 - 2 * (('0x' || substr(h, 7, 1))::int % 2))::double as x from w group by 1, 2), n as (select r, sqrt(sum(x * x)) as norm from c group by 1), every as (select r, doc_id, unnest(range(64)) as component from r) "


@query(HASHED + "select doc_id, list(round(case when norm > 0 then coalesce(x, 0) / norm else 0 end, 6) order by component) as embedding from every left join c using (r, component) left join n using (r) group by r, doc_id")
def hashed_vectors(spark, d):
    from .operators import encode

    rows = encode.dense(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# -- questions and their results, both sides, stored facts -------------------------------------------
ASKED_AND_TOLD = """
with g as (select doc_id as id, case doc_id % 6 when 0 then 'quantitative_point' when 1 then 'quantitative_yoy' when 2 then 'adversarial' when 3 then 'out_of_corpus' when 4 then 'semantic_general' else 'semantic_honest_refusal' end as category,
  cast(doc_id % 5 as double) as expected_value, cast(doc_id % 3 as double) as expected_yoy_pct, case when doc_id % 7 = 0 then 'cross' else null end as expected_path from documents),
r as (select doc_id as id, 'quantitative' as path, toxic = 1 as is_blocked, quality = 1 as sql_verified, case when quality = 1 then 'high' else 'low' end as confidence_tier, cast(doc_id % 4 as double) as value, cast(doc_id % 4 as double) / 2 as yoy_pct,
  case when doc_id % 2 = 1 then 'It is not found here' when doc_id % 8 = 0 then 'nothing' else 'the end of it' end as response_text from labels)
"""


@query(
    ASKED_AND_TOLD
    + ", s as (select g.id, category, r.id is not null and case category when 'adversarial' then coalesce(is_blocked, false) when 'out_of_corpus' then not coalesce(sql_verified, false) and coalesce(confidence_tier, 'low') = 'low' else not coalesce(is_blocked, false) and (expected_path is null or expected_path = path) and case category when 'quantitative_point' then sql_verified and abs(value - expected_value) < 0.01 when 'quantitative_yoy' then sql_verified and abs(yoy_pct - expected_yoy_pct) <= 0.5 when 'semantic_general' then confidence_tier <> 'low' and contains(lower(response_text), 'the') and contains(lower(response_text), 'of') else contains(lower(response_text), 'not found') end end as passed from g left join r on r.id = g.id) select id, category, coalesce(passed, false) as passed from s"
)
def eval_scored(spark, d):
    k, c = F.col("doc_id") % 6, F.col
    category = F.when(k == 0, "quantitative_point").when(k == 1, "quantitative_yoy").when(k == 2, "adversarial").when(k == 3, "out_of_corpus").when(k == 4, "semantic_general").otherwise("semantic_honest_refusal")
    golden = table(spark, d, "documents").select(c("doc_id").alias("id"), category.alias("category"), (c("doc_id") % 5).cast("double").alias("expected_value"), (c("doc_id") % 3).cast("double").alias("expected_yoy_pct"), F.when(c("doc_id") % 7 == 0, "cross").alias("expected_path"), F.array(F.lit("the"), F.lit("Of")).alias("expected_keywords"))
    good = c("quality") == 1
    told = F.when(c("doc_id") % 2 == 1, "It is not found here").when(c("doc_id") % 8 == 0, "nothing").otherwise("the end of it")
    results = table(spark, d, "labels").select(c("doc_id").alias("id"), F.lit("quantitative").alias("path"), (c("toxic") == 1).alias("is_blocked"), good.alias("sql_verified"), F.when(good, "high").otherwise("low").alias("confidence_tier"), (c("doc_id") % 4).cast("double").alias("value"), ((c("doc_id") % 4) / 2).alias("yoy_pct"), told.alias("response_text"))
    return evaluation.scored(evaluation.joined(golden, results)).select("id", "category", "passed")


@query("select coalesce(h.query_id, v.query_id) as query_id, h.chunk_id, v.verified from (select doc_id as query_id, source as chunk_id from documents where source <> 'x' and doc_id not in (select doc_id from labels where toxic = 1)) h full join (select doc_id as query_id, cast(quality as double) as verified from labels) v on v.query_id = h.query_id")
def both_sides(spark, d):
    hits = table(spark, d, "documents").where("source <> 'x'").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti").select(F.col("doc_id").alias("query_id"), F.col("source").alias("chunk_id"))
    verified = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").cast("double").alias("verified"))
    return router.both_sides(hits, verified)


@query(FILINGS + f"select metric, cast(value as double) as value, quarter, filing_date from (select *, row_number() over (partition by {FILING_KEY} order by filing_date desc, seq desc, doc_id desc) as nth from f) x where nth = 1 and company = 'BUILDING' and fiscal_year = 1997 and financial_type = 'consolidated'")
def verify_read(spark, d):
    rows = V.upsert(_filings(spark, d).where("version < 1").withColumn("is_latest", F.lit(True)), _filings(spark, d))
    return store.verify_facts(rows, "BUILDING", 1997, "consolidated").withColumn("value", numbers.number(F.col("value")))


@query(f"with dense as ({_ranked(DOT, 5)}) select query_id, count(distinct chunk_id) as n_sources from dense group by 1")
def cited_sources(spark, d):
    hits = T.dense(_asked(spark, d), _vectors(spark, d), k=5)
    described = hits.select("query_id", "chunk_id", "rank", "score", F.lit("A").alias("company"), F.lit(2024).alias("fiscal_year"), F.lit("consolidated").alias("financial_type"), F.lit(1).alias("page_number"), F.lit("2024-05-01").alias("filing_date"))
    return answer.sources_block(described).select("query_id", "n_sources")


@query(
    CLASSES
    + f", k as (select *, case when block = 'financial_statement' then section else 'unknown' end as shown from h where length(trim(content)) >= {C.LEAST}) select doc, page as page_number, shown as financial_type, block as chunk_type, case block when 'financial_statement' then 'Financial Statements' when 'table' then 'Tables' when 'risk_disclosure' then 'Risk Disclosures' when 'management_discussion' then 'Management Discussion' else 'General' end as section, 't' || cast(doc % 2 as varchar) as tenant_id, cast(doc as varchar) || '_' || case when shown <> 'unknown' then shown else (select min(section) from h f where f.doc = k.doc and f.block = 'financial_statement') end as doc_id, regexp_replace(md5(cast(doc as varchar) || ':' || cast(page as varchar) || ':0:' || substr(content, 1, 100)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') as chunk_id, content as text from k where doc in (select doc from h where block = 'financial_statement')"
)
def described_chunks(spark, d):
    pages = _classified(spark, d)
    files = pages.select("doc").distinct().select("doc", F.concat(F.lit("t"), (F.col("doc") % 2).cast("string")).alias("tenant_id"), F.lit("A").alias("company"), F.lit("2024-05-01").cast("date").alias("filing_date"))
    rows = C.described(C.recursive_chunks(pages), pages, ingest.section_documents(files, pages))
    return rows.select(F.split("doc_id", "_")[0].cast("bigint").alias("doc"), "page_number", "financial_type", "chunk_type", "section", "tenant_id", "doc_id", "chunk_id", "text")
