"""Routing of questions: what a classifier returned, made sound, and which engine answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.contradictions import direction_flags, magnitude_flags
from ..operators.retrieval import TOP_RANKED, TOP_RETRIEVED, bm25, dense, fuse, rerank
from . import dsl
from .registry import COMPANIES, PARENTS

PATHS = ("semantic", "quantitative", "cross")


@dataclass(frozen=True)
class Route:
    path: str
    company: str | None
    fiscal_year: str | None
    quarter: str | None
    financial_type: str
    operation: str | None = None

    def resolved(self, question: str) -> str:
        """The question with what is known of it in front."""
        return " ".join([x for x in (self.company, self.fiscal_year, self.quarter, self.financial_type) if x and x.strip()] + [question])


def _blank(x: str | None) -> str | None:
    return None if x is None or x.strip().lower() in ("", "null", "none") else x.strip()


def company_of(name: str | None) -> str | None:
    """Ticker of a known company by name or subsidiary, else none."""
    key = (_blank(name) or "").lower()
    if not key:
        return None
    owner = PARENTS.get(key.upper())
    exact = [c.ticker for c in COMPANIES if key in c.aliases or c.ticker in (key.upper(), owner)]
    return (exact or [c.ticker for c in COMPANIES if any(a in key for a in c.aliases)] or [None])[0]


def normalise(raw: dict, context: dict | None = None) -> Route:
    """A classifier's answer with unknown values replaced by defaults; a caller's own choice of path and operation wins."""
    context = context or {}
    path = (_blank(raw.get("path")) or "semantic").lower()
    kind = (_blank(raw.get("financial_type")) or "consolidated").lower()
    year = _blank(raw.get("fiscal_year"))
    forced = context.get("intended_path") if context.get("enforce_path") else None
    return Route(
        forced or (path if path in PATHS else "semantic"),
        company_of(raw.get("company")),
        year.upper() if year else None,
        dsl.quarter_of(raw.get("quarter")),
        kind if kind in ("consolidated", "standalone") else "consolidated",
        context.get("intended_operation") if forced else None,
    )


def retrieve(queries: DataFrame, chunks: DataFrame, skip_rerank: bool = False) -> DataFrame:
    """Dense and sparse legs, fused and reranked; the first of the fused where memory forbids reranking.

    ``queries``: query_id, question, embedding; ``chunks``: chunk_id, text, embedding, already filtered.
    """
    fused = fuse([dense(queries, chunks, TOP_RETRIEVED), bm25(queries, chunks, TOP_RETRIEVED)])
    return fused.where(f"rank <= {TOP_RANKED}") if skip_rerank else rerank(fused, queries, chunks)


def cross_examine(hits: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags of claims and of directions in retrieved chunks (query_id, chunk_id, text) against verified rows (query_id, verified, yoy_pct).

    A question without a verified row keeps its chunks and gets no flags.
    """
    rows = both_sides(hits, verified).where("chunk_id is not null")
    return magnitude_flags(rows), direction_flags(rows.where("yoy_pct is not null"))


def both_sides(hits: DataFrame, verified: DataFrame) -> DataFrame:
    """Retrieved chunks and verified rows of each question: either side may be absent, and then its columns are null."""
    return hits.join(verified, "query_id", "full")
