"""Restatements: which filing's value counts, and what became of every filing.

The business key compares quarters null-safe.  Versions arrive in the order of ``seq``; the latest
filing date wins, and of equal dates the later arrival, so every key has exactly one latest row in
whatever order, and however often, filings are replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEY = ["tenant_id", "company", "metric", "fiscal_year", "financial_type", "quarter"]


def latest(filings: DataFrame) -> DataFrame:
    """The one row of each key that counts.  A window, as keys have few versions and one shuffle serves all."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("filing_date"), F.desc("seq"), F.desc("doc_id"))
    return filings.where(F.col("filing_date").isNotNull()).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def outcomes(filings: DataFrame) -> DataFrame:
    """Each filing with its outcome on arrival: inserted, restated, reingested or skipped.

    A filing is held against the latest of those stored before it: skipped if its date is missing or
    older or if it is that same document, restated if it is newer, reingested if another document
    has the same date.
    """
    before = Window.partitionBy(*KEY).orderBy("seq", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.max(F.when(F.col("filing_date").isNotNull(), F.struct("filing_date", "seq", "doc_id"))).over(before)
    rows = filings.withColumn("held", held)
    outcome = (
        F.when(F.col("filing_date").isNull(), "skipped")
        .when(F.col("held").isNull(), "inserted")
        .when((F.col("held.doc_id") == F.col("doc_id")) | (F.col("filing_date") < F.col("held.filing_date")), "skipped")
        .when(F.col("filing_date") > F.col("held.filing_date"), "restated")
        .otherwise("reingested")
    )
    return rows.withColumn("outcome", outcome).drop("held")


def insert_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose document and key ``existing`` lacks; null quarters are equal."""
    on = F.lit(True)
    for c in ["doc_id", "metric", "fiscal_year", "financial_type", "quarter"]:
        on = on & incoming[c].eqNullSafe(existing[c])
    return incoming.join(existing, on, "left_anti")


def restatements(filings: DataFrame) -> DataFrame:
    """First and latest value of the keys that changed, with the change in per cent."""
    from ..functions.numbers import growth_pct, number

    ordered = F.struct("filing_date", "seq", "doc_id")
    rows = filings.where(F.col("filing_date").isNotNull()).groupBy(*KEY).agg(F.min_by("value", ordered).alias("first_value"), F.max_by("value", ordered).alias("latest_value"), F.count("*").cast("bigint").alias("n_versions"))
    return rows.where("first_value <> latest_value").select("company", "fiscal_year", number(F.col("first_value")).alias("first_value"), number(F.col("latest_value")).alias("latest_value"), "n_versions", F.round(growth_pct(F.col("latest_value"), F.col("first_value")), 2).alias("change_pct"))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after a batch: all versions, with ``is_latest`` recomputed, so that reruns change nothing."""
    columns = [c for c in existing.columns if c != "is_latest"]
    rows = existing.select(columns).unionByName(incoming.select(columns))
    once = Window.partitionBy(*KEY, "doc_id").orderBy("seq")
    best = Window.partitionBy(*KEY).orderBy(F.desc("filing_date"), F.desc("seq"), F.desc("doc_id"))
    rows = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    return rows.withColumn("is_latest", F.row_number().over(best) == 1)


def history(versions: DataFrame) -> DataFrame:
    """Versions with ``valid_from`` and ``valid_to``: from its filing until the next one's, a value is the one that counts.

    Of filings of one date the last to arrive counts, and the others for no time at all; filings
    without a date never count.
    """
    in_turn = Window.partitionBy(*KEY).orderBy("filing_date", "seq", "doc_id")
    return versions.withColumn("valid_from", F.col("filing_date")).withColumn("valid_to", F.lead("filing_date").over(in_turn))


def as_of(rows: DataFrame, date) -> DataFrame:
    """The rows of a ``history`` that counted on a date."""
    day = F.lit(date).cast("date")
    return rows.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))
