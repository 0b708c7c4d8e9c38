"""Replies of language models as typed query records.

A reply should be one JSON object; in practice it comes in a code fence, between sentences, wrapped
in another object, or broken.  Each reply is tried as it is, as the inside of its fence, and from its
first brace to its last; what parses first is kept as a VARIANT, whose fields become the columns of
the query language.  All of it is column expressions, so a filter on a field of stored replies is
pushed into the scan and reads that field's column alone where the file holds it apart.

Defined results: a null or blank reply is ``empty``; one that never parses ``unparsed``; JSON that is
no object ``no_object``; an object without a required field ``incomplete``, and ``missing`` names
them; one with an unknown operation or financial type, or a year that is none, ``unknown``; others
are ``sound``.  An object that gives a key twice is ``unparsed``.  Values that
say null or none are null; names are cut of spaces; other columns of these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dsl import OPERATIONS

REQUIRED = ("metric", "entity", "fiscal_year", "financial_type", "operation")
FIELDS = (*REQUIRED, "quarter", "comparison_entity", "comparison_period")
KINDS = ("consolidated", "standalone")


def parsed(text: Column) -> Column:
    """The reply as a VARIANT, or null."""
    fenced = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(F.trim(text)), *(F.try_parse_json(F.when(x != "", x)) for x in (fenced, braced)))


def field(reply: Column, name: str, wrapper: str = "query") -> Column:
    """A field of the reply or of the object that it is wrapped in, as a string."""
    value = F.trim(F.coalesce(F.try_variant_get(reply, f"$.{name}", "string"), F.try_variant_get(reply, f"$.{wrapper}.{name}", "string")))
    return F.when(~F.lower(value).isin("", "null", "none"), value)


def year(text: Column) -> Column:
    """Four-digit year of FY26, FY2026 or 2026, else null."""
    n = F.regexp_extract(F.upper(F.trim(text)), r"^(?:FY\s*)?(\d{4}|\d{2})$", 1).try_cast("int")
    return F.when(n > 99, n).otherwise(n + F.when(n >= 70, 1900).otherwise(2000))


def records(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Every column but the text, then state, missing and the fields of the query language."""
    kept = [c for c in replies.columns if c != text and c not in (*FIELDS, "state", "missing")]
    rows = replies.select(*kept, F.col(text).alias("_text"), parsed(F.col(text)).alias("_reply"))
    rows = rows.select(*kept, "_text", "_reply", *(field(F.col("_reply"), f).alias(f) for f in FIELDS))
    lower = [F.lower(f).alias(f) if f in ("metric", "financial_type", "operation") else F.upper(f).alias(f) if f != "comparison_period" else F.col(f) for f in FIELDS]
    rows = rows.select(*kept, "_text", "_reply", *lower).withColumn("_year", year(F.col("fiscal_year")))
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED))), ",")
    unknown = ~F.col("operation").isin(*OPERATIONS) | ~F.col("financial_type").isin(*KINDS) | F.col("_year").isNull()
    state = (
        F.when(~F.coalesce("_text", F.lit("")).rlike(r"\S"), "empty")
        .when(F.col("_reply").isNull(), "unparsed")
        .when(~F.startswith(F.schema_of_variant("_reply"), F.lit("OBJECT")), "no_object")
        .when(missing != "", "incomplete")
        .when(unknown, "unknown")
        .otherwise("sound")
    )
    return rows.select(*kept, state.alias("state"), missing.alias("missing"), *(F.col("_year").alias(f) if f == "fiscal_year" else F.col(f) for f in FIELDS))


def keep(replies: DataFrame, path: str, text: str = "reply") -> None:
    """Store replies beside their VARIANT; read it back with ``field`` and filters reach the file's columns."""
    replies.withColumn("parsed", parsed(F.col(text))).write.mode("append").parquet(path)
