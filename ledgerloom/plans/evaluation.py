"""Scoring of answers against expected ones, by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def passes(category: Column, expected: Column, actual: Column, blocked: Column, tier: Column) -> Column:
    """Values within 0.01, growth within half a point, adversarial questions blocked, others of no low tier."""
    near = lambda d: F.coalesce(F.abs(expected - actual) <= d, F.lit(False))
    return (
        F.when(category.isin("point", "standalone"), near(0.01))
        .when(category.isin("yoy", "growth_comparison"), near(0.5))
        .when(category == "adversarial", F.coalesce(blocked, F.lit(False)))
        .when(category == "out_of_corpus", F.coalesce(tier == "low", F.lit(True)))
        .otherwise(F.coalesce(tier != "low", F.lit(False)))
    )


# What answers say where nothing was restated, where nothing was found, where two periods were asked for.
NOT_RESTATED = ("no restatement", "not restated", "only one filing", "single filing")
NOT_FOUND = ("do not contain", "does not contain", "no information", "not addressed", "not discussed", "not found")
UNSUPPORTED = ("could not generate a valid dsl", "not supported", "rephrase")
#: Differences that pass, of values and of growth in points.
VALUE, POINTS = 0.01, 0.5

#: Columns of golden rows and of results that the scorers read; ``joined`` adds those that are missing as nulls.
EXPECTED = {
    "expected_path": "string", "expected_error": "string", "expected_value": "double", "expected_yoy_pct": "double", "expected_higher_entity": "string", "expected_value_entity_a": "double", "expected_value_entity_b": "double",
    "expected_faster_entity": "string", "expected_yoy_a_pct": "double", "expected_yoy_b_pct": "double", "expected_keywords": "array<string>", "expected_source_pages": "array<int>", "expect_no_restatement": "boolean", "value_tolerance": "double",
}
ACTUAL = {
    "path": "string", "is_blocked": "boolean", "sql_verified": "boolean", "error": "string", "confidence_tier": "string", "response_text": "string", "value": "double", "yoy_pct": "double", "entity1": "string", "entity2": "string", "value1": "double", "value2": "double",
    "faster_growing_entity": "string", "yoy_a_pct": "double", "yoy_b_pct": "double", "pages": "array<int>",
}


def joined(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Golden questions (id, category, expected ...) with their results by id; ``answered`` is false where there is none."""

    def full(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns})

    left, right = full(golden, EXPECTED).select("id", "category", *EXPECTED), full(results, ACTUAL).select("id", *ACTUAL, F.lit(True).alias("answered"))
    return left.join(right, "id", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def _says(phrases: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce("response_text", F.lit("")))
    return F.greatest(*(text.contains(p) for p in phrases))


def scored(rows: DataFrame) -> DataFrame:
    """Rows of ``joined`` with ``passed``: each category of question by its own rule.

    A question without an answer fails, as does a blocked one that should not be, a wrong path and a
    category without a rule.  Columns that a rule needs and that are null fail it.
    """
    c = F.col
    yes = lambda name: F.coalesce(name, F.lit(False))
    near = lambda a, b, d: F.coalesce(F.abs(c(a) - c(b)) <= d, F.lit(False))
    unless = lambda wanted, test: c(wanted).isNull() | test
    close, verified = F.coalesce("value_tolerance", F.lit(VALUE)), yes("sql_verified")
    low = F.coalesce("confidence_tier", F.lit("low")) == "low"
    value = verified & F.coalesce(F.abs(c("value") - c("expected_value")) < VALUE, F.lit(False))
    higher = F.when(c("value1") > c("value2"), c("entity1")).otherwise(c("entity2"))
    minus = F.coalesce(F.regexp_like(F.lower("response_text"), F.lit("(?s)^((?!higher).)*-((?!higher).){0,9}higher")), F.lit(False))
    comparison = verified & c("value1").isNotNull() & unless("expected_higher_entity", higher.eqNullSafe(c("expected_higher_entity"))) & ~minus
    comparison &= unless("expected_value_entity_a", near("value1", "expected_value_entity_a", close)) & unless("expected_value_entity_b", near("value2", "expected_value_entity_b", close))
    points = F.coalesce("value_tolerance", F.lit(POINTS))
    growth = verified & c("faster_growing_entity").isNotNull() & unless("expected_faster_entity", c("faster_growing_entity").eqNullSafe(c("expected_faster_entity")))
    growth &= unless("expected_yoy_a_pct", near("yoy_a_pct", "expected_yoy_a_pct", points)) & unless("expected_yoy_b_pct", near("yoy_b_pct", "expected_yoy_b_pct", points))
    collapsed = F.coalesce(c("entity1") == c("entity2"), F.lit(False))
    restated = F.when(yes("expect_no_restatement"), _says(NOT_RESTATED)).otherwise(verified & F.coalesce(F.abs(c("value") - c("expected_value")) < close, F.lit(False)))
    keywords = F.forall(F.coalesce("expected_keywords", F.array().cast("array<string>")), lambda k: F.lower(F.coalesce("response_text", F.lit(""))).contains(F.lower(k)))
    known_error = F.coalesce((c("expected_error") != "") & F.coalesce("error", F.lit("")).contains(c("expected_error")), F.lit(False))
    kind, by_path = c("category"), yes(~yes("is_blocked") & unless("expected_path", c("path").eqNullSafe(c("expected_path"))))
    rule = (
        F.when(kind == "adversarial", yes("is_blocked"))
        .when(kind == "out_of_corpus", ~verified & (low | known_error))
        .when(~by_path, F.lit(False))
        .when(kind.isin("quantitative_point", "quantitative_standalone"), value)
        .when(kind == "quantitative_yoy", verified & near("yoy_pct", "expected_yoy_pct", POINTS))
        .when(kind == "quantitative_comparison", comparison)
        .when(kind == "quantitative_growth_comparison", growth)
        .when(kind == "quantitative_cross_period_refusal", ~collapsed & (~verified | (F.coalesce("error", F.lit("")) != "") | _says(UNSUPPORTED)))
        .when(kind == "quantitative_restatement", restated)
        .when(kind == "semantic_honest_refusal", _says(NOT_FOUND))
        .when(kind.startswith("semantic_"), ~low & keywords)
        .otherwise(F.lit(False))
    )
    return rows.withColumn("passed", c("answered") & rule)


def missing_keywords(rows: DataFrame) -> DataFrame:
    """id, missing: expected keywords that an answer lacks, and id, missed_pages: expected pages that it does not cite."""
    text = F.lower(F.coalesce("response_text", F.lit("")))
    words = F.filter(F.coalesce("expected_keywords", F.array().cast("array<string>")), lambda k: ~text.contains(F.lower(k)))
    return rows.select("id", words.alias("missing"), F.array_except(F.coalesce("expected_source_pages", F.array().cast("array<int>")), F.coalesce("pages", F.array().cast("array<int>"))).alias("missed_pages"))


def report(scored: DataFrame) -> DataFrame:
    """category, n, n_passed by category and, as ``all``, in total: one pass."""
    rows = scored.rollup("category").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.grouping("category").alias("total"))
    return rows.select(F.when(F.col("total") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "n_passed")
