"""Arithmetic that never fails a query: divisions give null where a denominator is zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(x: Column) -> Column:
    return x.cast("double")


def growth_pct(now: Column, before: Column) -> Column:
    """Change on the magnitude of the earlier value, in per cent; null on a zero base."""
    return F.try_divide(number(now) - number(before), F.abs(number(before))) * 100


def share_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(number(part) * 100, number(whole))


def compound_pct(first: Column, last: Column, steps: Column) -> Column:
    """Compound growth a step in per cent; null unless both ends are positive and there is a step."""
    ok = (number(first) > 0) & (number(last) > 0) & (steps > 0)
    return F.when(ok, (F.pow(number(last) / number(first), F.lit(1.0) / steps) - 1) * 100)


def filing_number(text: Column) -> Column:
    """A printed figure as a number: dashes are zero, brackets negative, a point before three last digits parts thousands."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[()/\\]", ""), r"\.(?=\d{3}$)", ""), ",", "")
    value = plain.try_cast("double")
    negative = (F.contains(text, F.lit("(")) & F.contains(text, F.lit(")"))) | (F.contains(text, F.lit("/")) & F.contains(text, F.lit("\\")))
    return F.when(text.isNull() | text.isin("", "-"), F.lit(0.0)).when(negative, -value).otherwise(value)
