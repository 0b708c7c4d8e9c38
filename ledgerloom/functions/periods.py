"""Fiscal periods: years start in April, quarters are Q1 (April to June) to Q4, annual facts have no quarter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fiscal_year(date: Column) -> Column:
    """Four-digit year in which the fiscal year of a date ends."""
    return (F.year(date) + F.when(F.month(date) >= 4, 1).otherwise(0)).cast("int")


def quarter(date: Column) -> Column:
    return F.concat(F.lit("Q"), (F.floor((F.month(date) + 8) % 12 / 3) + 1).cast("int").cast("string"))


def label(year: Column) -> Column:
    """``FYyy`` for display only; years are kept and compared as numbers."""
    return F.concat(F.lit("FY"), F.lpad((year % 100).cast("string"), 2, "0"))


def parse_label(text: Column) -> Column:
    """Four-digit year of ``FYyy`` or ``FYyyyy``; two digits from 70 on are of the last century."""
    digits = F.regexp_extract(F.upper(F.trim(text)), r"^FY\s*(\d{2}|\d{4})$", 1)
    number = F.when(digits != "", digits.cast("int"))
    return F.when(F.length(digits) == 4, number).when(number >= 70, number + 1900).otherwise(number + 2000).cast("int")


def normal_quarter(text: Column) -> Column:
    """Null for blanks and spelled-out nulls, else trimmed capitals."""
    name = F.upper(F.trim(text))
    return F.when(name.isin("", "NONE", "NULL"), F.lit(None).cast("string")).otherwise(name)


def prior_year(year: Column) -> Column:
    return year - 1
