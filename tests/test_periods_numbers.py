import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, periods


def test_fiscal_periods_cross_the_century(spark):
    days = [dt.date(1999, 3, 31), dt.date(1999, 4, 1), dt.date(2000, 1, 1), dt.date(2009, 7, 2)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").withColumn("fy", periods.fiscal_year(F.col("d")))
    got = rows.select("fy", periods.quarter(F.col("d")), periods.label(F.col("fy")), periods.label(periods.prior_year(F.col("fy")))).collect()
    assert [tuple(r) for r in got] == [(1999, "Q4", "FY99", "FY98"), (2000, "Q1", "FY00", "FY99"), (2000, "Q4", "FY00", "FY99"), (2010, "Q2", "FY10", "FY09")]


@pytest.mark.parametrize("text,year", [("FY26", 2026), ("fy 99", 1999), ("FY2024", 2024), ("x", None), (None, None)])
def test_parse_label(spark, text, year):
    assert spark.createDataFrame([(text,)], "t string").select(periods.parse_label(F.col("t"))).first()[0] == year


@pytest.mark.parametrize("text,quarter", [(" q1 ", "Q1"), ("None", None), ("null", None), ("", None), (None, None)])
def test_normal_quarter(spark, text, quarter):
    assert spark.createDataFrame([(text,)], "t string").select(periods.normal_quarter(F.col("t"))).first()[0] == quarter


@pytest.mark.parametrize("text,value", [("1,234", 1234.0), ("(186)", -186.0), ("17.634", 17634.0), ("-", 0.0), ("", 0.0), ("12.5", 12.5), ("/45\\", -45.0), ("abc", None), (None, 0.0)])
def test_filing_number(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(numbers.filing_number(F.col("t"))).first()[0] == value


def test_growth_uses_the_magnitude_of_the_base(spark):
    rows = spark.createDataFrame([(552.0, -663.0), (1.0, 0.0), (110.0, 100.0)], "a double, b double")
    got = [r[0] for r in rows.select(F.round(numbers.growth_pct(F.col("a"), F.col("b")), 2)).collect()]
    assert got == [183.26, None, 10.0]
