"""Every query against its SQL twin on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from ledgerloom import catalog  # noqa: E402


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    return x


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, other, name):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert rows or name.endswith("unset")
        return
    cursor = other.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda r: str([(x is None, x if not isinstance(x, float) else round(x, 2)) for x in r])
    ours = sorted(([plain(r[c]) for c in order] for r in rows), key=key)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in cursor.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=2e-5) if any(isinstance(x, float) for x in a) and None not in a and None not in b and not any(isinstance(x, (str, bool)) for x in a) else [round(x, 3) if isinstance(x, float) else x for x in a] == [round(x, 3) if isinstance(x, float) else x for x in b]


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
