"""Exact percentiles from sketches against numpy, with bounds that fail and bounds that stay wide."""

import numpy as np
import pytest

from ledgerloom.operators import quantiles as Q

SHARES = [0.0, 0.5, 0.95, 1.0]
SCHEMA = "g string, day int, v double, share string"


def expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]]
        out |= {(g, s): float(np.quantile(values, s)) for s in SHARES if values}
    return out


def got(df):
    return {(r["g"], r["share"]): r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    hot = [("hot", i % 7, float(x), "x") for i, x in enumerate(rng.lognormal(3, 2, 20_000))]
    tied = [("tied", i % 7, float(i % 3), "x") for i in range(5000)]
    return [*hot, *tied, ("one", 1, 4.5, None), (None, 1, 1.0, "x"), (None, 2, 2.0, "x"), ("none", 1, None, "x"), ("none", 1, float("nan"), "x"), ("hot", 1, float("inf"), "x")]


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12) or (np.isnan(b[k]) and k[1] == 1.0), k


@pytest.mark.parametrize("k,held", [(1600, 1_000_000), (8, 50), (200, 1)])
def test_exact_at_every_error(spark, rows, k, held):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("share", "label")
    same(got(Q.exact(df, ["g"], "v", SHARES, k=k, held=held)), expected(rows))


def test_stored_sketches_merge_and_stale_ones_do_not_mislead(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).drop("share")
    by_day = Q.sketches(df, ["g", "day"], "v")
    same(got(Q.exact(df, ["g"], "v", SHARES, by_day)), expected(rows))
    near = got(Q.approximate(by_day, ["g"], [0.5]))
    assert near["hot", 0.5] == pytest.approx(expected(rows)["hot", 0.5], rel=0.1)
    late = [("hot", 9, float(x), "x") for x in range(1_000_000, 1_030_000)]
    more = df.unionByName(spark.createDataFrame(late, SCHEMA).drop("share"))
    same(got(Q.exact(more, ["g"], "v", SHARES, by_day)), expected([*rows, *late]))


def test_empty_and_whole_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.exact(empty, ["g"], "v", [0.5]).count() == 0
    some = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert [r["value"] for r in Q.exact(some, [], "v", [0.75]).collect()] == [3.0]


def test_passes_count_before_they_shuffle(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).drop("share")
    told = []
    monkeypatch.setattr(Q, "_settled", lambda rows, by, t: told.append(t) or t)
    Q.exact(df, ["g"], "v", [0.5])
    t = {r["g"]: r for r in told[0].collect()}
    assert t["hot"]["inside"] < 0.05 * t["hot"]["total"] and all(r["covered"] for r in t.values())
