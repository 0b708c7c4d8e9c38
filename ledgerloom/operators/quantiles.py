"""Exact percentiles that start from mergeable sketches.

A sketch of each group (and of each day, tenant or batch, as stored sketches merge) tells between
which two values a percentile lies, up to the sketch's error.  One pass counts what lies below and
between these bounds, which proves or refutes them; bounds that fail are given up, bounds that still
hold more than ``HELD`` rows are drawn closer by a sketch of those rows alone.  A last pass counts
the values between the bounds, and only those: no task sees all values of a group, and what one
task sees is bounded by ``HELD`` unless some few values repeat that often, which count once each.

Defined results: linear interpolation between the two nearest values, as ``percentile_cont``; null
and NaN values take no part; groups without other values give no row; null group columns are a
group; an empty table gives no rows; stored sketches that miss rows cost a pass, never exactness.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.snapshots import shared_dir

#: Size of a sketch; rows between bounds that the last pass may order in one task; groups that are broadcast.
K, HELD, BROADCAST_GROUPS = 1600, 1_000_000, 10_000
#: Ranks that a sketch is asked for, evenly spaced: it takes constant ranks only.
GRID = 256
#: Passes that draw bounds closer.  Each leaves some hundredth of the rows, so six are enough for any table.
ROUNDS = 6


def error(k: int) -> float:
    """Rank error that holds with a probability of 99 per cent (published fit of the sketch), doubled."""
    return 2 * 2.296 / k**0.9021


def sketches(rows: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """``by`` and the sketch of each group; store it, and merge it by any of its columns later."""
    return _sound(rows, by, value).groupBy(*by).agg(F.kll_sketch_agg_double("value", k).alias("sketch"))


def approximate(stored: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """``by``, share, value from stored sketches alone, within the sketch's error."""
    at = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias("value")) for s in shares)))
    return _merged(stored, by).select(*by, at.alias("x")).select(*by, "x.*")


def exact(rows: DataFrame, by: list[str], value: str, shares: list[float], stored: DataFrame | None = None, k: int = K, held: int = HELD) -> DataFrame:
    """``by``, share, value: exact percentiles of each group.  Starts jobs: bounds are settled before the last pass."""
    sound = _sound(rows, by, value)
    merged = _merged(stored if stored is not None else sketches(rows, by, value, k), by)
    e = error(k)

    def between(sketch: str, low: Column, high: Column) -> list[Column]:
        grid = F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(i / GRID) for i in range(GRID + 1))))
        at = lambda i: F.get(grid, i.cast("int"))
        lo = F.when(low > 0, at(F.floor(low * GRID))).otherwise(F.lit(float("-inf")))
        hi = F.when(high < 1, at(F.ceil(high * GRID))).otherwise(F.lit(float("inf")))
        return [lo.alias("lo"), hi.alias("hi")]

    wanted = merged.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    told = _told(sound, by, wanted.select(*by, "share", *between("sketch", F.col("share") - e, F.col("share") + e)), k)
    for _ in range(ROUNDS):
        if told.where(~F.col("covered") | _wide(held)).isEmpty():
            break
        low, high = (F.col("i") - F.col("below")) / F.col("inside") - e, (F.col("j") + 1 - F.col("below")) / F.col("inside") + e
        nearer = [F.when(~F.col("covered"), F.lit(x)).when(_wide(held), pick(F.col(n), c)).otherwise(F.col(n)).alias(n) for n, x, pick, c in zip(("lo", "hi"), (float("-inf"), float("inf")), (F.greatest, F.least), between("sketch", low, high), strict=True)]
        told = _told(sound, by, told.select(*by, "share", *nearer), k)
    return _settled(sound, by, told)


def _sound(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.select(*by, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))


def _merged(stored: DataFrame, by: list[str]) -> DataFrame:
    return stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def _wide(held: int) -> Column:
    return (F.col("inside") > held) & (F.col("lo") < F.col("hi"))


def _beside(rows: DataFrame, bounds: DataFrame, by: list[str], few: bool) -> DataFrame:
    named = bounds.select(*(F.col(c).alias(f"bound_{c}") for c in by), *(c for c in bounds.columns if c not in by))
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(named[f"bound_{c}"]) for c in by), F.lit(True))
    return rows.join(F.broadcast(named) if few else named, same).drop(*(f"bound_{c}" for c in by))


def _written(rows: DataFrame) -> DataFrame:
    path = f"{shared_dir(rows.sparkSession)}/bounds-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _told(rows: DataFrame, by: list[str], bounds: DataFrame, k: int) -> DataFrame:
    """Bounds with how many rows lie below and between them, whether they hold the wanted places, and a sketch of what is between."""
    bounds = _written(bounds)
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    counted = _beside(rows, bounds, by, bounds.count() <= BROADCAST_GROUPS).groupBy(*by, "share", "lo", "hi").agg(
        F.count("*").alias("total"), F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count_if(inside).alias("inside"), F.kll_sketch_agg_double(F.when(inside, F.col("value")), k).alias("sketch")
    )
    place = (F.col("total") - 1) * F.col("share")
    counted = counted.withColumns({"place": place, "i": F.floor(place), "j": F.ceil(place)})
    return _written(counted.withColumn("covered", (F.col("below") <= F.col("i")) & (F.col("j") < F.col("below") + F.col("inside"))))


def _settled(rows: DataFrame, by: list[str], told: DataFrame) -> DataFrame:
    """Counts of the values between the bounds, in order, up to the two places next to the percentile."""
    kept = told.select(*by, "share", "lo", "hi", "below", "place", "i", "j")
    near = _beside(rows, kept, by, kept.count() <= BROADCAST_GROUPS).where(F.col("value").between(F.col("lo"), F.col("hi")))
    counts = near.groupBy(*by, "share", "below", "place", "i", "j", "value").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*by, "share").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = lambda p: F.max(F.when((F.col("upto") - F.col("n") <= F.col(p)) & (F.col(p) < F.col("upto")), F.col("value")))
    ends = counts.withColumn("upto", upto).groupBy(*by, "share", "place", "i").agg(at("i").alias("a"), at("j").alias("b"))
    inner = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("i")))
    return ends.select(*by, "share", inner.alias("value"))
