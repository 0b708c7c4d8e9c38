"""Running totals over one order of all rows, by range-sorted parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut


def running(df: DataFrame, order: list[str], totals: dict[str, Column | str], name: str) -> DataFrame:
    """``df`` with the totals of all rows before each row in ``order``: one more column for each of ``totals``.

    Rows are dealt by ranges of ``order`` and written once, so that both readings see the same parts.
    A total for each part (as many rows as parts) gives the parts' offsets, a window within each part
    the rest, so no task takes more than one part.  Rows alike in ``order`` share a part: let it end
    with a column that tells rows apart.  Nulls come first; an empty ``df`` gives none.
    """
    of = {n: F.col(c) if isinstance(c, str) else c for n, c in totals.items()}
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__part").agg(*(F.sum(c).alias(n) for n, c in of.items()))
    offsets = sums.select("__part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in of))
    rows = parts.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in of.items()))
    rows = rows.join(F.broadcast(offsets), "__part")
    return rows.select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in of))
