"""Words with positions to rows of figures: clustering, fragments, columns, headers.

Greedy rules that look at what they have placed before have no plain expression; they run on one
page at a time, grouped, and a page is small.  What is a gap rule is a window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Points between rows, in headers, between fragments of a number, between columns.
ROW, HEADER, FRAGMENT, COLUMN = 3.0, 30.0, 8.0, 20.0


def rows_of_words(words: DataFrame, tolerance: float = ROW) -> DataFrame:
    """Words (doc, page, ord, text, x0, x1, top) with ``row``, in the order of ``ord``.

    A word joins the first row whose anchor, its first word, is within the tolerance, else it opens
    a new one.  The rule looks back over a page's rows only, so it is a fold over the page's words.
    """
    page = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", *(c for c in words.columns if c not in ("doc", "page", "ord"))))).alias("words"))
    step = f"""aggregate(words, named_struct('anchors', cast(array() as array<double>), 'rows', cast(array() as array<int>)), (s, w) ->
        named_struct('anchors', if(exists(s.anchors, a -> abs(a - w.top) <= {tolerance}), s.anchors, array_append(s.anchors, cast(w.top as double))),
            'rows', array_append(s.rows, if(exists(s.anchors, a -> abs(a - w.top) <= {tolerance}), cast(array_position(transform(s.anchors, a -> abs(a - w.top) <= {tolerance}), true) - 1 as int), size(s.anchors)))), s -> s.rows)"""
    placed = page.select("doc", "page", F.explode(F.arrays_zip("words", F.expr(step).alias("rows"))).alias("z"))
    return placed.select("doc", "page", "z.words.*", F.col("z.rows").alias("row"))


def fragments(words: DataFrame, gap: float = FRAGMENT) -> DataFrame:
    """Words with ``cluster``: within a row, a gap of more than ``gap`` starts another."""
    w = Window.partitionBy("doc", "page", "row").orderBy("x0", "ord")
    apart = F.when(F.col("x0") - F.lag("x1").over(w) > gap, 1).otherwise(0)
    return words.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("apart")


def column_tolerance(centres: Column) -> Column:
    """Slightly under half of the least gap between column centres; 25 points for a single column."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(centres) - 1), lambda i: F.get(centres, i) - F.get(centres, i - 1))
    return F.when(F.size(centres) < 2, F.lit(25.0)).otherwise(0.95 * F.array_min(gaps) / 2)


def assign(clusters: list[float], columns: list[float], tolerance: float) -> dict[int, int]:
    """One-to-one assignment of clusters to columns, nearest pairs first."""
    pairs = sorted((abs(x - c), i, j) for i, x in enumerate(clusters) for j, c in enumerate(columns))
    taken: set[int] = set()
    out: dict[int, int] = {}
    for distance, i, j in pairs:
        if distance <= tolerance and i not in out and j not in taken:
            out[i] = j
            taken.add(j)
    return out


def columns_of_clusters(clusters: DataFrame) -> DataFrame:
    """Rows (doc, page, row, centres, columns, tolerance) with ``placed``: for each cluster its column, or -1."""

    def one_batch(centres: pd.Series, columns: pd.Series, tolerance: pd.Series) -> pd.Series:
        out = []
        for x, c, t in zip(centres, columns, tolerance, strict=True):
            found = assign(list(x), list(c), float(t))
            out.append([found.get(i, -1) for i in range(len(x))])
        return pd.Series(out)

    return clusters.withColumn("placed", F.pandas_udf(one_batch, "array<int>")("centres", "columns", "tolerance"))


def spaced(xs: Column, gap: float = COLUMN) -> Column:
    """Positions of a header, each more than ``gap`` beyond the last that was kept."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(xs), empty, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > gap), F.concat(kept, F.array(x))).otherwise(kept))


def from_first_figure(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, ord, text) from the first that mentions revenue, income or a sale on."""
    w = Window.partitionBy("doc", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    started = F.max(F.rlike(F.lower("text"), F.lit("revenue|income|sale"))).over(w)
    return lines.withColumn("started", started).where("started").drop("started")


def last_values(values: Column, n: Column) -> Column:
    """The last n values of a row that is wider than its header."""
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def records(rows: DataFrame) -> DataFrame:
    """Rows (label, values, periods: array of fiscal_year and quarter) to one record a value; missing values give none."""
    kept = rows.withColumn("values", last_values(F.col("values"), F.size("periods")))
    out = kept.select("label", F.posexplode(F.arrays_zip("periods", "values")).alias("col", "z"))
    return out.select("label", "col", F.col("z.periods.fiscal_year").alias("fiscal_year"), F.col("z.periods.quarter").alias("quarter"), F.col("z.values").alias("value")).where("value is not null and fiscal_year is not null")
