"""Encoders of text for retrieval: dense vectors by hashing and sparse term weights.

A model can take their place: anything that adds an ``embedding`` column will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .retrieval import K1, B


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")


def dense(rows: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """Rows with ``embedding``: signed counts of hashed words, of unit length; an empty text has the zero vector.

    Digits of md5 name a word's component and sign, so any engine gives the same vector.  Each word
    becomes the one letter of its component, in the text of its sign; a component is then the
    difference of two counts of a letter, one look at two short texts for each component.  That is
    narrow, stays inside the JVM and takes time in the number of words.
    """
    letters = [chr((48 if dim <= 64 else 0x4E00) + i) for i in range(dim)]
    part = lambda h, start, n: F.conv(F.substring(h, start, n), 16, 10).cast("int")
    hashed = F.transform(words(F.col(text)), lambda t: F.md5(t.cast("binary")))
    said = F.transform(hashed, lambda h: F.struct(F.element_at(F.array(*map(F.lit, letters)), part(h, 1, 6) % dim + 1).alias("at"), (part(h, 7, 1) % 2 == 0).alias("plus")))
    spelled = lambda said, kept: F.array_join(F.transform(F.filter(said, kept), lambda x: x["at"]), "")
    both = _once(said, lambda s: F.struct(spelled(s, lambda x: x["plus"]).alias("plus"), spelled(s, lambda x: ~x["plus"]).alias("minus")))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    counts = _once(both, lambda b: F.array(*((count(b["plus"], x) - count(b["minus"], x)).cast("double") for x in letters)))
    length = _once(counts, lambda c: F.struct(c.alias("counts"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    unit = _once(length, lambda p: F.transform(p["counts"], lambda x: F.when(p["norm"] > 0, x / p["norm"]).otherwise(F.lit(0.0))))
    return rows.withColumn("embedding", unit)


def _once(value: Column, use) -> Column:
    """``use(value)`` where ``value`` is computed once however often it is used: the optimizer would write it out each time."""
    return F.transform(F.array(value), use)[0]


def sparse(rows: DataFrame, item: str = "chunk_id", mean_length: float = 256.0) -> DataFrame:
    """item, weights: map of term to its saturated frequency."""
    tokens = rows.select(item, words(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    counts = tokens.select(item, "n", F.explode("tokens").alias("term")).groupBy(item, "n", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean_length))
    return counts.groupBy(item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight"))))).alias("weights"))


def needs_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors that do not have the expected length: to be encoded again."""
    return vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim)
