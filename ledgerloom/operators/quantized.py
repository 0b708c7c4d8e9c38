"""Dense top-k from 8-bit codes: bounds rule vectors out, only what they leave open is scored in full.

``encode`` gives every vector a code of one signed byte a component, and how far the code is from
the vector.  By the inequality of Cauchy and Schwarz a score differs from that of the code by at
most this distance times the question's norm.  ``search`` reads codes alone, keeps for every
question what may still be among its k best, and reads the vectors of these for exact scores, so a
stored table costs a byte a component in the scan and eight only for few rows.

Odd rows: a null id, and a vector that is null, empty or holds a null or non-finite component, take
no part, as rows or as questions.  Rows that repeat an id count once, with the vector of the least
digest.  Questions meet vectors of their own length only.  Equal scores rank by the smaller id.
Products that leave the range of doubles have no defined order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .retrieval import ASKED, TOP_RETRIEVED, dot, ranked

#: Rows that give first limits; pairs that a worker bounds at once; bytes of questions that a worker holds; tasks that thin a question's proposals.
SEED, PAIRS, HELD, PARTS = 8192, 1 << 18, 1 << 25, 16
#: Vectors of smaller components have codes of zeros, so that no code's unit is lost below the least number.
TINY = 1e-300
CODED = ("chunk_id", "code", "scale", "error", "digest")


def _sound(vector: Column) -> Column:
    off = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, off)


def encode(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors`` (chunk_id, embedding, any other columns), one an id, with code, scale, error, digest.

    Other columns must have an order (it chooses among repeats of a row); those named like the new ones are replaced.
    """
    other = [c for c in vectors.columns if c not in ("embedding", *CODED)]
    rows = vectors.where(F.col("chunk_id").isNotNull() & _sound(F.col("embedding")))
    held = F.struct(F.sha2(F.col("embedding").cast("string"), 256).alias("digest"), "embedding", *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(other)))
    one = rows.groupBy("chunk_id").agg(F.min(held).alias("r")).select("chunk_id", "r.*")
    wide = F.col("embedding").cast("array<double>")
    one = one.withColumn("top", F.aggregate(wide, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))
    one = one.withColumn("scale", F.when(F.col("top") > TINY, F.col("top") / 127).otherwise(F.lit(1.0)))
    one = one.withColumn("code", F.transform(wide, lambda x: F.round(x / F.col("scale")).cast("tinyint")))
    off = F.zip_with(wide, F.col("code"), lambda x, c: x / F.col("scale") - c.cast("double"))
    far = F.col("scale") * F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x))
    one = one.withColumn("error", F.when(F.col("top") > TINY, far).otherwise(F.col("top") * F.size("code")))
    return one.select("chunk_id", "embedding", "code", "scale", "error", "digest", *(F.col(f"__{i}").alias(c) for i, c in enumerate(other)))


class _Questions:
    """A block of questions of one length: unit vectors and the k highest lower bounds of each so far."""

    def __init__(self, places: list[int], vectors: list, k: int):
        whole = np.array(vectors, dtype=np.float64)
        top = np.abs(whole).max(axis=1, keepdims=True)
        whole = np.divide(whole, top, out=np.zeros_like(whole), where=top > 0)
        norm = np.linalg.norm(whole, axis=1, keepdims=True)
        self.places, self.k = np.array(places), k
        self.unit = np.divide(whole, norm, out=whole, where=norm > 0).astype(np.float32).T.copy()
        self.zero = norm[:, 0] == 0
        self.best = np.full((k, len(places)), -np.inf)

    def open(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows and questions that may belong together, with their lower and upper bounds, after taking these rows in."""
        codes = codes.astype(np.float32)
        middle = (codes @ self.unit).astype(np.float64) * scale[:, None]
        # What 32-bit products and the exact scores' own sums may be off, by the code's length.
        around = np.linalg.norm(codes, axis=1) * scale
        slack = (error * (1 + 1e-6) + (around + error) * (len(self.unit) + 8) * 2.0**-22)[:, None]
        with np.errstate(invalid="ignore", over="ignore"):
            lower, upper = middle - slack, middle + slack
        lower[~np.isfinite(lower)], upper[~np.isfinite(upper)] = -np.inf, np.inf
        lower[:, self.zero] = upper[:, self.zero] = 0
        both = np.vstack([self.best, lower])
        self.best = np.partition(both, len(both) - self.k, axis=0)[len(both) - self.k :]
        row, q = np.nonzero((upper >= self.best.min(axis=0)[None]) & ~self.zero[None])
        return row, q, lower[row, q], upper[row, q]


def _firsts(digest: np.ndarray, ids: list, k: int) -> np.ndarray:
    """The rows with the k smallest ids of each digest: equal vectors score alike, so no other of them can be among the k best."""
    if len(np.unique(digest)) == len(digest):
        return np.arange(len(digest))
    seen: dict = {}
    keep = []
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        seen[digest[i]] = n = seen.get(digest[i], 0) + 1
        if n <= k:
            keep.append(i)
    return np.array(keep)


def _bounds(asked: list, k: int, start: list | None, only_limits: bool):
    """A worker's pass over codes: proposals of each batch, or at the end the limits alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list[int]] = {}
        for i, vector in enumerate(asked):
            by_length.setdefault(len(vector), []).append(i)
        blocks = {n: _Questions(places, [asked[i] for i in places], k) for n, places in by_length.items()}
        if start is not None:
            for b in blocks.values():
                b.best[:] = np.array(start)[b.places][None]
        for batch in batches:
            ids = batch.column("chunk_id")
            lengths = batch.column("code").value_lengths().to_numpy(zero_copy_only=False)
            digest = np.array(batch.column("digest").to_pylist())
            scale, error = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("scale", "error"))
            keep = _firsts(digest, ids.to_pylist(), k)
            for n, block in blocks.items():
                rows = np.sort(keep[lengths[keep] == n])
                if not len(rows):
                    continue
                codes = batch.column("code").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
                step = max(1, PAIRS // len(block.places))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    row, q, lower, upper = block.open(codes[at : at + step], scale[some], error[some])
                    if not only_limits and len(row):
                        yield _proposed(batch, block.places[q], some[row], lower, upper)
                if block.zero.any() and not only_limits:
                    least = rows[sorted(range(len(rows)), key=[ids[int(r)].as_py() for r in rows].__getitem__)[:k]]
                    for place in block.places[block.zero]:
                        none = np.zeros(len(least))
                        yield _proposed(batch, np.full(len(least), place), np.array(least), none, none)
        if only_limits:
            for b in blocks.values():
                yield pa.RecordBatch.from_arrays([pa.array(b.places.astype(np.int32)), pa.array(b.best.min(axis=0))], ["place", "lower"])

    return run


def _proposed(batch: pa.RecordBatch, place: np.ndarray, rows: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> pa.RecordBatch:
    ids, digest = (batch.column(c).take(pa.array(rows)) for c in ("chunk_id", "digest"))
    return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), ids, digest, pa.array(lower), pa.array(upper)], ["place", "chunk_id", "digest", "lower", "upper"])


def _blocks(asked: DataFrame) -> Iterator[list]:
    """The sound questions as lists of (query_id, vector), about ``ASKED`` and ``HELD`` bytes at most."""
    rows = asked.where(F.col("query_id").isNotNull() & _sound(F.col("embedding"))).groupBy("query_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("asked"))
    n, length = rows.agg(F.count("*"), F.max(F.size("asked"))).first()
    if n:
        parts = max(1, -(-n // ASKED), -(-n * length * 8 // HELD))
        for i in range(parts):
            yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect()]


def _settled(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The proposals that the k-th highest lower bound of their group does not rule out."""
    same = Window.partitionBy(*by)
    at = found.withColumn("rank", F.row_number().over(same.orderBy(F.desc("lower"), "chunk_id")))
    limit = F.max(F.when(F.col("rank") == k, F.col("lower"))).over(same)
    return at.withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("upper") >= F.col("limit")))


def candidates(asked: DataFrame, coded: DataFrame, k: int = TOP_RETRIEVED) -> DataFrame:
    """query_id, asked, chunk_id of the pairs that the codes leave open.

    Each block of questions passes over the codes once.  The limits that workers start from are the
    k-th highest lower bounds among ``SEED`` rows; any rows give right limits, so results do not
    depend on which.  A question's proposals are some k of each partition of the codes, more where
    one vector fills many rows; ``PARTS`` tasks a question thin them before one takes the rest.
    """
    spark, codes = coded.sparkSession, coded.select(*CODED)
    kind = StructType([asked.schema["query_id"], StructField("asked", ArrayType(DoubleType()))])
    out = []
    for block in _blocks(asked):
        vectors = [v for _, v in block]
        first = codes.limit(SEED).mapInArrow(_bounds(vectors, k, None, True), "place int, lower double")
        limits = dict(first.groupBy("place").agg(F.max("lower")).collect())
        start = [limits.get(i, -np.inf) for i in range(len(block))]
        found = codes.mapInArrow(_bounds(vectors, k, start, False), StructType([StructField("place", IntegerType()), coded.schema["chunk_id"], coded.schema["digest"], StructField("lower", DoubleType()), StructField("upper", DoubleType())]))
        found = found.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)))
        copy = F.row_number().over(Window.partitionBy("place", "part", "digest").orderBy("chunk_id"))
        left = _settled(_settled(found.withColumn("copy", copy).where(F.col("copy") <= k), k, "place", "part"), k, "place")
        named = spark.createDataFrame([(i, *q) for i, q in enumerate(block)], StructType([StructField("place", IntegerType()), *kind]))
        out.append(left.join(F.broadcast(named), "place").select("query_id", "asked", "chunk_id"))
    empty = spark.createDataFrame([], StructType([*kind, coded.schema["chunk_id"]]))
    return reduce(DataFrame.unionByName, out) if out else empty


def search(asked: DataFrame, coded: DataFrame, k: int = TOP_RETRIEVED) -> DataFrame:
    """query_id, chunk_id, score, rank by inner product, exactly; ``coded`` is a stored (filtered) result of ``encode``."""
    pairs = candidates(asked, coded, k).join(coded.select("chunk_id", "embedding"), "chunk_id")
    return ranked(pairs.select("query_id", "chunk_id", dot(F.col("embedding"), F.col("asked")).alias("score")), k)

