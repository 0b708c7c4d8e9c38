"""Clustering of vectors around centroids, in whole numbers and exact.

Vectors are whole numbers (256 times each component, rounded down).  The nearest centroid is found in
two steps.  A product of matrices in 32-bit floats gives every inner product, and with it a squared
distance, quickly but not exactly.  How far it may be off is bounded: an inner product of d numbers
in any order of summation errs by less than (d + 2)u / (1 - (d + 2)u) times the product of the
lengths (u = 2**-24; two more for rounding the numbers themselves).  Every centroid therefore has an
interval; those whose interval begins above the least end of all can't be nearest.  If one is left, it
is the nearest.  If several are, their distances are computed in whole numbers and ties go to the
smallest number.

A round is one pass over the written vectors: tasks add up their vectors by centroid, and as many
rows as centroids reach the driver, never a vector.

Defined results: vectors that are null, hold a null or non-finite component or have another number of
components take no part.  Components beyond 2**40 after scaling count as 2**40; distances and sums of
distances beyond a long are the largest long.  Fewer vectors than centroids asked for give as many
centroids; none give no rows.  Repeated ids are vectors of their own; a null id hashes as empty text.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, map_batches

COMPONENTS, CENTROIDS, ROUNDS, SALT = 64, 40, 5, "2:"
SCALE, MOST, LONGEST = 256, 1 << 40, (1 << 63) - 1
#: Components below this may be squared and added in 64-bit integers.
NARROW = 1 << 27


def scaled(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, v (array of bigint) of the vectors that take part."""
    x = F.col("embedding")
    sound = (F.size(x) == components) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("bigint")
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(x, whole).alias("v"))


def first_centroids(rows: DataFrame, centroids: int = CENTROIDS, salt: str = SALT) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, in the order of the hashes; of one id, by components."""
    mark = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in rows.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(centroids).collect()]


class Nearest:
    """Nearest centroid and exact squared distance of a block of vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.whole = np.array(centroids, dtype=np.int64)
        self.single = self.whole.astype(np.float32).T.copy()
        double = self.whole.astype(np.float64)
        self.squares = (double * double).sum(1)
        self.narrow = int(np.abs(self.whole).max(initial=0)) < NARROW
        terms = self.whole.shape[1] + 2
        unit = 2.0**-24
        # Twice the bound of one inner product, and room for what 64-bit floats round in squares, lengths and differences.
        self.slack = 2 * terms * unit / (1 - terms * unit) * (1 + 1e-9)
        self.rest = 4 * terms * 2.0**-53

    def distances(self, v: np.ndarray, c: np.ndarray) -> list[int] | np.ndarray:
        """Exact squared distances of rows of ``v`` to rows of ``c``."""
        if self.narrow and (not v.size or int(np.abs(v).max()) < NARROW):
            apart = v - c
            return (apart * apart).sum(1)
        return [sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(v.tolist(), c.tolist())]

    def screen(self, v: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest: a boolean row for each vector, never without the nearest one."""
        single, double = v.astype(np.float32), v.astype(np.float64)
        length = np.sqrt((double * double).sum(1))[:, None]
        reach = np.sqrt(self.squares)[None, :]
        about = self.squares[None, :] - 2.0 * (single @ self.single).astype(np.float64)
        error = self.slack * length * reach + self.rest * (self.squares[None, :] + 2.0 * length * reach)
        return about - error <= (about + error).min(1, keepdims=True)

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray, int]:
        """Numbers of the nearest centroids, exact distances, and how many vectors needed whole numbers to decide."""
        near = self.screen(v)
        chosen = near.argmax(1)
        open_rows = np.flatnonzero(near.sum(1) > 1)
        if open_rows.size:
            which, number = np.nonzero(near[open_rows])
            apart = self.distances(v[open_rows[which]], self.whole[number])
            best: dict[int, tuple[int, int]] = {}
            for row, found in zip(which.tolist(), zip(map(int, apart), number.tolist())):
                if row not in best or found < best[row]:
                    best[row] = found
            chosen[open_rows] = [best[i][1] for i in range(open_rows.size)]
        return chosen, self.distances(v, self.whole[chosen]), int(open_rows.size)


def _matrix(batch: pa.RecordBatch, components: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


class _Sums:
    """Adds up a task's vectors by centroid; its rows come last."""

    def __init__(self, centroids: list[list[int]], schema: pa.Schema):
        self.nearest, self.schema = Nearest(centroids), schema
        self.count, self.sums = [0] * len(centroids), [[0] * len(centroids[0]) for _ in centroids]
        self.open = 0

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch, len(self.sums[0]))
        if len(v):
            chosen, _, undecided = self.nearest(v)
            self.open += undecided
            for number in np.unique(chosen).tolist():
                mine = v[chosen == number]
                self.count[number] += len(mine)
                self.sums[number] = [a + b for a, b in zip(self.sums[number], mine.sum(0).tolist())]
        return pa.RecordBatch.from_pylist([], self.schema)

    def finish(self) -> pa.RecordBatch:
        rows = [{"cluster": i, "n": n, "sums": [str(x) for x in self.sums[i]], "open": self.open if i == 0 else 0} for i, n in enumerate(self.count) if n or i == 0]
        return pa.RecordBatch.from_pylist(rows, self.schema)


def step(rows: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], int]:
    """Centroids after one round, and how many vectors intervals alone did not decide."""
    schema = "cluster int, n bigint, sums array<string>, open bigint"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    parts = map_batches(rows.select("v"), lambda: _Sums(centroids, arrow), schema)
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(len(centroids[0]))]
    out, undecided = [list(c) for c in centroids], 0
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("open").alias("open"), *whole).collect():
        undecided += row["open"]
        if row["n"]:
            out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(len(centroids[0]))]
    return out, undecided


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance."""
    kind = dict(rows.dtypes)["vec_id"]

    def make():
        nearest = Nearest(centroids)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = _matrix(batch, len(centroids[0]))
            chosen, apart, _ = nearest(v) if len(v) else ([], [], 0)
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            return pa.RecordBatch.from_arrays([ids, pa.array(chosen, pa.int32()), pa.array([min(int(d), LONGEST) for d in apart], pa.int64())], ["vec_id", "cluster", "distance"])

        return one

    return map_batches(rows, make, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, components: int = COMPONENTS, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = cut(scaled(vectors, components), "cluster-vectors")
    now = first_centroids(rows, centroids, salt)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not now:
        kind = dict(rows.dtypes)["vec_id"]
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        now, _ = step(rows, now)
    assigned = cut(assign(rows, now), "cluster-assigned")
    told = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(now)]
    named = rows.sparkSession.createDataFrame(told, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = sums.join(F.broadcast(named), "cluster").select("cluster", "s", "centroid_sha256")
    whole = sums.agg(F.sum("s").alias("total"))
    capped = lambda c: F.least(F.col(c), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint")
    beside = sums.crossJoin(F.broadcast(whole)).select("cluster", capped("s").alias("cluster_inertia"), capped("total").alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(beside), "cluster").select(columns)
