"""Exact top-k search by inner product with M-trees, searched best first.

The inner product becomes a metric by one more coordinate: with ``M`` the largest norm,
``x -> (x, sqrt(M^2 - |x|^2))`` puts all rows on one sphere, and the nearest rows to ``(q, 0)`` are
those of the highest inner product.  A tree is paged: internal pages hold routing vectors with
covering radii, leaf pages hold rows, and every entry keeps its distance to the page's own routing
vector.  A query walks the pages in the order of their least possible distance; the triangle
inequality on the stored parent distances discards entries before any distance to them is computed.

The top page of the index is shared: its routing vectors are pivots fitted on a bounded sample
(``SAMPLE`` rows by a hash of the id), every row of the table lies in the cell of its nearest pivot,
and each cell has a covering radius.  A cell of more than ``cell_rows`` rows, such as one of many
equal vectors, is dealt by a hash of the id into parts of about as many.  A query first searches one
part of its own cell; the score of its k-th best there goes with it, and then only the parts
of cells whose covering radius allows a score as good are searched.  Each part is one group of
sorted rows: its vectors come first and make a tree, its queries stream past.  So vectors are
shuffled once for each of the two rounds, and a query once for each part that it cannot rule out.

Vectors without any cluster structure leave nothing to rule out, for this as for any exact metric
index; then every query meets every part.

Defined results: vectors that are null, empty or hold null or non-finite components take no part,
nor do rows without an id; only vectors of equal length are compared; rows that share an id are
never candidates for each other, and the score of a pair of ids is the highest among their rows;
fewer than k candidates give fewer results; ties go to the smaller id; columns of any other name
play no part; an empty table gives an empty result.  Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, map_batches

#: Rows of a leaf page and routing entries of an internal page.
PAGE = 64
#: Slack on distances for rounding; a step of one in the score moves a distance by far more.
SLACK = 1e-6
#: Rows that the pivots are fitted on, and pivots at most.
SAMPLE, PIVOTS = 8192, 4096


class Page:
    """``entries`` are row numbers (leaf) or pages; ``vectors``, ``radius`` and ``to_parent`` belong to the entries."""

    __slots__ = ("entries", "leaf", "radius", "to_parent", "vectors")

    def __init__(self, leaf: bool, entries: list, vectors: np.ndarray, radius: np.ndarray, to_parent: np.ndarray):
        self.leaf, self.entries, self.vectors, self.radius, self.to_parent = leaf, entries, vectors, radius, to_parent


class MTree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        norms = (rows * rows).sum(1)
        self.largest = float(norms.max())
        self.rows, self.ids = rows, ids
        self.points = np.concatenate([rows, np.sqrt(self.largest - norms)[:, None]], axis=1)
        self.computed = 0
        self.centre = self.points.mean(0)
        self.root = self._build(np.arange(len(rows)), self.centre)

    def _build(self, members: np.ndarray, centre: np.ndarray) -> Page:
        points = self.points[members]
        if len(members) <= PAGE:
            return Page(True, members, points, np.zeros(len(members)), np.linalg.norm(points - centre, axis=1))
        k = min(PAGE, -(-len(members) // (PAGE // 2)))
        routing = points[np.linspace(0, len(members) - 1, k).astype(int)]
        near = ((routing * routing).sum(1) - 2 * points @ routing.T).argmin(1)
        groups = [g for j in range(k) if len(g := np.flatnonzero(near == j))]
        if len(groups) == 1:  # equal vectors: any split will do
            groups = np.array_split(np.arange(len(members)), k)
        centres = np.stack([points[g].mean(0) for g in groups])
        radius = np.array([np.linalg.norm(points[g] - c, axis=1).max() for g, c in zip(groups, centres, strict=True)])
        pages = [self._build(members[g], c) for g, c in zip(groups, centres, strict=True)]
        return Page(False, pages, centres, radius, np.linalg.norm(centres - centre, axis=1))

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of ids other than ``own``, each with the best score of its rows; scores below ``floor`` may be left out."""
        q, order = np.append(query, 0.0), count()
        qq = float(query @ query)
        best: list[tuple[int, int]] = []  # of (score, -id), the worst first
        score_of: dict[int, int] = {}  # by id, of those in best
        reach = np.sqrt(max(0.0, qq + self.largest - 2 * floor)) if floor > -np.inf else np.inf
        if qq + self.largest < 2 * floor:
            return []
        self.computed += 1
        queue = [(0.0, next(order), self.root, float(np.linalg.norm(q - self.centre)))]
        while queue:
            least, _, page, to_page = heapq.heappop(queue)
            if least > reach + SLACK:
                break
            maybe = np.abs(to_page - page.to_parent) - page.radius <= reach + SLACK
            if page.leaf:
                some = page.entries[maybe]
                self.computed += len(some)
                scores = self.rows[some] @ query
                close = scores >= (max(floor, best[0][0]) if len(best) == k else floor)
                some, scores = some[close], scores[close]
                for s, i in zip(scores.tolist(), self.ids[some].tolist(), strict=True):
                    if i == own:
                        continue
                    s = int(s)
                    if i in score_of:  # another row of the id
                        if s > score_of[i]:
                            best[best.index((score_of[i], -i))] = (s, -i)
                            heapq.heapify(best)
                            score_of[i] = s
                    elif len(best) < k:
                        heapq.heappush(best, (s, -i))
                        score_of[i] = s
                    elif (s, -i) > best[0]:
                        del score_of[-heapq.heapreplace(best, (s, -i))[1]]
                        score_of[i] = s
                if len(best) == k:
                    reach = min(reach, np.sqrt(max(0.0, qq + self.largest - 2 * best[0][0])))
                continue
            at = np.flatnonzero(maybe)
            self.computed += len(at)
            to = np.linalg.norm(page.vectors[at] - q, axis=1)
            for i, d, low in zip(at.tolist(), to.tolist(), (to - page.radius[at]).tolist(), strict=True):
                if low <= reach + SLACK:
                    heapq.heappush(queue, (max(low, least), next(order), page.entries[i], d))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


class Pivots:
    """The shared top page for vectors of one length: pivots and, once known, the covering radii of their cells."""

    def __init__(self, sample: np.ndarray, wanted: int, largest: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.largest = largest
        points = np.unique(self.raised(sample), axis=0)
        wanted = max(1, min(wanted, len(points)))
        centres = points[rng.choice(len(points), wanted, replace=False)]
        for _ in range(4 if wanted > 1 else 0):
            near = self._nearest(points, centres)
            n = np.bincount(near, minlength=wanted)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        self.points = centres
        self.radius = np.full(wanted, np.inf)

    def raised(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([rows, np.sqrt(np.maximum(0.0, self.largest - (rows * rows).sum(1)))[:, None]], axis=1)

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its distance to the cell's pivot."""
        points = self.raised(rows)
        near = self._nearest(points, self.points)
        return near, np.linalg.norm(points - self.points[near], axis=1)

    def home(self, query: np.ndarray) -> int:
        """The nearest cell that has rows."""
        return int(np.where(self.radius >= 0, np.linalg.norm(self.points - np.append(query, 0.0), axis=1), np.inf).argmin())

    def open(self, query: np.ndarray, floor: float) -> np.ndarray:
        """Cells that may hold a row of a score of ``floor`` or more."""
        least = np.maximum(0.0, np.linalg.norm(self.points - np.append(query, 0.0), axis=1) - self.radius)
        return np.flatnonzero((query @ query + self.largest - least**2) / 2 >= floor - 0.5)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, vectors before queries: every query with the ids and scores of its k best in the part."""
    part, held, tree = None, [], None
    names = ["id", "w", "dim", "cell", "salt", "ids", "scores", "computed"]
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "cell", "salt")])
        asks = batch.column("q").to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0) | (asks[1:] != asks[:-1])) + 1
        for start, end in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
            if start == end:
                continue
            rows, key = batch.slice(start, end - start), tuple(keys[:, start].tolist())
            if key != part:
                part, held, tree = key, [], None
            vectors, ids = matrix(rows.column("w"), key[0]), rows.column("id").to_numpy()
            if not asks[start]:
                held.append((vectors, ids))
                continue
            if held:
                tree, held = MTree(np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held])), []
            found, computed = [], []
            for v, own, floor in zip(vectors, ids.tolist(), rows.column("floor").to_numpy().tolist(), strict=True):
                before = tree.computed if tree else 0
                found.append(tree.search(v, own, k, floor) if tree else [])
                computed.append((tree.computed if tree else 0) - before)
            made = [pa.array([[x[at] for x in f] for f in found], pa.list_(pa.int64())) for at in (1, 0)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names[:5]), *made, pa.array(computed, pa.int64())], names=names)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score: for every row that ``is_query`` holds for, its k best other rows."""
    found = searches(vectors, is_query, k, scale, id_col, vector_col, cell_rows)
    found = found.select(F.col("id").alias("query_id"), F.inline(F.arrays_zip("ids", "scores"))).groupBy("query_id", "ids").agg(F.max("scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ids"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("ids").alias(id_col), "score")


def searches(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int | None = None) -> DataFrame:
    """id, ids, scores, computed: each search of a query in a part of a cell, with the k best there and the distances that it took."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), whole.alias("w"), F.coalesce(is_query, F.lit(False)).alias("q"))
    norm = F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)
    n, largest = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    cell = cell_rows or min(65_536, max(1_024, int(8 * n**0.5)))
    pivots = _pivots(rows, max(1, -(-2 * n // cell)), largest)

    def placed():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size = np.array([len(x) for x in batch.column("w")], np.int32)
            at, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for dim in set(size.tolist()) & pivots.keys():
                some = np.flatnonzero(size == dim)
                at[some], far[some] = pivots[dim].place(matrix(batch.column("w").take(pa.array(some)), dim))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "w", "q")), *map(pa.array, (size, at, far))], names=["id", "w", "q", "dim", "cell", "far"])

        return step

    rows = cut(map_batches(rows, placed, "id bigint, w array<double>, q boolean, dim int, cell int, far double"), "cells")
    # lengths that the sample lacks are rare: each is one cell without a pivot
    known = rows.where("cell >= 0").groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    for p in pivots.values():
        p.radius[:] = -np.inf  # cells without rows
    for r in known:
        pivots[r["dim"]].radius[r["cell"]] = r["radius"]
    parts = [(r["dim"], r["cell"], -(-r["n"] // cell)) for r in known if r["n"] > cell]
    few = F.broadcast(rows.sparkSession.createDataFrame(parts, "dim int, cell int, parts bigint"))

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(few, ["dim", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    nth = F.pmod(F.xxhash64("id"), F.col("parts"))
    no_floor = F.lit(float("-inf")).alias("floor")
    data = with_parts(rows).select("id", "w", "dim", "cell", nth.alias("salt"), F.lit(False).alias("q"), no_floor)

    def homes():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size = batch.column("dim").to_pylist()
            home = [pivots[d].home(np.array(w.as_py())) if d in pivots else -1 for d, w in zip(size, batch.column("w"), strict=True)]
            return batch.set_column(batch.schema.get_field_index("cell"), "cell", pa.array(home, pa.int32()))

        return step

    def search(asked: DataFrame, name: str) -> DataFrame:
        sorted_ = data.unionByName(asked).repartition("dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt", "q")
        return cut(sorted_.mapInArrow(lambda b: _searched(b, k), "id bigint, w array<double>, dim int, cell int, salt bigint, ids array<bigint>, scores array<bigint>, computed bigint"), name)

    asked = map_batches(rows.where("q").select("id", "w", "dim", "cell"), homes, "id bigint, w array<double>, dim int, cell int")
    asked = with_parts(asked).select("id", "w", "dim", "cell", nth.alias("salt"), F.lit(True).alias("q"), no_floor)
    first = search(asked, "home-search")

    def doors():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, floors = [], []
            for w, dim, scores in zip(batch.column("w"), batch.column("dim").to_pylist(), batch.column("scores").to_pylist(), strict=True):
                floors.append(float(scores[k - 1]) if len(scores) == k else -np.inf)
                out.append(pivots[dim].open(np.array(w.as_py()), floors[-1]).tolist() if dim in pivots else [])
            made = [pa.array(out, pa.list_(pa.int32())), pa.array(floors, pa.float64())]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "w", "dim", "cell", "salt")), *made], names=["id", "w", "dim", "home", "home_salt", "cells", "floor"])

        return step

    more = map_batches(first.select("id", "w", "dim", "cell", "salt", "scores"), doors, "id bigint, w array<double>, dim int, home int, home_salt bigint, cells array<int>, floor double")
    more = with_parts(more.withColumn("cell", F.explode("cells"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    more = more.where(~((F.col("cell") == F.col("home")) & (F.col("salt") == F.col("home_salt"))))
    second = search(more.select("id", "w", "dim", "cell", "salt", F.lit(True).alias("q"), "floor"), "search")

    columns = ["id", "ids", "scores", "computed"]
    return first.select(columns).unionByName(second.select(columns))


def _pivots(rows: DataFrame, wanted: int, largest: float) -> dict[int, Pivots]:
    """By length of vector, from at most ``SAMPLE`` rows: the only rows that reach the driver."""
    by: dict[int, list] = {}
    for r in rows.select("w").orderBy(F.xxhash64("id"), "id", "w").limit(SAMPLE).collect():
        by.setdefault(len(r["w"]), []).append(r["w"])
    total = sum(map(len, by.values()))
    return {dim: Pivots(np.array(some), min(PIVOTS, -(-wanted * len(some) // total)), largest) for dim, some in by.items()}
