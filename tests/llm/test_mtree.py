import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mtree


def brute(ids, rows, wanted, k=5):
    out = []
    for q in wanted:
        s = rows @ rows[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 7 == 0, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("shape", ["spread", "equal", "clusters"])
def test_like_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    v = {"spread": rng.normal(size=(300, 8)), "equal": np.ones((300, 8)), "clusters": np.repeat(rng.normal(size=(6, 8)), 50, 0) + 0.01 * rng.normal(size=(300, 8))}[shape].astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    whole = np.floor(256 * v.astype(float)).astype(int)
    want = brute(np.arange(300), whole, [i for i in range(300) if i % 7 == 0])
    assert found(df) == want
    assert found(df, cell_rows=40) == want


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * (np.repeat(np.eye(8), 400, 0) + 0.01 * rng.normal(size=(3200, 8))))
    tree = mtree.MTree(rows, np.arange(3200))
    tree.search(rows[0], 0, 5)
    assert tree.computed < 1600


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (7, None), (14, [float("nan"), 1.0]), (21, [1.0, None]), (None, [1.0, 1.0]), (3, [2.0, 0.0]), (3, [5.0, 0.0]), (28, [1.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df) == [(0, 1, 3, 256 * 1280)]
    assert found(df.limit(0)) == []


def test_copies_of_an_id_leave_room_for_others(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0])] + [(1, [9.0 - 0.001 * i, 0.0]) for i in range(40)] + [(2 + i % 20, [float(x), 0.0]) for i, x in enumerate(rng.uniform(1, 8, 300))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, 0), 256 * int(np.floor(256 * np.float32(v[0]))))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    got = [x for x in found(df) if x[0] == 0]
    assert got == [(0, n + 1, i, s) for n, (i, s) in enumerate(want)] == [x for x in found(df, cell_rows=30) if x[0] == 0]


def distances(spark, rows, cell_rows=None):
    """Distances that all searches of a query took, as a share of its candidates."""
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = mtree.searches(df, F.col("vec_id") % 50 == 0, cell_rows=cell_rows).groupBy("id").agg(F.sum("computed").alias("n")).collect()
    return np.mean([r["n"] for r in got]) / len(rows)


def test_whole_cells_fall_out_of_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    rows = np.repeat(rng.normal(size=(40, 16)), 100, 0) + 0.02 * rng.normal(size=(4000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    share = distances(spark, rows, cell_rows=400)
    assert share < 0.15, share


def test_no_structure_costs_little_more_than_comparing_all(spark):
    pq = pytest.importorskip("pyarrow.parquet")
    rows = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist())
    share = distances(spark, rows)
    assert share < 1.1, share  # 2 000 unit vectors in all directions: no bound can hold


@pytest.mark.parametrize("cell_rows", [None, 60])
def test_repeated_rows_and_lengths_beside_clashing_columns(spark, cell_rows):
    rng = np.random.default_rng(9)
    rows = [(i % 150, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))] + [(1000 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 3)))] + [(7, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "w", "q", "cell", "dim", "salt", "score", "rank")})
    best = {}
    for i, a in rows:
        for j, b in rows:
            if i % 7 == 0 and i != j and len(a) == len(b):
                s = int(np.floor(256 * np.array(a)) @ np.floor(256 * np.array(b)))
                best.setdefault(i, {})[j] = max(s, best.get(i, {}).get(j, s))
    want = sorted((i, n + 1, j, s) for i, of in best.items() for n, (j, s) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0]))[:5]))
    assert found(df, cell_rows=cell_rows) == want
