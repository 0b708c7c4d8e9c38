import numpy as np
import pytest

from ledgerloom.operators import quantized, retrieval

SCHEMA = "chunk_id {}, embedding array<double>"


def both(spark, rows, asked, k, tmp_path, kind="bigint"):
    """Results of the codes, read from a stored table, beside those of plain scores."""
    vectors = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)
    asked = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    path = str(tmp_path / "codes")
    quantized.encode(vectors).write.parquet(path)
    ours = quantized.search(asked, spark.read.parquet(path), k)
    theirs = retrieval.dense(asked, vectors, k)
    out = [sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in x.collect()) for x in (ours, theirs)]
    return *out, spark.read.parquet(path), asked


def test_like_plain_scores(spark, tmp_path):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(8, 24))
    rows = [(i, (centres[i % 8] + 0.2 * draw.normal(size=24)).tolist()) for i in range(3000)]
    asked = [(i, (centres[i % 8] * draw.choice([1e-3, 1, 1e5]) + 0.1 * draw.normal(size=24)).tolist()) for i in range(20)]
    ours, theirs, coded, asked = both(spark, rows, asked, 7, tmp_path)
    assert ours == theirs
    # What the codes leave open is a small share of all pairs.
    assert quantized.candidates(asked, coded, 7).count() < 0.02 * 20 * 3000


def test_one_vector_in_most_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantized, "SEED", 50)
    monkeypatch.setattr(quantized, "PAIRS", 64)
    draw = np.random.default_rng(6)
    rows = [(i, [1.0, 0.5, -0.25] if i % 3 else draw.normal(size=3).round(1).tolist()) for i in range(3000)]
    ours, theirs, coded, asked = both(spark, rows, [(1, [1.0, 0.4, 0.0]), (2, [-1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])], 5, tmp_path)
    assert ours == theirs
    assert quantized.candidates(asked, coded, 5).count() < 1500


def test_sizes_of_numbers(spark, tmp_path):
    rows = [(1, [1e-310, 0.0]), (2, [0.0, 0.0]), (3, [1e150, -1e150]), (4, [1e-200, 2e-200]), (5, [1.0, 1.0]), (6, [3.0, -2.0])]
    ours, theirs, *_ = both(spark, rows, [(1, [1.0, 0.5]), (2, [1e100, 1e99])], 6, tmp_path)
    assert ours == theirs


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0, 2.0]), ("d", None), ("e", []), ("f", [nan, 1.0]), ("g", [inf, 1.0]), ("h", [None, 1.0]), (None, [9.0, 9.0]), ("a", [1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, j, "x") for j, (i, v) in enumerate(rows)], "chunk_id string, embedding array<double>, `a.b` int, code string")
    coded = quantized.encode(vectors)
    assert {r["chunk_id"] for r in coded.collect()} == {"a", "b", "c"} and coded.columns.count("code") == 1 and "a.b" in coded.columns
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, None), (4, [nan, 1.0]), (None, [1.0, 1.0]), (5, [])], "query_id int, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in quantized.search(asked, coded, 3).collect())
    assert found == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (2, 1, "c", 3.0)]
    assert quantized.search(asked.where("false"), coded, 3).count() == 0
    assert quantized.search(asked, coded.where("false"), 3).count() == 0


def test_the_scan_reads_codes_alone(spark, tmp_path):
    path = str(tmp_path / "codes")
    quantized.encode(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA.format("bigint"))).write.parquet(path)
    plan = quantized.candidates(spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<double>"), spark.read.parquet(path), 1)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1].split(">")[0] and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_of_questions(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(quantized, "ASKED", 12 // blocks)
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(200)]
    ours, theirs, *_ = both(spark, rows, [(i, draw.normal(size=6).tolist()) for i in range(12)], 4, tmp_path)
    assert ours == theirs


def test_a_worker_s_bounds_take_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from ledgerloom.operators import quantized

    rng = np.random.default_rng(7)
    codes = rng.integers(-127, 128, (9000, 8)).astype(np.int8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array(list(codes), pa.list_(pa.int8())), pa.array([0.01] * 9000), pa.array([0.001] * 9000), pa.array([str(i) for i in range(9000)])], list(quantized.CODED))
    run = quantized._bounds(rng.normal(size=(4096, 8)).tolist(), 5, None, True)
    tracemalloc.start()
    (limits,) = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert limits.num_rows == 4096 and peak < 40 << 20
