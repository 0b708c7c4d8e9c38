"""Clusters against plain whole-number rounds, and what float intervals must never lose."""

import hashlib
import math

import numpy as np
import pytest

from ledgerloom.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, v string, cluster int"


def plain(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    mark = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    now = [v for _, v in sorted(kept, key=mark)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(now))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(now)]
    found = [(i, *near(v)) for i, v in kept]
    inertia: dict = {}
    for _, d, c in found:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def told(spark, rows, **options):
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)
    return sorted(map(tuple, centroids.cluster(df, **options).collect()), key=str)


def vectors(n, size, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in (scale * rng.standard_normal(size)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 0.004, 1000.0, 1e5])
def test_equals_whole_numbers(spark, scale):
    rows = vectors(300, 8, 1, scale)
    odd = [(None, rows[0][1]), (1, rows[1][1]), (2, rows[5][1]), (900, None), (901, [1.0]), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (904, [None] + [0.0] * 7), (905, [])]
    assert told(spark, rows + odd, components=8, centroids=7, rounds=3) == plain(rows + odd, 7, 3, 8)


def test_ties_go_to_the_smallest_number(spark):
    rows = [(i, [float(i % 4) / 256, 0.0]) for i in range(64)]
    assert told(spark, rows, components=2, centroids=12, rounds=4) == plain(rows, 12, 4, 2)


def test_few_and_none(spark):
    rows = vectors(3, 64, 2)
    found = told(spark, rows)
    assert found == plain(rows, 40, 5, 64) and all(r[2] == 0 for r in found)
    assert told(spark, []) == [] == told(spark, [(1, None)])


def test_intervals_hold_the_nearest():
    """Far from the origin floats can't tell centroids apart: every one that may be nearest stays, and whole numbers decide."""
    rng = np.random.default_rng(3)
    for base in (0, 1 << 20, 1 << 26, 1 << 30, 1 << 39):
        whole = (base + rng.integers(-50, 50, (9, 64))).tolist()
        nearest = centroids.Nearest(whole)
        v = base + rng.integers(-60, 60, (200, 64))
        chosen, apart, undecided = nearest(v)
        for row, number, distance in zip(v.tolist(), chosen.tolist(), apart):
            best = min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(whole))
            assert best == (int(distance), number)
        assert undecided == (200 if base > 1 << 20 else undecided)


def test_screening_decides_most():
    rng = np.random.default_rng(4)
    nearest = centroids.Nearest(rng.integers(-256, 256, (40, 64)).tolist())
    _, _, undecided = nearest(rng.integers(-256, 256, (5000, 64)))
    assert undecided < 50


def test_huge_components_do_not_overflow(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 0.0]), (2, [1.0, 2.0]), (3, [1.0, 2.5])]
    found = told(spark, rows, components=2, centroids=2, rounds=2)
    assert len(found) == 4 and all(0 <= r[2] <= centroids.LONGEST for r in found)


def test_every_row_of_a_hot_vector(spark):
    rows = vectors(60, 64, 5) + [(1000 + i, [0.5] * 64) for i in range(60)]
    assert told(spark, rows) == plain(rows, 40, 5, 64)
