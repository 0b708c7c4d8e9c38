"""The curriculum mix: targets, positions, odd rows, both ways of meeting the targets."""

import hashlib
import re

import pytest

from ledgerloom.llm import mixing, ranges

DOCS = "doc_id bigint, text string, source string, target string, row int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare by weight until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weight.items() if s not in done}
        left = total - sum(done.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > most * sizes[s]]
        if not over:
            return done | {s: left * w / sum(free.values()) for s, w in free.items()}
        done |= {s: float(most * sizes[s]) for s in over}


def some(n=400):
    word = lambda i: int(hashlib.sha256(str(i).encode()).hexdigest()[:6], 16)
    out = [(i, "w " * (word(i) % 50), None if word(i) % 7 == 0 else f"s{min(word(-i) % 30, 9)}") for i in range(1, n)]
    return [*out, (None, "a b c", "s1"), (None, None, "s1"), (7, "again and again", "s2"), (7, "again and again", "s2"), (8, "", ""), (9, " \t\n", "é"), (10, "long " * 50_000, "z"), (11, "é x y", "😀")]


def test_against_plain_rules(spark):
    rows = some()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    wanted = plain_targets(sizes)
    found = mixing.placed(rows_of(spark, rows)).collect()
    assert {r["source_size"] for r in found} == set(sizes.values())
    told = mixing.mixed(rows_of(spark, rows)).collect()
    assert len(told) == len(rows) and sorted(r["size"] for r in told) == sorted(size(t) for _, t, _ in rows)
    by_id = {(d, t): s for d, t, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in told:
        source = next((s for (d, t), s in by_id.items() if d == r["doc_id"] and size(t) == r["size"] and sizes[s] == r["source_size"]))
        assert r["target"] == pytest.approx(wanted[source]) and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-6 for s in sizes)
    assert {r["source_size"] for r in told} == set(sizes.values())


def test_order_follows_the_schedules(spark):
    rows = rows_of(spark, [(i, "w " * 10, f"s{i % 3}") for i in range(3000)])
    plan = mixing.curriculum(rows).collect()
    assert [r["at"] for r in plan] == sorted(r["at"] for r in plan)
    total = 0
    for r in sorted(plan, key=lambda r: r["at"]):
        assert r["at"] == total
        total += r["words"]
    assert total == 30_000
    for source_target, knots in zip((18_750, 7_500, 3_750), mixing.SCHEDULES):
        mine = [r for r in plan if r["target"] == source_target]
        for moment in (0.25, 0.5, 0.75):
            (t0, w0), (t1, w1) = knots
            due = (w0 * moment + (w1 - w0) * moment**2 / 2) / mixing.integral(knots)
            got = sum(r["words"] for r in mine if r["position"] < moment) / source_target
            assert got == pytest.approx(due, abs=0.01)


def test_moments_of_bent_schedules(spark):
    knots = ((0.0, 1.0), (0.25, 0.0), (0.5, 0.0), (1.0, 4.0))
    rows = spark.range(101).select((mixing.F.col("id") / 100).alias("share")).withColumn("t", mixing.moment(mixing.F.col("share"), knots))
    for r in rows.collect():
        t = r["t"]
        area = t - 2 * t * t if t < 0.25 else 0.125 if t < 0.5 else 0.125 + 4 * (t - 0.5) ** 2
        assert area / mixing.integral(knots) == pytest.approx(r["share"], abs=1e-9)


def test_reruns_and_dealing_agree(spark):
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_word"]
    told = lambda df: sorted(map(tuple, mixing.mixed(df).select(columns).collect()), key=str)
    rows = rows_of(spark, [r for r in some() if r[0] is not None])
    first = told(rows)
    assert told(rows.repartition(13)) == first == told(rows.orderBy("text").coalesce(1))


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = rows_of(spark, some())
    told = lambda: sorted(map(tuple, mixing.mixed(rows).collect()), key=str)
    wide = told()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert told() == wide


def test_empty_and_wordless(spark):
    assert mixing.mixed(rows_of(spark, [])).collect() == [] == mixing.curriculum(rows_of(spark, [])).collect()
    (row,) = mixing.mixed(rows_of(spark, [(1, None, None)])).collect()
    assert (row["size"], row["target"], row["taken"], row["first_word"]) == (0, 0.0, 0, None)


def test_running_totals_cross_parts(spark):
    rows = spark.range(1000).select((mixing.F.col("id") * 7919 % 1000).alias("k"), mixing.F.lit(2).alias("n"))
    assert all(r["before"] == 2 * r["k"] for r in ranges.running(rows, ["k"], {"before": "n"}, "t").collect())
