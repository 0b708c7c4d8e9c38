"""Tables in versions: writers that meet, commits that fail, states of before."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import latest
from ledgerloom.sources import snapshots, store

SCHEMA = "tenant_id string, company string, metric string, fiscal_year int, financial_type string, quarter string, doc_id string, filing_date date, seq int, value double"


def row(doc, day, seq, value=1.0, tenant="t", year=2024, company="A"):
    return (tenant, company, "revenue", year, "consolidated", None, doc, dt.date(2024, 1, day) if day else None, seq, value)


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def outcomes(counts):
    return {r["outcome"]: r["n"] for r in counts.collect()}


def test_state_before_a_restatement(spark, tmp_path):
    path = str(tmp_path / "facts")
    assert outcomes(store.commit_facts(facts(spark, row("a", 5, 1, 10.0), row("a", 5, 1, 7.0, tenant="u")), path)) == {"inserted": 2}
    moment = dt.datetime.now(dt.timezone.utc)
    assert outcomes(store.commit_facts(facts(spark, row("b", 9, 2, 12.0)), path)) == {"restated": 1}
    assert outcomes(store.commit_facts(facts(spark, row("b", 9, 2, 12.0), row("c", 7, 3, 11.0)), path)) == {"skipped": 2}
    value = lambda **k: [r["value"] for r in store.facts_at(spark, path, "t", **k).where("is_latest").collect()]
    assert value() == [12.0] and value(version=0) == [10.0] and value(at=moment) == [10.0]
    now = store.facts_at(spark, path, "t")
    counted = {d: [r["value"] for r in latest.as_of(now, f"2024-01-{d:02}").collect()] for d in (4, 5, 6, 7, 8, 9, 30)}
    assert counted == {4: [], 5: [10.0], 6: [10.0], 7: [11.0], 8: [11.0], 9: [12.0], 30: [12.0]}
    assert store.read_facts(spark, path, "u").count() == 1 and store.read_facts(spark, path, None).count() == 0


def test_two_writers_of_one_part_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "facts")
    store.commit_facts(facts(spark, row("a", 5, 1)), path)
    start = threading.Barrier(3)
    told = {}

    def write(i):
        start.wait()
        told[i] = outcomes(store.commit_facts(facts(spark, row(f"w{i}", 10 + i, 2 + i, float(i)), row(f"n{i}", 3, 1, company=f"own{i}")), path))

    writers = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    rows = store.facts_at(spark, path).collect()
    assert sorted(r["doc_id"] for r in rows) == ["a", "n0", "n1", "n2", "w0", "w1", "w2"]
    assert [r["doc_id"] for r in rows if r["is_latest"] and r["company"] == "A"] == ["w2"]
    assert all(told[i]["inserted"] == 1 for i in range(3)) and told[2].get("restated") == 1


def test_a_conflict_builds_again(spark, tmp_path):
    table = snapshots.Table(spark, str(tmp_path / "t"), StructType.fromDDL("k string, n int"), ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    calls = []

    def rewrite(held, new):
        calls.append(held.count())
        if len(calls) == 1:  # another writer is faster: on this part, and on another
            table.append_or = table.merge(rows(("x", 1)), lambda h, n: h.union(n))
            table.merge(rows(("y", 2)), lambda h, n: h.union(n))
        return held.union(new)

    table.merge(rows(("x", 3)), rewrite)
    assert calls == [0, 1] and sorted(map(tuple, table.read().collect())) == [("x", 1), ("x", 3), ("y", 2)]
    calls.clear()

    def beside(held, new):
        calls.append(1)
        if len(calls) == 1:
            table.merge(rows(("y", 5)), lambda h, n: h.union(n))
        return held.union(new)

    table.merge(rows(("x", 4)), beside)  # another part: no work is done twice
    assert calls == [1] and table.read().count() == 5


def test_a_failed_commit_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    store.commit_facts(facts(spark, row("a", 5, 1)), path)

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(snapshots, "create_once", broken)
    with pytest.raises(OSError):
        store.commit_facts(facts(spark, row("b", 9, 2)), path)
    monkeypatch.undo()
    assert [r["doc_id"] for r in store.facts_at(spark, path).collect()] == ["a"]
    assert outcomes(store.commit_facts(facts(spark, row("b", 9, 2)), path)) == {"restated": 1}


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    for _ in range(2):
        counts = store.commit_facts(facts(spark, row("a", 5, 1)), path, ("loader", 0))
    assert outcomes(counts) == {} and store.facts_at(spark, path).count() == 1
    table = snapshots.Table(spark, str(tmp_path / "t"), StructType.fromDDL("id bigint"))
    for number in [*range(25), 24, 3]:
        table.append(spark.range(number, number + 1), ("stream", number))
    assert table.version() == 24 and sorted(r["id"] for r in table.read().collect()) == list(range(25))
    assert table.read(21).count() == 22 and len(table._since_whole()) == 5


def test_nulls_and_odd_names_are_parts(spark, tmp_path):
    path = str(tmp_path / "facts")
    odd = [row("a", 5, 1, tenant=None), row("b", 5, 1, tenant="x/y=%"), row("c", None, 1, tenant=""), ("t", *row("d", 5, 1)[1:3], None, *row("d", 5, 1)[4:])]
    store.commit_facts(facts(spark, *odd), path)
    store.commit_facts(facts(spark, row("e", 9, 2, tenant=None)), path)
    assert store.facts_at(spark, path).count() == 5 and store.facts_at(spark, path, "x/y=%").count() == 1
    assert [r["doc_id"] for r in store.facts_at(spark, path).where("tenant_id is null and is_latest").collect()] == ["e"]
    before = snapshots.Table(spark, path).version()
    store.commit_facts(facts(spark).where(F.lit(False)), path)
    assert snapshots.Table(spark, path).version() == before
