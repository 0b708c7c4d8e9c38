import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.operators import latest as V
from ledgerloom.sources import store

SCHEMA = "tenant_id string, company string, metric string, fiscal_year int, financial_type string, quarter string, doc_id string, filing_date date, seq int, value decimal(28,6)"


def filing(doc, day, seq, value=1, quarter=None):
    return ("t", "A", "revenue", 2024, "consolidated", quarter, doc, day and dt.date(2024, 1, day), seq, D(value))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def outcomes(spark, *rows):
    return [r["outcome"] for r in V.outcomes(frame(spark, *rows)).orderBy("seq").collect()]


def test_outcomes(spark):
    got = outcomes(spark, filing("a", 5, 1), filing("a", 5, 2), filing("b", 9, 3), filing("c", 9, 4), filing("d", 2, 5), filing("e", None, 6))
    assert got == ["inserted", "skipped", "restated", "reingested", "skipped", "skipped"]


def test_replay_keeps_exactly_one_latest(spark):
    rows = V.latest(frame(spark, filing("a", 5, 1), filing("b", 5, 2), filing("a", 5, 3), filing("a", 5, 4, quarter="Q1"))).collect()
    assert len(rows) == 2 and {r["quarter"] for r in rows} == {None, "Q1"}


def test_upsert_is_idempotent(spark):
    first, second = frame(spark, filing("a", 5, 1)), frame(spark, filing("b", 9, 2, 7))
    empty = frame(spark).withColumn("is_latest", F.lit(True))
    once = V.upsert(V.upsert(empty, first), second)
    twice = V.upsert(once, second)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert [r["doc_id"] for r in twice.where("is_latest").collect()] == ["b"]


def test_store_counts_outcomes(spark, tmp_path):
    empty = frame(spark).withColumn("is_latest", F.lit(True))
    counts = store.write_facts(empty, frame(spark, filing("a", 5, 1), filing("b", 9, 2)), str(tmp_path / "facts"))
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"inserted": 1, "restated": 1}
    read = store.read_facts(spark, str(tmp_path / "facts"), "t")
    assert [r["doc_id"] for r in read.collect()] == ["b"]
    assert store.read_facts(spark, str(tmp_path / "facts"), None).count() == 0


def test_insert_new_compares_null_quarters(spark):
    old, new = frame(spark, filing("a", 5, 1)), frame(spark, filing("a", 5, 2), filing("b", 5, 3))
    assert [r["doc_id"] for r in V.insert_new(old, new).collect()] == ["b"]


def test_commits_do_not_join_the_lines_anew(spark, sf, monkeypatch):
    from ledgerloom import catalog

    plans, commit = [], catalog.store.commit_facts
    monkeypatch.setattr(catalog.store, "commit_facts", lambda rows, *more: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), commit(rows, *more)))
    catalog._committed(spark, sf)
    assert len(plans) == 4 and not any("Join" in p for p in plans)
