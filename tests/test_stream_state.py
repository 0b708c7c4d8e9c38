"""Keyed streams: late and repeated filings, forgotten keys, batches that run again."""

import datetime as dt

import pytest
from pyspark.sql.types import StructType

from ledgerloom.operators.latest import KEY, latest
from ledgerloom.sources.snapshots import Table
from ledgerloom.streaming import ingest, state

SCHEMA = "tenant_id string, company string, metric string, fiscal_year int, financial_type string, quarter string, doc_id string, filing_date date, seq int, value double"
DAY = dt.date(2024, 1, 1)


def row(doc, day, seq, company="A", year=2024, value=1.0):
    return ("t", company, "revenue", year, "consolidated", None, doc, None if day is None else DAY + dt.timedelta(day), seq, value)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, **bounds):
    query = state.maintain_current(ingest.filings(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "state"), **bounds)
    query.awaitTermination()
    return {(r["company"], r["fiscal_year"]): (r["doc_id"], r["outcome"]) for r in state.current(spark, str(tmp_path / "out")).collect()}


def test_changes_by_batch(spark, tmp_path):
    batches = [
        [row("a", 5, 1), row("b", 9, 2), row("a", 5, 3), row("n", None, 4), row("x", 5, 1, "B"), row("y", 1, 1, year=2023)],
        [row("old", 7, 5), row("c", 9, 6), row("z", 2, 2, year=2023)],
        [row("c", 9, 7)],
    ]
    wanted = [{("A", 2024): ("b", "restated"), ("B", 2024): ("x", "inserted"), ("A", 2023): ("y", "inserted")}, {("A", 2024): ("c", "reingested"), ("B", 2024): ("x", "inserted"), ("A", 2023): ("z", "restated")}]
    seen = []
    for batch, now in zip(batches, [*wanted, wanted[-1]]):
        feed(spark, tmp_path / "in", batch)
        assert run(spark, tmp_path) == now
        seen += batch
    every = latest(spark.createDataFrame(seen, SCHEMA))
    assert {tuple(r[c] for c in (*KEY, "doc_id")) for r in every.collect()} == {tuple(r[c] for c in (*KEY, "doc_id")) for r in state.current(spark, str(tmp_path / "out")).collect()}
    table = Table(spark, str(tmp_path / "out"))
    (entry,) = table._entries([1])
    assert {tuple(p) for p, _ in entry["parts"]} == {("t", "2024"), ("t", "2023")} and table.version() == 1  # the third batch changed nothing


def test_keys_are_forgotten(spark, tmp_path):
    """Once the stream is far past a key, its state goes: a later filing of it is a first one again."""
    for i, rows in enumerate([[row("a", 1, 1)], [row("far", 100, 2, "B")], [row("farther", 200, 3, "B")], [row("again", 210, 4)]]):
        feed(spark, tmp_path / "in", rows)
        now = run(spark, tmp_path, late="10 days", keep=dt.timedelta(days=30))
    assert now == {("A", 2024): ("again", "inserted"), ("B", 2024): ("farther", "inserted")} or now[("A", 2024)] == ("again", "inserted")


def audit(spark, tmp_path, rows):
    at = dt.datetime(2024, 1, 1, 12)
    schema = "request_id string, created_at timestamp, query_text string"
    spark.createDataFrame([(i, at + dt.timedelta(minutes=m), "q" * 600) for i, m in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_a_killed_audit_leaves_each_row_once(spark, tmp_path, monkeypatch):
    stream = audit(spark, tmp_path, [("a", 0), ("b", 1), ("a", 2), ("a", 0)])
    append = Table.append

    def dies(self, *args):
        append(self, *args)
        raise OSError("the driver is lost after the commit and before Spark notes it")

    monkeypatch.setattr(Table, "append", dies)
    with pytest.raises(Exception):
        state.maintain_audit(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    monkeypatch.undo()
    audit(spark, tmp_path, [("b", 5), ("c", 6)])
    for _ in range(2):
        state.maintain_audit(audit(spark, tmp_path, []) if _ else stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    rows = Table(spark, str(tmp_path / "log"), StructType.fromDDL("request_id string, created_at timestamp, query_text string")).read().collect()
    assert sorted(r["request_id"] for r in rows) == ["a", "b", "c"] and {len(r["query_text"]) for r in rows} == {500}
