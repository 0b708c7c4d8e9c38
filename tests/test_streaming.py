import datetime as dt

from ledgerloom.operators.latest import KEY
from ledgerloom.streaming import ingest

SCHEMA = "tenant_id string, company string, metric string, fiscal_year int, financial_type string, quarter string, doc_id string, filing_date date, seq int, value double"


def test_batches_keep_one_latest(spark, tmp_path):
    row = lambda doc, day, seq: ("t", "A", "revenue", 2024, "consolidated", None, doc, dt.date(2024, 1, day), seq, 1.0)
    for i, rows in enumerate([[row("a", 5, 1)], [row("b", 9, 2)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.maintain_latest(ingest.filings(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "state"), SCHEMA).awaitTermination()
        out = spark.read.parquet(str(tmp_path / f"out/{i}"))
        assert out.count() == i + 1 and out.where("is_latest").count() == out.select(*KEY).distinct().count() == 1


def test_audit_volume(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 3), "t") for d in (1, 1, 2)]
    spark.createDataFrame(rows, "created_at timestamp, tenant_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("created_at timestamp, tenant_id string").parquet(str(tmp_path / "in"))
    ingest.audit_volume(stream).writeStream.format("memory").queryName("volume").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {str(r["day"]): r["n"] for r in spark.sql("select * from volume").collect()} == {"2024-01-01": 2, "2024-01-02": 1}
