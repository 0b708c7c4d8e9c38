"""Streams: filings as they arrive, audit volume by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.latest import upsert


def filings(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def maintain_latest(stream: DataFrame, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Keep the table of all versions with its latest rows; each batch writes a new generation.

    A batch that runs again after a failure reads the generation before it and overwrites its own,
    so replays give the same table.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema(schema + ", is_latest boolean").parquet(f"{target}/{number - 1}") if number else spark.createDataFrame([], schema + ", is_latest boolean")
        upsert(earlier, batch).write.mode("overwrite").parquet(f"{target}/{number}")

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_volume(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Queries by tenant and UTC day; rows later than ``late`` no longer count, so state is bounded."""
    w = F.window("created_at", "1 day")
    return stream.withWatermark("created_at", late).groupBy(w.alias("w"), "tenant_id").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "tenant_id", "n")
