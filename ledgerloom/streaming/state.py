"""Streams that keep state by key: the value that counts for each fact, and an audit log without repeats.

What comes out of a batch is committed to a table in versions under the batch's number, so a batch
that runs again after a failure adds nothing, whatever it did before it failed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.latest import KEY
from ..sources.snapshots import Table
from ..sources.store import audit_rows

CHANGES = "tenant_id string, company string, metric string, fiscal_year int, financial_type string, quarter string, doc_id string, filing_date date, seq int, value double, outcome string"
HELD = "doc_id string, filing_date date, seq int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Latest(StatefulProcessor):
    """Holds the version of one fact that counts; gives the versions that replace it, and forgets facts that rest for ``keep``."""

    def __init__(self, keep: dt.timedelta):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, changed = self.held.get() if self.held.exists() else None, False
        for r in sorted(rows, key=lambda r: (r["seq"], r["doc_id"])):
            if r["filing_date"] is None or held and (r["doc_id"] == held[0] or r["filing_date"] < held[1]):
                continue
            outcome = "inserted" if held is None else "restated" if r["filing_date"] > held[1] else "reingested"
            held, changed = (r["doc_id"], r["filing_date"], r["seq"]), True
            yield Row(**{c: r[c] for c in (*KEY, "doc_id", "filing_date", "seq", "value")}, outcome=outcome)
        if changed:
            self.held.update(held)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            until = dt.datetime.combine(held[1], dt.time(), dt.timezone.utc) + self.keep
            self.handle.registerTimer(int(until.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def changes(stream: DataFrame, late: str = "400 days", keep: dt.timedelta = dt.timedelta(days=800)) -> DataFrame:
    """The versions of facts that come to count, each with its outcome, from a stream of filings.

    State is one version for each key: work follows the batch, not the table.  Filings that come more than ``late``
    behind the newest are left out, and a key's state goes once the stream is ``keep`` past its filing date.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.withColumn("filed_at", F.col("filing_date").cast("timestamp")).withWatermark("filed_at", late)
    keyed = rows.groupBy(*KEY)
    return keyed.transformWithState(Latest(keep), StructType.fromDDL(CHANGES), "Append", "EventTime")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The facts that count, one row a key."""
    return Table(spark, path, StructType.fromDDL(CHANGES)).read()


def maintain_current(stream: DataFrame, path: str, checkpoint: str, name: str = "latest", **bounds) -> StreamingQuery:
    """Keep the table of facts that count: a batch rewrites only the tenants and years in which something changed."""

    def one_batch(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, path, StructType.fromDDL(CHANGES), ["tenant_id", "fiscal_year"])
        newest = Window.partitionBy(*KEY).orderBy(F.desc("filing_date"), F.desc("seq"), F.desc("doc_id"))

        def rewrite(held: DataFrame, new: DataFrame) -> DataFrame:
            return held.unionByName(new).withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")

        batch.persist()
        try:
            table.merge(batch, rewrite, (name, number))
        finally:
            batch.unpersist()

    return changes(stream, **bounds).writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_audit(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour", name: str = "audit") -> StreamingQuery:
    """Append requests (request_id, created_at, ...) to the audit log, each once.

    A request that is sent again within ``late`` is dropped by its id, and ids are forgotten after
    that.  A batch that was committed and runs again after a failure is known by its number.
    """
    once = stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["request_id"])
    rows = audit_rows(once)

    def one_batch(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, path, batch.schema).append(batch, (name, number))

    return rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
