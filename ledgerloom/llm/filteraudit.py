"""How document filters overlap: what each removes in every order of them.

Each document gets a mask of the filters that it fails.  Four need the document alone; the fifth
(copies) is found by sorting: documents are dealt by ranges of their text's fingerprint and id, and
sorted by fingerprint, full text and id.  A copy then follows its predecessor, and one reading in
sorted order compares the two texts.  A group that crosses from one part into the next is settled
afterwards: every part tells the least ids of its first and last fingerprint's texts, two rows a part
but for texts that share a fingerprint, and the least over all parts counts.  Masks are counted by
part of the corpus; all 120 orders follow from these 32 counts, as they add up.

Defined results: null texts are empty, null sources the part ''.  A row fails as a copy if some row
with the same text has a smaller id; rows without an id neither fail nor make others fail, nor do
repeated rows of one id.  A document is good or toxic if any of its labels says so.  An empty table
gives no rows.  Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, map_batches

#: Filters in the order of their bits: short, repetitive, capitals, symbols, copies.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
WORD = r"[^\x20\x09-\x0D]+"


def own_failures(rows: DataFrame) -> DataFrame:
    """doc_id, part, text, print and the mask of the filters that a document fails by itself."""
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, text = F.size("words"), F.col("text")
    conditions = [n < 200, 100 * F.size(F.array_distinct("words")).cast("bigint") < 50 * n.cast("bigint"), 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 2 * F.length(text).cast("bigint"), text.rlike("[#$%&*|]")]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    return rows.select("doc_id", "part", "text", "print", mask.alias("mask"))


class _Runs:
    """One part in sorted order: marks copies of earlier rows, and tells the runs at the part's two ends."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.at = schema, TaskContext.get().partitionId()
        self.first = self.print = self.text = self.least = None
        self.run, self.heads = -1, []

    def edges(self) -> list[dict]:
        return [{"at": self.at, "run": run, "print": self.print, "text": text, "least": least} for run, text, least in self.heads]

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, ids, parts, masks, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("print", "doc_id", "part", "mask", "text"))
        alike = [False, *pc.equal(texts[1:], texts[:-1]).to_pylist()] if batch.num_rows else []
        rows, out = zip(prints.to_pylist(), ids.to_pylist(), parts.to_pylist(), masks.to_pylist()), []
        for i, (mark, doc_id, part, mask) in enumerate(rows):
            if mark != self.print:
                if self.print is None:
                    self.first = mark
                elif self.print == self.first:
                    out += self.edges()
                self.print, self.heads = mark, []
                new = True
            else:
                new = not alike[i] if i else texts[0].as_py() != self.text
            if new:
                self.run, self.least = self.run + 1, doc_id
                self.heads.append((self.run, texts[i].as_py(), doc_id))
            if mark == self.first:
                out.append({"doc_id": doc_id, "part": part, "mask": mask, "at": self.at, "run": self.run})
            else:
                copy = doc_id is not None and self.least is not None and self.least < doc_id
                out.append({"doc_id": doc_id, "part": part, "mask": mask | COPY if copy else mask})
        if batch.num_rows:
            self.text = texts[-1].as_py()
        return pa.RecordBatch.from_pylist(out, self.schema)

    def finish(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(self.edges() if self.print is not None else [], self.schema)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask with the bit of copies: one shuffle of the texts, range-sorted.

    The other filters look at texts once they are sorted, so that finding the ranges reads no more than fingerprints.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("print", F.sha2(F.col("text").cast("binary"), 256))
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = rows.repartitionByRange("print", by_id, "row").sortWithinPartitions("print", "text", by_id, "row")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, part string, mask int, at int, run bigint, print string, text string, least {kind}"
    fields = docs.sparkSession.createDataFrame([], schema)
    arrow = fields.toArrow().schema
    found = cut(map_batches(own_failures(ordered), lambda: _Runs(arrow), schema), "audit-runs")
    edges = found.where("print is not null").select("at", "run", "print", "text", "least")
    across = F.min("least").over(Window.partitionBy("print", "text"))
    settled = edges.select("at", "run", across.alias("least"))
    inner = found.where("print is null").select("doc_id", "part", "mask", "at", "run")
    marked = inner.join(F.broadcast(settled), ["at", "run"], "left")
    return marked.select("doc_id", "part", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"))


def counters(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, n, good, toxic: for each part three arrays of 32 counts, one for each mask.

    Rows alike are counted before they meet the labels, so an id that many rows repeat is a few rows there.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = marked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known.where("good + toxic > 0"), "doc_id", "left")
    sums = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))
    each = lambda c: F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(1 << len(FILTERS)))).alias(c)
    return sums.groupBy("part").agg(each("n"), each("good"), each("toxic"))


def _total(counts: str, which) -> Column:
    """Sum of an array of counts over the masks that ``which`` (a function of a Column) accepts."""
    kept = F.transform(counts, lambda n, m: F.when(which(m.cast("int")), n).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, n: s + n)


def orders(counted: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with what that step's filter removes there."""
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    rows = counted.select("*", F.inline(F.array(*steps)))
    bit, before = F.col("bit"), F.col("before")
    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~earlier(m)
    share = F.transform("n", lambda n, m: F.when(fails(m.cast("int")), n * (F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return rows.select(
        "part",
        "filter_order",
        "step",
        _total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        _total("n", lambda m: m == bit).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("bigint"), lambda s, n: s + n).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All of it: masks by one sorted reading, counts by part, and every order from the counts."""
    return orders(counters(masks(docs), labels))
