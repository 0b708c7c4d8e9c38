"""Mixing sources to target weights along a curriculum that changes over training.

Every source has a schedule, its weight at each moment of training from 0 to 1 (straight lines
between knots).  Its integral is the source's weight in the mix, from which the words follow that the
source has to give.  The documents of a source stand in one fixed order and are passed through as
often as needed; the words before a document in that stream are the demand at which it is due, and
inverting the integral tells at which moment of training the demand is reached.  Sorting all
documents by that moment, in ranges, gives the training order.

Defined results: a null or empty text has size 0 and is never taken; null sources are one source, the
last; rows that repeat an id are documents of their own; an empty table gives an empty mix.  Columns
other than doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .ranges import running

#: Schedules, repeated over the sources in their order: (moment, weight) knots.  Integrals: 5, 2 and 1.
SCHEDULES = (((0.0, 7.0), (1.0, 3.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 2.0)))
#: Passes over a source at most; sources whose targets are broadcast; copies of a target row beyond that.
PASSES, BROADCAST_SOURCES, COPIES = 3, 100_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def segments(knots: tuple) -> list[tuple[float, float, float, float]]:
    """(start, weight there, slope, integral up to there) of each straight piece, and the end with the whole integral."""
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (t1 - t0) * (w0 + w1) / 2
    return [*out, (knots[-1][0], knots[-1][1], 0.0, area)]


def integral(knots: tuple) -> float:
    return segments(knots)[-1][3]


def moment(share: Column, knots: tuple) -> Column:
    """When ``share`` (from 0 to 1) of the schedule's integral is reached: the inverse of a quadratic in each piece."""
    pieces = segments(knots)
    reached = share * F.lit(pieces[-1][3])
    out = F.lit(pieces[-1][0])
    for (t0, w0, slope, area), (*_, end) in reversed(list(zip(pieces, pieces[1:]))):
        rest = reached - F.lit(area)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        out = F.when(reached < F.lit(end), F.lit(t0) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(w0) + root)).otherwise(0.0)).otherwise(out)
    return out


def sizes(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size and what orders a source's documents: hashes of the id and of the text."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), key.alias("key"), F.md5(text.cast("binary")).alias("print")
    )


def level(sources: DataFrame, total: int, most: int) -> tuple[float, float]:
    """Words for a unit of weight, as a fraction: sources stop at ``most`` times their size, the others share what is left.

    Each step is one small aggregation; a source that has stopped never starts again, so steps end.
    """
    stopped, left, weight = -1, float(total), sources.agg(F.sum("weight")).first()[0] or 1.0
    while True:
        above = F.lit(float(most)) * F.col("source_size") < F.col("weight") * F.lit(left) / F.lit(weight)
        row = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row["n"] <= stopped or not row["free"]:
            return left, weight
        stopped, left, weight = row["n"], float(total - most * row["held"]), row["free"]


def targets(sized: DataFrame, schedules: tuple = SCHEDULES, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """source, rank, plan (its schedule's number), source_size, before (words of the sources before it), target.

    ``share`` of all words is dealt out; sources stand in the order of their code points, null last.
    """
    grouped = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")).withColumn("absent", F.col("source").isNull())
    ranked = running(grouped, ["absent", "source"], {"rank": F.lit(1), "before": "source_size"}, "mix-sources")
    plan = (F.col("rank") % len(schedules)).cast("int")
    weights = F.array(*(F.lit(integral(s)) for s in schedules))
    sources = cut(ranked.select("source", "rank", plan.alias("plan"), "source_size", "before", weights[plan].alias("weight")), "mix-weights")
    total = int((sources.agg(F.sum("source_size")).first()[0] or 0) * share)
    left, weight = level(sources, total, passes)
    target = F.least(F.lit(float(passes)) * F.col("source_size"), F.col("weight") * F.lit(left) / F.lit(weight))
    return sources.withColumn("target", target)


def _with_targets(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row beside its source's; where sources are too many to broadcast, hot ones are spread over copies of their row."""
    sources = sources.withColumnRenamed("source", "of").withColumnRenamed("before", "base")
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    copies = sources.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = rows.withColumn("salt", F.pmod("row", F.lit(COPIES)).cast("int"))
    return dealt.join(copies, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy"))).drop("of", "weight", "salt", "copy")


def placed(docs: DataFrame, schedules: tuple = SCHEDULES, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """Documents with their source's target and the words before them in one pass over the source (``offset``)."""
    sized = cut(sizes(docs), "mix-sizes")
    sources = targets(sized, schedules, passes, share)
    order = ["absent", "source", "key", "doc_id", "print", "row"]
    rows = running(sized.withColumn("absent", F.col("source").isNull()), order, {"before": "size"}, "mix-offsets")
    rows = _with_targets(rows, sources)
    return rows.select("row", "doc_id", "rank", "plan", "size", "source_size", "target", (F.col("before") - F.col("base")).alias("offset"))


def takes(rows: DataFrame, schedules: tuple = SCHEDULES, passes: int = PASSES) -> DataFrame:
    """One row for each time that a document of ``placed`` is taken: its pass, demand, words and moment of training.

    A source's last document is taken up to the word at which the target is met.
    """
    rows = rows.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    rows = rows.withColumn("demand", F.col("pass") * F.col("source_size") + F.col("offset"))
    rows = rows.withColumn("words", F.least(F.col("size"), F.round("target").cast("bigint") - F.col("demand"))).where("words > 0")
    reached, position = F.col("demand") / F.col("target"), F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        position = F.when(F.col("plan") == i, moment(reached, knots)).otherwise(position)
    return rows.withColumn("position", position)


def curriculum(docs: DataFrame, schedules: tuple = SCHEDULES, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """The mix in training order, as far as rows have one: range-sorted by position, ``at`` is the number of words before."""
    return _ordered(takes(placed(docs, schedules, passes, share), schedules, passes)).drop("row", "plan", "rank").repartitionByRange("at").sortWithinPartitions("at")


def _ordered(taken: DataFrame) -> DataFrame:
    return running(taken, ["position", "rank", "demand"], {"at": "words"}, "mix-order")


def mixed(docs: DataFrame, schedules: tuple = SCHEDULES, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, and the place of its first word in training, if it is taken."""
    rows = cut(placed(docs, schedules, passes, share), "mix-placed")
    columns = ["row", "doc_id", "size", "source_size", "target"]
    taken = _ordered(takes(rows, schedules, passes)).select(*columns, "words", "at")
    told = rows.select(*columns, F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("bigint").alias("at")).unionByName(taken)
    told = told.groupBy("row").agg(*(F.max(c).alias(c) for c in columns[1:]), F.sum("words").alias("taken"), F.min("at").alias("first_word"))
    return told.drop("row")
