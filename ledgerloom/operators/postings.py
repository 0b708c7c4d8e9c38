"""A stored inverted index: chunks are added in generations, and the best k are found from few blocks.

Chunks are dealt to slots of about ``SLOT`` chunks that share their commonest word, so that texts of
one language or subject lie together.  The index has one row for each term and slot: the postings of
that slot's chunks, and a header with their number and the highest reach of any of them.  A posting's
reach, tf / (k1 (1 - b + b n / mean)), grows with its BM25 weight, so a header bounds the weights in
its slot; where the mean length has changed since, the bound is stretched by the change.

A question reads headers alone first.  Summed over its terms they bound the score of every chunk of a
slot.  The most promising slots are scored, their k-th best score is a score that the k-th best of all
reaches at least, and only slots whose bound reaches it too are scored in the end.  The other slots'
postings are never opened, and the result is exact.

That makes a row for each question and slot, and pays for few questions alone: many of them need nearly
every slot between them.  More than ``FEW`` are summed in one pass instead (``nearest.sum_weights``): the
postings of their words, weighed, are dealt by chunk, and a task gives k rows a question.

Every generation is one commit of a table in versions (``sources.snapshots``): adding rebuilds nothing, and a
search sees generations whole or not at all.  Rows are sorted by term within files, each of which has whole
slots, so the scan skips row groups without asked terms.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.snapshots import Table
from .nearest import give_back, sum_weights
from .retrieval import ASKED, B, K1, TOP_RETRIEVED, WORD_BYTES, WORDS, numbered, ranked, small_batches, weights

#: Chunks of a slot; slots that a question scores first; terms of a block that the scan is told by name; questions that bounds pay for.
SLOT, FIRST, NAMED, FEW = 32, 8, 2_000, 16
#: Chunks whose words a worker counts at once.
ROWS = 256
#: Chunks whose lists a worker opens at once.
LISTS = 512
#: Scores are compared after rounding to six places.
ROUNDED = 1e-5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (chunk_id, text in lower case) the columns of ``counted``, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            lengths, ends, terms, tfs, commonest = [], [0], [], [], []
            for text in some.column(1).cast(pa.binary()).to_pylist():
                tokens = text.translate(WORD_BYTES).split()
                found = Counter(tokens)
                lengths.append(len(tokens))
                terms.append(b" ".join(found))
                tfs.extend(found.values())
                ends.append(len(tfs))
                most = max(found.values(), default=0)
                commonest.append(max(w for w, tf in found.items() if tf == most) if found else None)
            kept = [pa.array(lengths, pa.int32()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (commonest, terms))]
            yield pa.RecordBatch.from_arrays([some.column(0), *kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int32()))], names=["chunk_id", "n", "commonest", "terms", "tfs"])
    give_back()


def counted(chunks: DataFrame) -> DataFrame:
    """chunk_id, n (its words), commonest (word), terms (its different words, by blanks), tfs (how often each), where the chunks lie: no row for a word, no shuffle."""
    kind = StructType([chunks.schema["chunk_id"], *StructType.fromDDL("n int, commonest string, terms string, tfs array<int>").fields])
    return chunks.select("chunk_id", F.lower(F.coalesce("text", F.lit("")))).mapInArrow(_counts, kind)


def _blocks(mean: float):
    """For ``mapInArrow`` over rows (slot, chunk_id, n, terms, tfs), sorted by slot and chunk: the blocks of every slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_slots(batches):
            slots, ids, n, terms, tfs = batch.columns
            row = np.repeat(np.arange(batch.num_rows), tfs.value_lengths().to_numpy(zero_copy_only=False))
            if not len(row):
                continue
            coded = pa.array(b" ".join(pc.filter(terms, pc.not_equal(terms, "")).cast(pa.binary()).to_pylist()).split(b" "), pa.binary()).dictionary_encode()
            slot, tf, length = slots.dictionary_encode(), tfs.flatten().to_numpy(), n.to_numpy()[row]
            key = slot.indices.to_numpy()[row].astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key, row, tf, length = key[order], row[order], tf[order], length[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            reaches = np.maximum.reduceat(tf / (K1 * (1 - B + B * length / (mean or 1.0))), first)
            posts = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(length, pa.int32())], ["chunk_id", "tf", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), posts)
            term = coded.dictionary.take(pa.array(key[first] % len(coded.dictionary))).cast(pa.string())
            named = slot.dictionary.take(pa.array(key[first] // len(coded.dictionary)))
            df = np.diff(np.r_[first, len(key)])
            yield pa.RecordBatch.from_arrays([term, named, pa.array(reaches), pa.array(np.full(len(first), mean)), pa.array(df, pa.int64()), lists], ["term", "slot", "reach", "mean", "df", "posts"])
        give_back()

    return run


def _whole_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by slot, their first column, in batches of about ``LISTS``, so that no slot is in two."""
    kept: list[pa.RecordBatch] = []
    for batch in (whole.slice(at, LISTS) for whole in batches for at in range(0, whole.num_rows, LISTS)):
        slots = batch.column(0)
        last = pc.index(slots, slots[-1]).as_py()
        if last or kept and kept[-1].column(0)[-1] != slots[-1]:
            yield from _joined([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    yield from _joined(kept)


def _joined(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = [b for b in batches if b.num_rows]
    if some:
        yield pa.concat_batches(some) if len(some) > 1 else some[0]


def _by_lists(names: list[str]):
    """Reads rows (chunk_id, n, terms, tfs) as ids and entries, of the words ``names`` alone, by their places."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = {name.encode(): i for i, name in enumerate(names)}
        for batch in batches:
            for at in range(0, batch.num_rows, LISTS):
                ids, n, terms, tfs = batch.slice(at, LISTS).columns
                found = b" ".join(pc.filter(terms, pc.not_equal(terms, "")).cast(pa.binary()).to_pylist()).split()
                word = np.fromiter(map(place.get, found, repeat(-1)), int, len(found))
                asked = word >= 0
                chunk = np.repeat(np.arange(len(ids)), tfs.value_lengths().to_numpy(zero_copy_only=False))[asked]
                yield ids, chunk, n.to_numpy()[chunk], word[asked], tfs.flatten().to_numpy()[asked]

    return read


class Index:
    """An index at ``path``.  ``chunk_type`` is the type of chunk ids."""

    def __init__(self, spark: SparkSession, path: str, chunk_type: str = "bigint"):
        self.spark = spark
        post = f"array<struct<chunk_id:{chunk_type},tf:int,n:int>>"
        self.blocks = Table(spark, f"{path}/blocks", StructType.fromDDL(f"term string, slot string, reach double, mean double, df bigint, posts {post}"))
        self.chunks = Table(spark, f"{path}/chunks", StructType.fromDDL(f"chunk_id {chunk_type}, n int, generation bigint, lists string"))

    # -- writing ---------------------------------------------------------------------------------
    def add(self, chunks: DataFrame) -> int:
        """Add the chunks (chunk_id, text) whose ids the index lacks, and return how many; rows that share an id count once."""
        small_batches(self.spark)
        rows = chunks.select("chunk_id", "text").where(F.col("chunk_id").isNotNull())
        # Ids alone tell whether texts have to be grouped or compared with what is there; where not, they stay where they are.
        if not rows.groupBy("chunk_id").count().where("count > 1").isEmpty():
            rows = rows.groupBy("chunk_id").agg(F.min("text").alias("text"))
        there = self.chunks.read().select("chunk_id")
        if not rows.select("chunk_id").join(there, "chunk_id", "left_semi").isEmpty():
            rows = rows.join(there, "chunk_id", "left_anti")
        generation = self.blocks.version() + 1
        name = f"lists-{generation}-{uuid.uuid4().hex}"
        self._lists(name).append(counted(rows))
        forward = self._lists(name).read()
        row = forward.agg(F.count("*").alias("chunks"), F.avg("n").alias("mean")).first()
        if not row["chunks"]:
            return 0
        groups = forward.groupBy(F.coalesce("commonest", F.lit("")).alias("kind")).agg(F.count("*").alias("of_kind"))
        n_kinds = groups.count()
        groups = groups.select("kind", F.when(F.col("of_kind") >= SLOT, F.col("kind")).otherwise("").alias("named"), "of_kind")
        sizes = groups.groupBy("named").agg(F.sum("of_kind").alias("size"))
        slots = groups.join(sizes, "named").select("kind", "named", F.ceil(F.col("size") / SLOT).alias("slots"))
        dealt = forward.withColumn("kind", F.coalesce("commonest", F.lit(""))).join(F.broadcast(slots) if n_kinds <= WORDS else slots, "kind")
        slot = F.concat_ws("/", F.lit(str(generation)), "named", F.pmod(F.xxhash64("chunk_id"), F.col("slots")).cast("string"))
        # Counts go to their slot as they are, and a slot's blocks are made there: no row for a posting.
        dealt = dealt.select(slot.alias("slot"), "chunk_id", "n", "terms", "tfs").repartition("slot").sortWithinPartitions("slot", "chunk_id")
        blocks = dealt.mapInArrow(_blocks(float(row["mean"])), self.blocks.read().schema)
        self.blocks.append(blocks.sortWithinPartitions("term", "slot"))
        self.chunks.append(forward.select("chunk_id", "n", F.lit(generation).cast("bigint").alias("generation"), F.lit(name).alias("lists")))
        return row["chunks"]

    # -- searching -------------------------------------------------------------------------------
    def bounds(self, asked: DataFrame, terms: list[str] | None) -> tuple[DataFrame, DataFrame, float]:
        """For a block of questions: asked terms with their idf, the bound of every slot, and the mean length."""
        total = self.chunks.read().agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
        mean = float(total["mean"] or 1.0)
        headers = self.blocks.read().select("term", "slot", "reach", "mean", "df")
        if terms is not None:
            headers = headers.where(F.col("term").isin(terms))
        headers = headers.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        spread = headers.groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.lit(float(total["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = asked.join(spread, "term").select("query_id", "term", idf.alias("idf"))
        most = F.col("reach") * F.greatest(F.lit(1.0), F.lit(mean) / F.col("mean"))
        slots = headers.join(F.broadcast(known), "term").groupBy("query_id", "slot").agg(F.sum(F.col("idf") * (K1 + 1) * most / (most + 1)).alias("bound"))
        return known, slots, mean

    def scored(self, known: DataFrame, slots: DataFrame, mean: float, terms: list[str] | None) -> DataFrame:
        """query_id, chunk_id, score of the chunks in the given slots.

        Postings meet the list of the questions that ask for them (``ASKED`` at most), so they are shuffled
        once and not once for each question.
        """
        blocks = self.blocks.read().select("term", "slot", "posts")
        if terms is not None:
            blocks = blocks.where(F.col("term").isin(terms))
        askers = known.join(slots.select("query_id", "slot"), "query_id").groupBy("term", "slot").agg(F.collect_list(F.struct("query_id", "idf")).alias("askers"))
        wanted = blocks.join(askers, ["term", "slot"]).select("posts", F.inline("askers"))
        posts = wanted.select("query_id", "idf", F.inline("posts"))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(mean)))
        return posts.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * weight), 6).alias("score"))

    def chosen(self, asked: DataFrame, terms: list[str] | None, k: int) -> tuple[DataFrame, DataFrame, float]:
        """For a block of questions: terms with their idf, the slots that have to be scored, and the mean length."""
        known, slots, mean = self.bounds(asked, terms)
        first = ranked(slots, FIRST, score="bound", item="slot")
        kth = ranked(self.scored(known, first, mean, terms), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        slots = slots.join(kth, "query_id", "left").where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - ROUNDED))
        return known, slots, mean

    def summed(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, score of each question's k best chunks of a task, for a block of questions (query_id, term).

        Headers tell how many chunks have a word; the chunks' own lists are read where they lie, by a task a core.
        """
        total = self.chunks.read().agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
        ids, terms, names = numbered(asked)
        numbers = F.broadcast(self.spark.createDataFrame(list(enumerate(names)), "word int, term string"))
        blocks = self.blocks.read()
        if len(names) <= NAMED:
            blocks = blocks.where(F.col("term").isin(names))
        found = blocks.select("term", "df").join(numbers, "term").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(names))
        df[found.column("word").to_numpy()] = found.column("df").to_numpy()
        small_batches(self.spark)
        weigh = weights(np.log(1 + (total["n"] - df + 0.5) / (df + 0.5)), total["mean"])
        lists = self.lists().coalesce(max(2, self.spark.sparkContext.defaultParallelism))
        kind = StructType([asked.schema["query_id"], lists.schema["chunk_id"], StructField("score", DoubleType())])
        return lists.mapInArrow(sum_weights(ids, terms, df, weigh, k, _by_lists(names)), kind)

    def _lists(self, name: str) -> Table:
        return Table(self.spark, f"{self.blocks.path}/{name}", StructType([self.chunks.read().schema["chunk_id"], *StructType.fromDDL("n int, commonest string, terms string, tfs array<int>").fields]))

    def lists(self) -> DataFrame:
        """chunk_id, n, terms, tfs of all chunks: the words of each, as they were counted when it was added."""
        names = [r["lists"] for r in self.chunks.read().select("lists").distinct().collect()]
        out = self._lists("none").read()
        for name in sorted(names):
            out = out.unionByName(self._lists(name).read())
        return out.select("chunk_id", "n", "terms", "tfs")

    def search(self, questions: DataFrame, k: int = TOP_RETRIEVED) -> DataFrame:
        """query_id, chunk_id, score, rank by BM25, for any number of questions (query_id, question), in blocks that may be broadcast."""
        asked = questions.select("query_id", F.explode(F.array_distinct(words(F.col("question")))).alias("term"))
        n = questions.count()
        few = n <= FEW
        blocks = max(1, -(-n // ASKED), 0 if few else -(-asked.count() // WORDS))
        out = None
        for i in range(blocks):
            some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            best = ranked(self._bounded(some, k) if few else self.summed(some, k), k)
            out = best if out is None else out.unionByName(best)
        return out

    def _bounded(self, asked: DataFrame, k: int) -> DataFrame:
        """What the slots that bounds leave open score, for a block of few questions."""
        named = [r["term"] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        terms = named if len(named) <= NAMED else None
        return self.scored(*self.chosen(asked, terms, k), terms)

    def share(self, questions: DataFrame, k: int = TOP_RETRIEVED) -> dict[str, int]:
        """How many postings one block of questions scores, its terms have, and a scan of all for each question would read."""
        asked = questions.select("query_id", F.explode(F.array_distinct(words(F.col("question")))).alias("term"))
        known, slots, _ = self.chosen(asked, None, k)
        of = self.blocks.read().select("term", "slot", "df")
        terms = of.join(F.broadcast(known), "term")
        read = terms.join(slots.select("query_id", "slot"), ["query_id", "slot"], "left_semi").agg(F.sum("df")).first()[0] or 0
        return {"scored": read, "of_terms": terms.agg(F.sum("df")).first()[0] or 0, "all": (of.agg(F.sum("df")).first()[0] or 0) * questions.count()}
