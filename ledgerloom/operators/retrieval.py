"""Retrieval over chunks: metadata filters, dense and sparse scores, fusion, reranking, broadening.

Filters come before any ranking, so that the best k are the best k of what a caller may see.  All
operators take many queries at once; rankings are windows by query, whose limit Spark pushes below
the shuffle.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.snapshots import shared_dir
from .nearest import give_back, scan, spread, sum_weights

TOP_RETRIEVED, TOP_RANKED, RRF_K, K1, B = 20, 5, 60, 1.2, 0.75
#: Queries, and different words of queries, of a block that is broadcast.
ASKED, WORDS = 4096, 200_000
#: Chunks whose words a worker counts at once, and chunks of a batch.
ROWS, BATCH = 256, 512


def visible(chunks: DataFrame, tenant: str | None, financial_type: str | None = None, company: str | None = None, fiscal_year: int | None = None, quarter: str | None = None) -> DataFrame:
    """Latest chunks of a tenant that match; chunks of unknown type match any.  Without a tenant there are none."""
    out = chunks.where(F.col("is_latest") & (F.col("tenant_id") == F.lit(tenant)))
    if financial_type is not None:
        out = out.where(F.col("financial_type").isin(financial_type, "unknown"))
    for column, wanted in (("company", company), ("fiscal_year", fiscal_year), ("quarter", quarter)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    return out


def ranked(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", item: str = "chunk_id") -> DataFrame:
    """The k best items of each query with their rank; ties go to the smaller item."""
    w = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, vectors: DataFrame, k: int = TOP_RETRIEVED, dim: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by inner product.

    The queries are counted and go over the vectors in blocks of about ``ASKED`` at most, one block to a
    worker at a time, so what a worker holds is bounded whatever their number.  The vectors are dealt to
    as many tasks as there are cores, once for all blocks; a task gives k rows a question (``nearest``).
    """
    rows = (vectors.where(F.size("embedding") == dim) if dim else vectors).select("chunk_id", "embedding")
    rows = rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism))
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    blocks = max(1, -(-asked.count() // ASKED))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    kind = StructType([asked.schema["query_id"], rows.schema["chunk_id"], StructField("score", DoubleType())])
    out = None
    for i in range(blocks):
        held = (asked if blocks == 1 else asked.where(block == i)).toArrow()
        found = rows.mapInArrow(scan(*(held.column(c).combine_chunks() for c in ("query_id", "asked")), k), kind)
        best = ranked(found, k)
        out = best if out is None else out.unionByName(best)
    return out


def terms(rows: DataFrame, item: str) -> DataFrame:
    """item, term, tf: lower-case runs of ASCII letters and digits."""
    found = F.explode(F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda t: t != "")).alias("term")
    return rows.select(item, found).groupBy(item, "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = TOP_RETRIEVED, use_idf: bool = True) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25, for any number of questions.

    The questions' words are counted and go over the chunks in blocks of about ``WORDS`` at most, so
    what is broadcast is bounded.  Of a chunk's words only those that are asked for are counted, where
    the texts lie; the counts, arrays by chunk, are written down once, for all blocks if their
    different words are ``WORDS`` at most.  Scores are summed where the counts are (``nearest``), without a
    row for each chunk and question, by a task a core, and what is ranked is k rows a question and task.
    """
    split = lambda x: F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda t: t != "")
    asked = queries.select("query_id", F.explode(split(F.col("question"))).alias("term")).distinct()
    blocks = max(1, -(-asked.count() // WORDS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    kind = StructType([queries.schema["query_id"], chunks.schema["chunk_id"], StructField("score", DoubleType())])
    shared = [r["term"] for r in asked.select("term").distinct().limit(WORDS + 1).collect()] if blocks > 1 else []
    shared = sorted(shared) if 0 < len(shared) <= WORDS else None
    out = counts = None
    for i in range(blocks):
        ids, terms, names = numbered(asked if blocks == 1 else asked.where(block == i), shared)
        if counts is None or not shared:
            counts = held_words(chunks, names).coalesce(max(2, chunks.sparkSession.sparkContext.defaultParallelism))
            total = counts.select(F.explode("parts.n").alias("n")).agg(F.count("*").alias("chunks"), F.avg("n").alias("mean")).first()
            found = counts.mapInArrow(spread(len(names)), "word int, df bigint").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
            df = np.zeros(len(names))
            df[found.column("word").to_numpy()] = found.column("df").to_numpy()
        idf = np.log(1 + (total["chunks"] - df + 0.5) / (df + 0.5)) if use_idf else np.ones(len(names))
        best = ranked(counts.mapInArrow(sum_weights(ids, terms, df, weights(idf, total["mean"]), k), kind), k)
        out = best if out is None else out.unionByName(best)
    return out


def weights(idf: np.ndarray, mean: float | None) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """BM25 weights of words (word, how often, length of the chunk) at a mean length."""
    return lambda word, tf, n: idf[word] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / (mean or 1.0))))


#: For lower-case text as UTF-8: what is in no word becomes a blank.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _asked_counts(names: list[str]):
    """For ``mapInArrow`` over rows (chunk_id, text in lower case): chunk_id, n, words (places in ``names``), often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name.encode(): i for i, name in enumerate(names)}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                lengths, ends, words, often = [], [0], [], []
                for text in some.column(1).cast(pa.binary()).to_pylist():
                    tokens = text.translate(WORD_BYTES).split()
                    found = Counter(map(place.get, tokens))
                    found.pop(None, None)
                    lengths.append(len(tokens))
                    words.extend(found)
                    often.extend(found.values())
                    ends.append(len(words))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (words, often)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lengths, pa.int32()), *lists], ["chunk_id", "n", "words", "often"])
        give_back()

    return run


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH`` rows, so that executors and workers hold few texts at once."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def held_words(chunks: DataFrame, names: list[str]) -> DataFrame:
    """chunk_id, parts (array of n, words, often): how often each chunk has the words ``names``, written to the shared folder.

    Texts are read once and stay where they are; only these arrays are shuffled, so that rows that share an id meet.
    """
    small_batches(chunks.sparkSession)
    kind = StructType([chunks.schema["chunk_id"], *StructType.fromDDL("n int, words array<int>, often array<int>").fields])
    found = chunks.select("chunk_id", F.lower(F.coalesce("text", F.lit("")))).mapInArrow(_asked_counts(names), kind)
    rows = found.repartition("chunk_id").groupBy("chunk_id").agg(F.collect_list(F.struct("n", "words", "often")).alias("parts"))
    path = f"{shared_dir(chunks.sparkSession)}/words-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return chunks.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(asked: DataFrame, names: list[str] | None = None) -> tuple[pa.Array, list[np.ndarray], list[str]]:
    """Of a block (query_id, term): the ids, the numbers of each one's words in order, and the words (``names``, sorted, if given)."""
    rows = asked.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
    terms = rows.column("terms").combine_chunks()
    flat = terms.flatten().dictionary_encode()
    places = flat.indices.to_numpy()
    if names is not None:
        place = {name: i for i, name in enumerate(names)}
        places = np.array([place[name] for name in flat.dictionary.to_pylist()], int)[places]
    numbers = np.split(places, terms.value_lengths().to_numpy().cumsum()[:-1]) if len(terms) else []
    return rows.column("query_id").combine_chunks(), numbers, flat.dictionary.to_pylist() if names is None else names


def fuse(legs: list[DataFrame], k: int = TOP_RETRIEVED, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, chunk_id, rank): a union and one aggregation, whatever the order of legs."""
    rows = legs[0].select("query_id", "chunk_id", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", "chunk_id", "rank"))
    return ranked(rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")), k)


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != ""))


def overlap(asked: Column, held: Column) -> Column:
    """The share of the first words that the second have, too."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, held)), F.size(asked)), F.lit(0.0))


def overlap_score(question: Column, text: Column) -> Column:
    """Default reranker: the share of a question's words that a chunk holds."""
    return overlap(distinct_words(question), distinct_words(text))


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = TOP_RANKED, scorer=overlap_score) -> DataFrame:
    """The k best of the fused hits by ``scorer``: only they meet their texts.

    A text meets the list of its hits, and the default scorer splits each text and each question once, not for
    each hit.  Hits are broadcast where the questions are few enough for one block; beyond, both sides shuffle by chunk.
    """
    few = queries.select("query_id").limit(ASKED + 1).count() <= ASKED
    read, score = (distinct_words, overlap) if scorer is overlap_score else (F.col, scorer)
    hits = fused.groupBy("chunk_id").agg(F.collect_list(F.struct("query_id", F.col("rank").alias("fused_rank"))).alias("hits"))
    found = chunks.select("chunk_id", "text").join(F.broadcast(hits) if few else hits, "chunk_id")
    found = found.select("chunk_id", read("text").alias("text"), "hits").select("chunk_id", "text", F.inline("hits"))
    asked = queries.select("query_id", read("question").alias("question"))
    found = found.join(F.broadcast(asked) if few else asked, "query_id")
    return ranked(found.select("query_id", "chunk_id", "fused_rank", F.round(score(F.col("question"), F.col("text")), 6).alias("score")), k)


def broadened(levels: list[DataFrame]) -> DataFrame:
    """From results of ever wider filters (query_id, tier, ...), one a query: retries replace even a better result.

    A first result of high tier stands; medium is tried once more, low up to twice.
    """
    rows = None
    for i, level in enumerate(levels):
        level = level.withColumn("level", F.lit(i))
        rows = level if rows is None else rows.unionByName(level)
    first = F.max(F.when(F.col("level") == 0, F.col("tier"))).over(Window.partitionBy("query_id"))
    second = F.max(F.when(F.col("level") == 1, F.col("tier"))).over(Window.partitionBy("query_id"))
    wanted = F.when(first == "high", 0).when(first == "medium", 1).when(second == "low", 2).otherwise(1)
    return rows.withColumn("wanted", wanted).where(F.col("level") == F.least("wanted", F.lit(len(levels) - 1))).drop("wanted").withColumn("refused", F.col("tier") == "low")


def broaden(queries: DataFrame, levels: list[Callable[[DataFrame], DataFrame]], keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Results of ever wider filters, round by round: a level is asked only for the questions that need it.

    ``levels`` turn questions (query_id, ...) into results (query_id, tier, ...), one a query at most;
    ``keep`` stores a level's results and gives them back, so that each is computed once and its rows
    can be counted.  A first result of high tier stands; medium is tried once more; low, or none, once
    more and again if that is low or none too.  A retry's result replaces even a better one; where a
    retry finds nothing, the result before it stays.  Returns (query_id, tier, ..., level, refused) and
    the stored results by level.
    """
    asked, out, told = queries, None, []
    for i, level in enumerate(levels):
        rows = keep(level(asked).withColumn("level", F.lit(i)))
        told.append(rows)
        out = rows if out is None else out.join(rows.select("query_id"), "query_id", "left_anti").unionByName(rows)
        settled = rows.where(F.col("tier") == "high") if i == 0 else rows.where(F.col("tier") != "low")
        asked = asked.join(settled.select("query_id"), "query_id", "left_anti")
        if i == 1:
            asked = asked.join(told[0].where("tier = 'medium'").select("query_id"), "query_id", "left_anti")
        if i > 1 or asked.isEmpty():
            break
    return out.withColumn("refused", F.col("tier") == "low"), told
