"""The stored inverted index gives what a scan of all chunks gives, from few postings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import postings, retrieval

SCHEMA = "chunk_id bigint, text string, extra string"


def corpus(seed=1, n=300):
    """Chunks in three vocabularies with words of very different frequency."""
    rng = random.Random(seed)
    word = lambda kind: f"{'abc'[kind]}{int(rng.paretovariate(0.8))}"
    return [(i, " ".join(word(i % 3) for _ in range(rng.randint(1, 60))), "x") for i in range(n)]


ODD = [(900, None, "x"), (901, "", "x"), (902, "?! ", "x"), (903, "A1 a1, B2", "x"), (904, "rare " * 3000, "x")]


def asked(spark):
    return spark.createDataFrame([(1, "a1 a2 rare"), (2, "b3 b7 c900"), (3, "unheard of"), (4, ""), (5, None), (6, "A1 b1 c1 a1")], "query_id int, question string")


def told(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index that took its chunks in three steps, the last of which repeats some."""
    index = postings.Index(spark, str(tmp_path_factory.mktemp("index")))
    rows = corpus() + ODD
    added = [index.add(spark.createDataFrame(some, SCHEMA)) for some in (rows[:200], rows[200:] + ODD[3:], rows[:50])]
    return index, rows, added


def test_steps_equal_one_scan(spark, grown):
    index, rows, added = grown
    assert added == [200, len(rows) - 200, 0]
    chunks = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 5, 400):
        assert told(index.search(asked(spark), k)) == told(retrieval.bm25(asked(spark), chunks, k))


def test_blocks_of_questions(spark, grown, monkeypatch):
    index, _, _ = grown
    whole = told(index.search(asked(spark), 3))
    monkeypatch.setattr(postings, "ASKED", 2)
    monkeypatch.setattr(postings, "NAMED", 1)
    assert told(index.search(asked(spark), 3)) == whole


def test_few_postings_are_read(spark, grown):
    index, _, _ = grown
    question = spark.createDataFrame([(1, "a40 a3"), (2, "rare b2")], "query_id int, question string")
    share = index.share(question, 3)
    assert 0 < share["scored"] < share["of_terms"] and share["scored"] < share["all"] / 10


def test_headers_come_without_postings(spark, grown):
    index, _, _ = grown
    known, slots, _ = index.bounds(asked(spark).select("query_id", F.explode(postings.words(F.col("question"))).alias("term")), ["a1"])
    plan = slots._jdf.queryExecution().executedPlan().toString()
    assert "posts" not in plan.split("ReadSchema")[1].split("\n")[0] and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_nothing_yet(spark, tmp_path):
    index = postings.Index(spark, str(tmp_path / "none"))
    assert index.add(spark.createDataFrame([], SCHEMA)) == 0 and index.search(asked(spark)).count() == 0


def test_many_questions_make_no_row_for_a_pair(spark, grown, monkeypatch):
    """Above ``FEW`` questions a task gives k rows a question, whatever the number of chunks that share its words."""
    index, rows, _ = grown
    monkeypatch.setattr(postings, "FEW", 2)
    monkeypatch.setattr(index, "bounds", None)
    chunks = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 5, 400):
        assert told(index.search(asked(spark), k)) == told(retrieval.bm25(asked(spark), chunks, k))
    whole = told(index.search(asked(spark), 3))
    for name, value in (("ASKED", 2), ("NAMED", 1), ("WORDS", 4)):
        monkeypatch.setattr(postings, name, value)
        assert told(index.search(asked(spark), 3)) == whole
    terms = asked(spark).select("query_id", F.explode(F.array_distinct(postings.words(F.col("question")))).alias("term"))
    given = index.summed(terms, 2)
    tasks = given.withColumn("task", F.spark_partition_id()).groupBy("task", "query_id").count()
    assert tasks.agg(F.max("count")).first()[0] <= 2


def test_building_makes_no_row_for_a_posting(spark, tmp_path, monkeypatch):
    """Counts go to their slot as arrays and blocks are made there, also where a batch ends within a slot."""
    rows = corpus(seed=5, n=200) + ODD
    index = postings.Index(spark, str(tmp_path / "built"))
    plans, append = [], index.blocks.append
    monkeypatch.setattr(index.blocks, "append", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or append(df))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        assert index.add(spark.createDataFrame(rows, SCHEMA)) == len(rows)
        monkeypatch.setattr(postings, "FEW", 2)
        many = told(index.search(asked(spark), 9))
    finally:
        spark.conf.set(size, before)
    assert len(plans) == 1 and "inline" not in plans[0] and "collect_list" not in plans[0]
    assert many == told(retrieval.bm25(asked(spark), spark.createDataFrame(rows, SCHEMA), 9))
    blocks = index.blocks.read().collect()
    assert len({(b["term"], b["slot"]) for b in blocks}) == len(blocks)
    assert sum(b["df"] for b in blocks) == sum(len(set(postings_of(t))) for _, t, _ in rows)
    for b in blocks:
        assert b["df"] == len(b["posts"]) and [p["chunk_id"] for p in b["posts"]] == sorted(p["chunk_id"] for p in b["posts"])
        assert b["reach"] == pytest.approx(max(p["tf"] / (1.2 * (0.25 + 0.75 * p["n"] / b["mean"])) for p in b["posts"]))


def postings_of(text):
    return re.findall("[a-z0-9]+", (text or "").lower())
