"""BM25 over several blocks of questions reads texts once, and its sums in single precision decide nothing that doubles would not."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import nearest
from ledgerloom.operators import retrieval as T


def rows(seed, n, words):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 90}" for _ in range(rng.randint(0, words)))) for i in range(n)]


@pytest.fixture
def tables(spark):
    chunks = [*rows(1, 300, 60), (7, "w1 w2 w2"), (7, "w1 w3 w3"), (None, "w1 w5"), (401, None)]
    return spark.createDataFrame(rows(2, 40, 30), "query_id int, question string"), spark.createDataFrame(chunks, "chunk_id bigint, text string")


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_blocks_share_one_reading_of_the_texts(spark, tables, monkeypatch):
    whole = told(T.bm25(*tables, k=3))
    texts, counts = [], T.held_words
    monkeypatch.setattr(T, "held_words", lambda chunks, names: texts.append(len(names)) or counts(chunks, names))
    monkeypatch.setattr(T, "WORDS", 95)
    found = T.bm25(*tables, k=3)
    assert told(found) == whole and len(texts) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and "text#" not in plan
    monkeypatch.setattr(T, "WORDS", 20)
    assert told(T.bm25(*tables, k=3)) == whole and len(texts) > 2


@pytest.mark.parametrize("own,asked,terms,chunks", [(0, 128, 1 << 13, 512), (3, 2, 5, 4), (1000, 7, 40, 64), (5, 1, 1, 1)])
def test_sums_equal_plain_ones(monkeypatch, own, asked, terms, chunks):
    rng = random.Random(own)
    for name, value in (("OWN", own), ("ASKED", asked), ("TERMS", terms), ("CHUNKS", chunks)):
        monkeypatch.setattr(nearest, name, value)
    docs = [{rng.randrange(50): rng.choice([1e-9, 0.5, 0.5 + 1e-6, rng.random() * 30]) for _ in range(rng.randint(0, 12))} for _ in range(130)]
    asks = [sorted({rng.randrange(50) for _ in range(rng.randint(0, 9))}) for _ in range(23)]
    common = [sum(w in d for d in docs) for w in range(50)]
    kind = pa.list_(pa.struct([("n", pa.int32()), ("words", pa.list_(pa.int32())), ("often", pa.list_(pa.int32()))]))
    parts = pa.array([[{"n": 5, "words": list(d), "often": list(range(len(d)))}] for d in docs], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(130)), parts], ["chunk_id", "parts"])
    for k in (1, 4, 200):
        given = iter([[x for d in some for x in d.values()] for some in (docs[:70], docs[70:])])
        run = nearest.sum_weights(pa.array(range(23)), [np.array(a, int) for a in asks], np.array(common), lambda word, tf, n, given=given: np.array(next(given)), k)
        ours = sorted((r["query_id"], r["chunk_id"], r["score"]) for b in run(iter([batch.slice(0, 70), batch.slice(70)])) for r in b.to_pylist())
        plain = [(q, c, s) for q, a in enumerate(asks) for c, d in enumerate(docs) if (s := sum(d.get(w, 0.0) for w in a)) > 0]
        best = []
        for q in range(23):
            mine = sorted(((round(s, 6), c) for p, c, s in plain if p == q), key=lambda x: (-x[0], x[1]))
            best += [(q, c, s) for s, c in mine[:k]]
        assert ours == sorted(best)


def test_rerank_splits_a_text_once(spark, monkeypatch):
    """The default scorer's words of a text are made below the row of each hit; a scorer of one's own gets both texts as they are."""
    chunks = spark.createDataFrame([(1, "a b c c"), (2, "b c d"), (2, "b x"), (3, None)], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "B c e"), (3, "")], "query_id int, question string")
    hits = spark.createDataFrame([(q, c, r) for q in (1, 2, 3) for r, c in enumerate((3, 2, 1), 1)], "query_id int, chunk_id int, rank int")
    scored = {(1, 1): [1.0], (1, 2): [0.5, 0.5], (1, 3): [0.0], (2, 1): [0.666667], (2, 2): [0.333333, 0.666667], (2, 3): [0.0], (3, 1): [0.0], (3, 2): [0.0, 0.0], (3, 3): [0.0]}
    for few in (T.ASKED, 1):
        monkeypatch.setattr(T, "ASKED", few)
        out = T.rerank(hits, asked, chunks, k=9)
        got = {}
        for r in sorted(out.collect(), key=lambda r: r["score"]):
            got.setdefault((r["query_id"], r["chunk_id"]), []).append(r["score"])
        assert got == scored
        lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        exploded = next(i for i, x in enumerate(lines) if "Generate inline" in x)
        assert not any("split(" in x and "text" in x for x in lines[:exploded]) and any("split(" in x and "text" in x for x in lines[exploded:])
        own = T.rerank(hits, asked, chunks, k=9, scorer=lambda q, t: F.length(q) * 10.0 + F.coalesce(F.length(t), F.lit(0)))
        assert {r["score"] for r in own.where("query_id = 1 and chunk_id = 1").collect()} == {37.0}
