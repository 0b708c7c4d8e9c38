"""Each level is asked for the questions that need it, and no others."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import broaden

TIERS = {1: ("high", "low", "low"), 2: ("medium", "low", "high"), 3: ("medium", "high", "high"), 4: ("low", "medium", "high"), 5: ("low", "low", "medium"), 6: (None, "low", "high"), 7: ("low", None, "low"), 8: (None, None, None), 9: ("medium", None, "high"), None: ("low", "low", "high")}
WANTED = {1: (0, "high"), 2: (1, "low"), 3: (1, "high"), 4: (1, "medium"), 5: (2, "medium"), 6: (2, "high"), 7: (2, "low"), 9: (0, "medium")}


@pytest.fixture
def asked(spark):
    seen = []

    def level(i):
        table = spark.createDataFrame([(q, t[i]) for q, t in TIERS.items() if t[i] and q], "query_id int, tier string")

        def run(queries):
            seen.append(sorted(r[0] for r in queries.select("query_id").collect()))
            return table.join(queries.select("query_id"), "query_id", "left_semi")

        return run

    return seen, [level(i) for i in range(3)]


def test_rounds(spark, asked, tmp_path):
    seen, levels = asked

    def keep(rows):
        path = str(tmp_path / uuid.uuid4().hex)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    queries = spark.createDataFrame([(q, "x") for q in TIERS if q], "query_id int, tier string")
    out, told = broaden(queries, levels, keep)
    assert {r["query_id"]: (r["level"], r["tier"]) for r in out.collect()} == WANTED
    assert all(r["refused"] == (r["tier"] == "low") for r in out.collect())
    assert seen == [[1, 2, 3, 4, 5, 6, 7, 8, 9], [2, 3, 4, 5, 6, 7, 8, 9], [5, 6, 7, 8]]
    assert [t.count() for t in told] == [7, 5, 3]


def test_nothing_to_retry_asks_one_level(spark, tmp_path):
    high = lambda q: q.select("query_id", F.lit("high").alias("tier"))
    never = lambda q: 1 / 0
    out, told = broaden(spark.range(5).withColumnRenamed("id", "query_id"), [high, never, never], lambda rows: rows)
    assert out.count() == 5 and len(told) == 1
