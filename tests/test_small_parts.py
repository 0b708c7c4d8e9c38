"""Functions that no query reads: lists of figures, keywords, the chunk store, users, uploads, results, prompts, disagreements."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import contradictions, kpi
from ledgerloom.plans import answer, evaluation, registry, router
from ledgerloom.sources import store


def test_ordered_lists(spark):
    rows = [("a", "2024-01-02", 0.9, 10), ("a", "2024-01-01", 0.6, 30), ("b", "2024-01-01", None, 50), (None, "2024-01-03", 0.1, 0)]
    audit = spark.createDataFrame(rows, "query_path string, created_at string, confidence double, latency_ms int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = {name: [tuple(r) for r in df.collect()] for name, df in kpi.ordered_lists(audit).items()}
    assert out["paths"] == [("a", 2), ("b", 1), ("unknown", 1)]
    assert out["days"] == [("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-03", 1)]
    assert out["tiers"] == [("low", 2), ("high", 1), ("medium", 1)]
    assert out["latency"] == [("b", 50.0), ("a", 20.0)]


def test_missing_keywords(spark):
    rows = spark.createDataFrame([("x", "Revenue grew", ["revenue", "Profit"], [1, 2], [2]), ("y", None, None, None, None), ("z", None, ["a"], [3], None)], "id string, response_text string, expected_keywords array<string>, expected_source_pages array<int>, pages array<int>")
    assert {r["id"]: (r["missing"], r["missed_pages"]) for r in evaluation.missing_keywords(rows).collect()} == {"x": (["Profit"], [1]), "y": ([], []), "z": (["a"], [3])}


def test_collection_info(spark):
    chunks = spark.createDataFrame([(2, "two"), (1, "one")], "chunk_id int, text string")
    (row,) = store.collection_info(chunks).collect()
    assert row["n_chunks"] == 2 and row["sample"]["text"] == "one"
    (row,) = store.collection_info(chunks.limit(0)).collect()
    assert row["n_chunks"] == 0 and row["sample"] is None


def test_user_by_email(spark):
    users = spark.createDataFrame([(1, "t1", "analyst", "h1", "a@x.org"), (2, "t2", "admin", "h2", "A@x.org"), (3, "t3", "admin", "h3", None)], "user_id int, tenant_id string, role string, password_hash string, email string")
    assert [tuple(r) for r in store.user_by_email(users, "a@x.org").collect()] == [(1, "t1", "analyst", "h1")]


def test_acceptable(spark):
    files = [("a.PDF", 1, True), ("a.pdf", 0, False), ("a.pdf", store.LARGEST, True), ("a.pdf", store.LARGEST + 1, False), ("a.pdf.exe", 5, False)]
    rows = spark.createDataFrame(files, "name string, length long, wanted boolean")
    assert rows.where(store.acceptable(F.col("name"), F.col("length")) != F.col("wanted")).count() == 0


def test_write_results(spark, tmp_path):
    path = str(tmp_path / "results")
    for n in (3, 2):  # the second run replaces the first
        store.write_results(spark.range(n).select("id", F.lit("é").alias("text")), path)
    found = [json.loads(line) for f in (tmp_path / "results").glob("part-*") for line in f.read_text("utf-8").splitlines()]
    assert sorted(r["id"] for r in found) == [0, 1] and {r["text"] for r in found} == {"é"}


def test_prompt_lines():
    lines = registry.prompt_lines()
    asked = [m for m in registry.METRICS if m.queryable and not m.derived]
    assert len(lines) == len(asked) > 0 and all(f'"{m.name}"' in x and m.said in x for m, x in zip(asked, lines, strict=True))
    assert not {m.name for m in registry.METRICS if m.derived} & {x.split('"')[1] for x in lines}


def test_contradictions_block(spark):
    rows = [("q", "direction", "revenue", -4.5, None, "high", 0), ("q", "magnitude", "revenue", 1000.0, 12.34, "medium", 1), ("r", "direction", "pat", 3.0, None, "high", 0)]
    flags = spark.createDataFrame(rows, "query_id string, kind string, metric string, value double, delta_pct double, severity string, severity_rank int")
    out = {r["query_id"]: r["block"] for r in answer.contradictions_block(flags).collect()}
    assert "negative revenue trend (-4.50%). (severity: high)" in out["q"] and "+12.3% from the verified revenue value" in out["q"]
    assert out["q"].index("severity: high") < out["q"].index("severity: medium")
    assert "positive pat trend (+3.00%)" in out["r"] and "medium" not in out["r"]


def test_flags_of_two_questions_that_share_a_chunk_stay_apart(spark):
    text = "Revenue declined to Rs. 500 crore"
    hits = spark.createDataFrame([(1, "c", text), (2, "c", text), (3, "c", text)], "query_id int, chunk_id string, text string")
    verified = spark.createDataFrame([(1, 1000.0, 5.0), (2, 500.0, -5.0)], "query_id int, verified double, yoy_pct double")
    sizes, ways = router.cross_examine(hits, verified)
    assert [(r["query_id"], r["claim"]) for r in sizes.collect()] == [(1, 500.0)]
    assert [r["query_id"] for r in ways.collect()] == [1]
    assert sorted((r["query_id"], r["kind"]) for r in contradictions.all_flags(sizes, ways).collect()) == [(1, "direction"), (1, "magnitude")]


def test_a_file_of_two_tenants_gives_each_its_chunks(spark):
    from ledgerloom.operators import chunks

    pieces = spark.createDataFrame([("f", 1, "text", 0, "words", "c1")], "doc string, page int, block string, position int, text string, chunk_id string")
    pages = spark.createDataFrame([("f", 1, "standalone")], "doc string, page int, financial_type string")
    files = spark.createDataFrame([("f", "t", "A", None), ("f", "u", "B", None), ("f", None, "C", None)], "doc string, tenant_id string, company string, filing_date date")
    got = chunks.described(pieces, pages, files).select("tenant_id", "company", "chunk_id").collect()
    assert set(map(tuple, got)) == {("t", "A", "c1"), ("u", "B", "c1"), (None, "C", "c1")} and len(got) == 3
