import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as T
from ledgerloom.plans import answer, evaluation, registry, session
from ledgerloom.sources import store


def test_filter_comes_before_ranking(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.0], "b"), (3, [0.8, 0.0], "b")], "chunk_id int, embedding array<double>, kind string")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r["chunk_id"] for r in T.dense(q, v.where("kind = 'b'"), k=1).collect()] == [2]
    assert T.dense(q, v, k=1).where("kind = 'b'" if "kind" in T.dense(q, v, k=1).columns else "chunk_id <> 1").count() == 0


def test_ties_go_to_the_smaller_id_and_odd_sizes_stay_out(spark):
    v = spark.createDataFrame([(2, [1.0]), (1, [1.0]), (3, [1.0, 1.0])], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0])], "query_id int, embedding array<double>")
    assert [r["chunk_id"] for r in T.dense(q, v, k=3).orderBy("rank").collect()] == [1, 2]


def test_bm25_and_rerank(spark):
    chunks = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "gamma")], "chunk_id int, text string")
    q = spark.createDataFrame([(1, "beta alpha"), (2, "nothing")], "query_id int, question string")
    hits = T.bm25(q, chunks)
    assert [(r["query_id"], r["chunk_id"]) for r in hits.orderBy("rank").collect()] == [(1, 1), (1, 2)]
    assert [(r["chunk_id"], r["score"]) for r in T.rerank(hits, q, chunks).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]


def test_fusion_ignores_the_order_of_legs(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id int, rank int")
    one, two = (sorted(map(tuple, T.fuse(x).collect())) for x in ([a, b], [b, a]))
    assert one == two and min(one, key=lambda r: r[3])[1] == 11


def test_broadening_replaces(spark):
    levels = [spark.createDataFrame(list(zip(range(4), t)), "query_id int, tier string") for t in (["high", "medium", "low", "low"], ["low", "low", "low", "medium"], ["low", "high", "high", "low"])]
    got = {r["query_id"]: (r["level"], r["tier"], r["refused"]) for r in T.broadened(levels).collect()}
    assert got == {0: (0, "high", False), 1: (1, "low", True), 2: (2, "high", False), 3: (1, "medium", False)}


def test_tenants(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tenant_id string, x int")
    assert [r["x"] for r in session.TenantSession(spark, "a").own(rows).collect()] == [1]
    assert session.TenantSession(spark, None).own(rows).count() == 0
    assert session.TenantSession(spark, None).users(rows).count() == 3
    session.TenantSession(spark, "a", "admin").require("analyst")
    with pytest.raises(PermissionError):
        session.TenantSession(spark, "a").require("analyst")


def test_roles(spark):
    row = spark.range(1).select(F.lit("q").alias("query"), F.lit(0.5).alias("confidence_score"), F.lit(3).alias("latency_ms"), F.array(F.struct(*(F.lit(1).alias(c) for c in [*session.VIEWER_CITATION, "reranker_score"]))).alias("citations"))
    assert session.for_role(row, "viewer").columns == ["query", "citations"]
    assert "reranker_score" not in session.for_role(row, "viewer").first()["citations"][0].asDict()
    assert "latency_ms" not in session.for_role(row, "analyst").columns
    assert "latency_ms" in session.for_role(row, "admin").columns


def test_visible(spark):
    rows = spark.createDataFrame([(1, True, "t", "unknown"), (2, True, "t", "standalone"), (3, False, "t", "unknown"), (4, True, "u", "unknown")], "chunk_id int, is_latest boolean, tenant_id string, financial_type string")
    assert [r["chunk_id"] for r in T.visible(rows, "t", "consolidated").collect()] == [1]
    assert T.visible(rows, None).count() == 0


def test_companies_and_parents(spark):
    rows = spark.createDataFrame([("Zomato",), ("about one97 here",), ("nobody",)], "name string")
    got = {r["name"]: r["ticker"] for r in registry.resolve_company(rows, registry.company_aliases(spark)).collect()}
    assert got == {"Zomato": "ETERNAL", "about one97 here": "PAYTM", "nobody": None}


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("x", "old"), ("y", "old")], "chunk_id string, text string")
    b = spark.createDataFrame([("x", "new")], "chunk_id string, text string")
    assert {r["chunk_id"]: r["text"] for r in store.upsert_chunks(a, b).collect()} == {"x": "new", "y": "old"}
    known = spark.createDataFrame([("d1", "1")], "digest string, doc_id string")
    new = spark.createDataFrame([("d1", "2"), ("d2", "3")], "digest string, doc_id string")
    assert {r["digest"]: r["doc_id"] for r in store.register_documents(known, new).collect()} == {"d1": "1", "d2": "3"}
    (tmp_path / "a.pdf").write_bytes(b"hello")
    assert store.read_files(spark, str(tmp_path)).first()["length"] == 5
    store.append_audit(spark.createDataFrame([("q" * 600,)], "query_text string"), str(tmp_path / "audit"))
    assert len(spark.read.parquet(str(tmp_path / "audit")).first()["query_text"]) == 500
    assert store.read_sql(spark, "select * from {facts} where chunk_id = :id", a, id="x").count() == 1
    docs = spark.createDataFrame([(1, "pending"), (2, "pending")], "doc_id int, ingestion_state string")
    assert {r["doc_id"]: r["ingestion_state"] for r in store.set_state(docs, docs.where("doc_id = 1"), "indexed").collect()} == {1: "indexed", 2: "pending"}


def test_evaluation(spark):
    rows = spark.createDataFrame([("point", True), ("point", False), ("yoy", True)], "category string, passed boolean")
    assert {r["category"]: (r["n"], r["n_passed"]) for r in evaluation.report(rows).collect()} == {"point": (2, 1), "yoy": (1, 1), "all": (3, 2)}


def test_excerpts(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, rank int, text string")
    assert answer.excerpts(rows).first()["citations"] == "[1] a\n[2] b"


def test_dense_makes_no_pairs_and_keeps_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [[nan, 1.0], [inf, 1.0], [-inf, 0.0], [None, 1.0], [1e300, 1e300], [0.0, -0.0], None, [1.0], []]
    rows = odd + [[(i * 7 % 11) / 10, (i * 5 % 13) / 10] for i in range(60)] + [[0.3, 0.4]] * 30
    v = spark.createDataFrame(list(enumerate(rows)), "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, r) for i, r in enumerate(rows) if i % 2 == 0 or i < 9], "query_id int, embedding array<double>")
    pairs = v.join(q.withColumnRenamed("embedding", "asked"), F.size("embedding") == F.size("asked"))
    for k in (1, 5, 200):
        plain = T.ranked(pairs.select("query_id", "chunk_id", T.dot(F.col("embedding"), F.col("asked")).alias("score")), k)
        ours = T.dense(q, v, k)
        assert "Join" not in ours._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, ours.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_dense_gives_a_task_s_best_alone(spark):
    from ledgerloom.operators import nearest

    v = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array((F.col("id") % 1000).cast("float"), F.lit(1).cast("float")).alias("embedding")).coalesce(1).toArrow()
    ids, vectors = (v.column(c).combine_chunks() for c in ("chunk_id", "embedding"))
    (out,) = nearest.scan(ids[:40], vectors[:40], 3)(iter(v.to_batches(max_chunksize=500)))
    assert out.num_rows == 40 * 3
    assert [r for r in out.to_pylist() if r["query_id"] == 2] == [{"query_id": 2, "chunk_id": c, "score": 2.0 * 999 + 1} for c in (999, 1999, 2999)]


def test_bm25_makes_no_pairs(spark, monkeypatch):
    texts = ["", None, "Alpha beta beta", "alpha", "gamma delta alpha", "beta-beta alpha", *(["delta gamma"] * 40)]
    chunks = spark.createDataFrame([*enumerate(texts), (3, "beta")], "chunk_id bigint, text string")
    q = spark.createDataFrame([(1, "beta alpha beta"), (2, "nothing"), (3, ""), (4, None), (5, "gamma"), (6, "delta alpha")], "query_id int, question string")
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")
    tokens = chunks.select("chunk_id", split("text").alias("t")).withColumn("n", F.greatest(F.size("t"), F.lit(0)))
    n, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    found = tokens.select("chunk_id", "n", F.explode("t").alias("term")).groupBy("chunk_id", "n", "term").agg(F.count("*").alias("tf"))
    idf = found.groupBy("term").agg(F.log(1 + (n - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    asked = q.select("query_id", F.explode(split("question")).alias("term")).distinct()
    scores = found.join(idf, "term").join(asked, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / mean))), 6).alias("score"))
    for words in (T.WORDS, 3):
        monkeypatch.setattr(T, "WORDS", words)
        for k in (2, 100):
            ours = T.bm25(q, chunks, k)
            assert not any("Aggregate" in x and "query_id" in x for x in ours._jdf.queryExecution().optimizedPlan().toString().split("\n"))
            assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, T.ranked(scores, k).collect()))
