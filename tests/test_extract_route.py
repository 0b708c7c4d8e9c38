from ledgerloom.operators import encode, extract
from ledgerloom.operators.extract import Period, Word, columns_of, rows_of_figures
from ledgerloom.plans import router
from ledgerloom.sources import ingest
from pyspark.sql import functions as F


def parsed(spark, *lines):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").orderBy("i").select(extract.parse_line(F.col("t")).alias("p")).collect()
    return [None if r["p"] is None else (r["p"]["description"], r["p"]["values"]) for r in rows]


def test_lines(spark):
    got = parsed(spark, "II Revenue from operations (refer note 3) 1,234 (56) -", "Total incomc 2 716 17.634", "only one 5", "7 8", "", "Sales I 234 99")
    assert got == [("Revenue from operations", [1234.0, -56.0, 0.0]), ("Total income", [2716.0, 17634.0]), None, None, None, ("Sales", [1234.0, 99.0])]


def at(x, top, *texts):
    """Words of one row, each 20 points wide, with right edges at the given places."""
    return [Word(t, e - 20, e, top) for t, e in zip(texts, x, strict=True)]


def test_headers():
    assert columns_of(at([100, 200], 50, "31.03.2026", "31.03.2025")) == [Period(100, 2026, None), Period(200, 2025, None)]
    five = columns_of(at([100, 200, 300, 400, 500], 50, "30.06.2025", "31.03.2025", "30.06.2024", "31.03.2026", "31.03.2025"))
    assert [p[1:] for p in five] == [(2026, "Q1"), (2025, "Q4"), (2025, "Q1"), (2026, None), (2025, None)]
    named = [Word("March", 80, 100, 50), Word("31,", 102, 110, 50), Word("2026", 112, 130, 50), Word("March", 180, 200, 50), Word("31,", 202, 210, 50), Word("2025", 212, 230, 50)]
    assert [p[1:] for p in columns_of(named)] == [(2026, None), (2025, None)]
    assert [p[1:] for p in columns_of(at([100, 200], 50, "2026", "2026"))] == [(2026, None), (2025, None)]
    four = columns_of([Word("June", 80, 100, 40), *at([100, 200, 300, 400], 50, "2025", "2025", "2024", "2025")])
    assert [p[1:] for p in four] == [(2026, "Q1"), (2025, "Q4"), (2025, "Q1"), (2026, None)]
    assert columns_of(at([100], 50, "word")) == []


COLUMNS = [Period(100, 2026, None), Period(200, 2025, None)]


def row(top, label, *figures):
    return [Word(label, 0, 30, top), *(Word(t, a, b, top) for t, a, b in figures)]


def test_rows_of_figures():
    words = row(1, "Head", ("1", 90, 100), ("2", 190, 200)) + row(10, "Revenue", ("2", 84, 88), ("716", 92, 100), ("705", 190, 200))
    words += row(20, "Exceptional", ("(186)", 180, 196), ("823", 188 + 30, 204 + 26))  # both nearest to one column
    words += row(30, "Tax", ("I", 84, 86), ("234", 88, 100), ("1,5", 190, 200)) + row(40, "One", ("5", 90, 100))
    assert rows_of_figures(words, COLUMNS) == [("Revenue", ["2716", "705"]), ("Tax", ["1234", "1,5"])]


def test_document_to_facts(spark):
    rows, n = [], 0
    for top, label, a, b in ((50, "", "31.03.2026", "31.03.2025"), (70, "Revenue", "100", "90"), (80, "Other income", "5", "4"), (90, "Total income", "105", "94"), (95, "iv", "1", "1"), (100, "Revenue", "7", "7")):
        for text, x in ((label, 30.0), (a, 100.0), (b, 200.0)):
            if text:
                rows.append((1, 1, n, text, x - 20, x, float(top)))
                n += 1
    words = spark.createDataFrame(rows, "doc int, page int, ord int, text string, x0 double, x1 double, top double")
    raw = spark.createDataFrame([(1, 1, "Consolidated balance sheet. Particulars", "table"), (1, 2, "plain words " * 30, "text")], "doc int, page int, content string, kind string")
    docs = spark.createDataFrame([(1, "t", "A", None)], "doc int, tenant_id string, company string, filing_date date")
    pages = ingest.classify_pages(raw)
    facts = ingest.facts_of(pages, words, docs)
    got = {(r["metric"], r["fiscal_year"]): float(r["value"]) for r in ingest.checked(facts).collect()}
    assert got == {("revenue", 2026): 100.0, ("revenue", 2025): 90.0, ("other_income", 2026): 5.0, ("other_income", 2025): 4.0, ("total_income", 2026): 105.0, ("total_income", 2025): 94.0}
    assert ingest.chunks_of(pages).count() == 2 - 1  # the statement is under 50 characters


def test_routes():
    raw = {"path": "Quantitative", "company": "One97 Communications", "fiscal_year": " fy26 ", "quarter": "q4 fy26", "financial_type": "both"}
    route = router.normalise(raw)
    assert route == router.Route("quantitative", "PAYTM", "FY26", "Q4", "consolidated")
    assert route.resolved("how much?") == "PAYTM FY26 Q4 consolidated how much?"
    assert router.normalise({"company": "null", "quarter": "null"}) == router.Route("semantic", None, None, None, "consolidated")
    forced = router.normalise(raw, {"enforce_path": True, "intended_path": "cross", "intended_operation": "cagr"})
    assert (forced.path, forced.operation) == ("cross", "cagr")
    assert router.company_of("Blinkit") == "ETERNAL" and router.company_of("nobody") is None


def test_retrieve_and_cross_examine(spark):
    chunks = encode.dense(spark.createDataFrame([(1, "revenue grew to 130 crore"), (2, "other words"), (3, "")], "chunk_id int, text string"))
    assert chunks.where("chunk_id = 3").first()["embedding"] == [0.0] * 64
    queries = encode.dense(spark.createDataFrame([(9, "revenue grew")], "query_id int, question string"), text="question")
    hits = router.retrieve(queries, chunks)
    assert hits.where("rank = 1").first()["chunk_id"] == 1 and router.retrieve(queries, chunks, skip_rerank=True).count() == 3
    told = hits.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "text")
    verified = spark.createDataFrame([(9, 100.0, -3.0)], "query_id int, verified double, yoy_pct double")
    claims, directions = router.cross_examine(told, verified)
    assert [r["severity"] for r in claims.collect()] == ["high"] and [r["said"] for r in directions.collect()] == ["positive"]
    assert encode.sparse(chunks).where("chunk_id = 2").first()["weights"].keys() == {"other", "words"}
    assert encode.needs_vectors(chunks, 32).count() == 3


def test_vectors_hold_words_far_into_a_text(spark, tmp_path):
    from ledgerloom import catalog

    long = "word " * 200
    spark.createDataFrame([(1, long), (2, long + "other " * 200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["embedding"] for r in catalog.queries()["hashed_vectors"](spark, str(tmp_path)).collect()}
    assert got[1] != got[2]


def test_one_bad_document_does_not_stop_the_others(spark, tmp_path):
    from ledgerloom.sources import store

    rows = []
    for doc, total in ((1, "105"), (2, "150")):
        n = 0
        for top, label, a, b in ((50, "", "31.03.2026", "31.03.2025"), (70, "Revenue", "100", "90"), (80, "Other income", "5", "4"), (90, "Total income", total, "94")):
            for text, x in ((label, 30.0), (a, 100.0), (b, 200.0)):
                if text:
                    rows.append((doc, 1, n, text, x - 20, x, float(top)))
                    n += 1
    words = spark.createDataFrame(rows, "doc int, page int, ord int, text string, x0 double, x1 double, top double")
    raw = spark.createDataFrame([(d, p, t, k) for d in (1, 2) for p, t, k in ((1, "Consolidated balance sheet. Particulars", "table"), (2, "plain words " * 30, "text"))], "doc int, page int, content string, kind string")
    docs = spark.createDataFrame([(1, "t", "A", "2026-05-01"), (2, "u", "A", "2026-05-01")], "doc int, tenant_id string, company string, filed string").withColumn("filing_date", F.to_date("filed")).drop("filed")
    path = str(tmp_path / "facts")
    counts, chunks = ingest.ingest(raw, words, docs, path, 1)
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"inserted": 6, "errors": 6}
    assert [(r["doc_id"], r["tenant_id"], r["section"], r["is_latest"], r["page_number"]) for r in chunks.collect()] == [("1_consolidated", "t", "General", True, 2)]
    again, _ = ingest.ingest(raw, words, docs, path, 2)
    assert {r["outcome"]: r["n"] for r in again.collect()} == {"skipped": 6, "errors": 6}
    stored = store.read_facts(spark, path, "t")
    assert stored.count() == 6 and store.read_facts(spark, path, "u").count() == 0
    assert [r["metric"] for r in store.verify_facts(stored, "A", 2026, "consolidated").collect()] == ["other_income", "revenue", "total_income"]


def test_a_merge_leaves_other_partitions_alone(spark, tmp_path):
    import datetime as dt
    import os

    from ledgerloom.sources import store

    schema = "tenant_id string, company string, metric string, fiscal_year int, financial_type string, quarter string, doc_id string, filing_date date, seq int, value double"
    row = lambda year, doc, day, seq: ("t", "A", "revenue", year, "consolidated", None, doc, dt.date(2024, 1, day), seq, float(seq))
    path = str(tmp_path / "facts")
    store.merge_facts(spark.createDataFrame([row(2024, "a", 5, 1), row(2023, "a", 5, 1)], schema), path)
    before = sorted(os.listdir(f"{path}/tenant_id=t/fiscal_year=2023"))
    told = store.merge_facts(spark.createDataFrame([row(2024, "b", 9, 2)], schema), path)
    assert {r["outcome"]: r["n"] for r in told.collect()} == {"restated": 1}
    assert sorted(os.listdir(f"{path}/tenant_id=t/fiscal_year=2023")) == before
    assert {(r["fiscal_year"], r["doc_id"]) for r in store.read_facts(spark, path, "t").collect()} == {(2024, "b"), (2023, "a")}


def test_a_merge_keeps_versions_without_tenant_or_year(spark, tmp_path, monkeypatch):
    import datetime as dt

    from ledgerloom.sources import store

    schema = "tenant_id string, company string, metric string, fiscal_year int, financial_type string, quarter string, doc_id string, filing_date date, seq int, value double"
    row = lambda tenant, year, doc, seq: (tenant, "A", "revenue", year, "consolidated", None, doc, dt.date(2024, 1, seq), seq, float(seq))
    for named in (0, 1_000):  # by join alone, and with the partitions named to the scan
        monkeypatch.setattr(store, "NAMED", named)
        path = str(tmp_path / f"facts-{named}")
        store.merge_facts(spark.createDataFrame([row("t", None, "a", 1), row(None, 2024, "a", 1), row("t", 2024, "a", 1)], schema), path)
        told = store.merge_facts(spark.createDataFrame([row("t", None, "b", 2), row(None, 2024, "b", 2)], schema), path)
        assert {r["outcome"]: r["n"] for r in told.collect()} == {"restated": 2}
        stored = spark.read.schema(schema + ", is_latest boolean").parquet(path)
        assert sorted((r["tenant_id"] or "", r["fiscal_year"] or 0, r["doc_id"], r["is_latest"]) for r in stored.collect()) == [
            ("", 2024, "a", False), ("", 2024, "b", True), ("t", 0, "a", False), ("t", 0, "b", True), ("t", 2024, "a", True),
        ]
    assert store.merge_facts(spark.createDataFrame([], schema), path).count() == 0 and spark.read.parquet(path).count() == 5


def test_a_merge_reads_touched_partitions_only(spark, tmp_path):
    from ledgerloom.sources import store

    path, schema = str(tmp_path / "facts"), "metric string, tenant_id string, fiscal_year int"
    spark.createDataFrame([("m", "t", year) for year in range(2000, 2010)], schema).write.partitionBy("tenant_id", "fiscal_year").parquet(path)
    for year in set(range(2000, 2010)) - {2003}:  # unreadable, so that reading them fails
        for file in (tmp_path / f"facts/tenant_id=t/fiscal_year={year}").iterdir():
            file.write_bytes(b"junk") if file.suffix == ".parquet" else file.unlink()
    for file in (tmp_path / "facts/tenant_id=t").glob("fiscal_year=*/.*.crc"):
        file.unlink()
    held = store._beside(spark.read.schema(schema).parquet(path), spark.createDataFrame([("m", "t", 2003)], schema))
    assert [r["fiscal_year"] for r in held.collect()] == [2003]


def test_a_line_is_parsed_once(spark):
    plan = spark.range(1).select(extract.parse_line(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("refer note") == 1 and plan.count("array_max") <= 1
    rows = spark.createDataFrame([(None,), ("Totall l 5 6",), ("incomc TotaI 5 (6)",), ("3 4",), ("Sales 5",)], "t string")
    assert [r["p"] and tuple(r["p"]) for r in rows.select(extract.parse_line(F.col("t")).alias("p")).collect()] == [None, ("Totall I", [5.0, 6.0]), ("income Total", [5.0, -6.0]), None, None]
