from pyspark.sql import functions as F

from ledgerloom.operators import layout, pages


def book(spark, *contents):
    rows = [(1, i + 1, c, "table" if t else "text") for i, (t, c) in enumerate(contents)]
    return spark.createDataFrame(rows, "doc int, page int, content string, kind string")


def spans(spark, *contents):
    return sorted(tuple(r)[1:] for r in pages.sections(book(spark, *contents)).collect())


STAND, CONS = (1, "Standalone balance sheet"), (1, "Consolidated balance sheet")


def test_sections(spark):
    assert spans(spark, (0, "x"), (0, "Standalone balance sheet")) == [("consolidated", 1, 2)]
    assert spans(spark, (0, "x"), STAND) == [("standalone", 1, 2)]
    assert spans(spark, CONS, (1, "x"), STAND) == [("consolidated", 1, 2), ("standalone", 3, 3)]
    assert spans(spark, STAND, CONS, (1, "x")) == [("consolidated", 2, 3), ("standalone", 1, 1)]
    assert spans(spark, (1, "standalone balance sheet, consolidated balance sheet")) == [("consolidated", 1, 1)]


def blocks(spark, *contents):
    rows = book(spark, *contents)
    got = pages.classify(pages.place(rows, pages.sections(rows))).orderBy("page").collect()
    return [(r["block"], r["financial_type"]) for r in got]


FS, TABLE = ("financial_statement", "consolidated"), ("table", "unknown")


def test_statement_and_continuation(spark):
    follow = (1, "Particulars tax profit")
    got = blocks(spark, (1, "Statement of consolidated results. Particulars"), follow, follow, follow, follow, follow, (1, "other"))
    assert got == [FS] * 5 + [TABLE] * 2  # four pages at most


def test_auditor_vetoes_risk_but_not_titles(spark):
    got = blocks(spark, (1, "Independent auditor. Consolidated balance sheet. Particulars"), (1, "going concern and litigation"), (1, "Consolidated balance sheet. Particulars"), (0, "going concern and litigation"))
    assert got == [TABLE, TABLE, FS, ("text", "unknown")]


def test_risk_discussion_text(spark):
    assert [b for b, _ in blocks(spark, (0, "going concern and litigation"), (0, "our performance, unit economics"), (0, "plain"), (0, "A. Income and more"))] == ["risk_disclosure", "management_discussion", "text", "management_discussion"]


def test_overlapping_sections_later_wins(spark):
    rows = book(spark, (0, "a"), (0, "b"))
    given = spark.createDataFrame([(1, "standalone", 1, 2), (1, "consolidated", 2, 2)], "doc int, financial_type string, page_start int, page_end int")
    assert [r["section"] for r in pages.place(rows, given).orderBy("page").collect()] == ["standalone", "consolidated"]


def test_first_pages(spark):
    rows = book(spark, (0, "a"), (0, "b"), (0, "c"))
    assert pages.first_pages(rows).first()["text"] == "a\nb"
    assert pages.page_counts(rows).first()["pages"] == 3


def words(spark, *rows):
    return spark.createDataFrame([(1, 1, i, t, float(x0), float(x1), float(top)) for i, (t, x0, x1, top) in enumerate(rows)], "doc int, page int, ord int, text string, x0 double, x1 double, top double")


def test_rows_join_the_first_anchor(spark):
    got = layout.rows_of_words(words(spark, ("a", 0, 1, 10), ("b", 2, 3, 13), ("c", 4, 5, 15), ("d", 6, 7, 12)))
    assert [r["row"] for r in got.orderBy("ord").collect()] == [0, 0, 1, 0]


def test_fragments(spark):
    rows = words(spark, ("2", 0, 4, 1), ("716", 10, 20, 1), ("705", 60, 70, 1)).withColumn("row", F.lit(0))
    assert [r["cluster"] for r in layout.fragments(rows).orderBy("ord").collect()] == [0, 0, 1]


def test_columns(spark):
    assert layout.assign([100.0, 103.0], [102.0], 10.0) == {1: 0}
    assert layout.assign([10.0, 50.0], [12.0, 48.0], 1.0) == {}
    rows = spark.createDataFrame([([10.0, 52.0], [12.0, 50.0])], "centres array<double>, columns array<double>")
    got = layout.columns_of_clusters(rows.withColumn("tolerance", layout.column_tolerance(F.col("columns")))).first()
    assert got["placed"] == [0, 1] and round(got["tolerance"], 2) == 18.05


def test_headers_latch_and_records(spark):
    assert spark.range(1).select(layout.spaced(F.array(*map(F.lit, [5.0, 0.0, 21.0, 30.0, 45.0])))).first()[0] == [0.0, 21.0, 45.0]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["head", "Sale of x", "tail"])], "doc int, page int, ord int, text string")
    assert [r["text"] for r in layout.from_first_figure(lines).orderBy("ord").collect()] == ["Sale of x", "tail"]
    rows = spark.createDataFrame([("l", [9.0, 1.0, None], [(2024, "Q1"), (2023, None)])], "label string, values array<double>, periods array<struct<fiscal_year:int,quarter:string>>")
    assert [(r["fiscal_year"], r["quarter"], r["value"]) for r in layout.records(rows).collect()] == [(2024, "Q1", 1.0)]


def test_chunks_are_given_away_in_small_batches(spark, monkeypatch):
    from ledgerloom.operators import chunks as C

    monkeypatch.setattr(C, "GIVEN", 2000)
    rows = spark.createDataFrame([(1, i, "text", "ab cd. " * 300) for i in range(20)] + [(2, 0, None, None), (2, 1, "table", "x" * 3000)], "doc bigint, page int, block string, content string")
    cuts, plain = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, cut, kind: cuts.append(cut) or plain(self, cut, kind))
    found = C.recursive_chunks(rows).collect()
    assert {(r["page"], r["position"], r["text"]) for r in found if r["doc"] == 1} == {(p, i, t) for p in range(20) for i, t in enumerate(C.split("ab cd. " * 300, 800))}
    assert [r["text"] for r in found if r["doc"] == 2] == ["x" * 3000]
    given = list(cuts[0](iter(rows.toArrow().combine_chunks().to_batches())))
    assert len(given) >= 20 and max(b.num_rows for b in given) < 20
