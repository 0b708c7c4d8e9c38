from ledgerloom.sources import pdf


def test_scan(spark):
    def reader(content):
        if content == b"broken":
            raise ValueError("no document")
        return [pdf.Page("Total income", False, [("Total", 0.0, 9.0, 1.0), ("5", 20.0, 30.0, 1.0)]), pdf.Page("plain"), pdf.Page("ruled", True)]

    files = spark.createDataFrame([("d1", bytearray(b"x")), ("d2", bytearray(b"broken"))], "digest string, content binary")
    pages = pdf.scan(files, reader)
    assert [(r["page"], r["kind"]) for r in pdf.page_blocks(pages).orderBy("page").collect()] == [(1, "table"), (2, "text"), (3, "table")]
    assert [tuple(r)[2:] for r in pdf.placed_words(pages).orderBy("ord").collect()] == [(0, "Total", 0.0, 9.0, 1.0), (1, "5", 20.0, 30.0, 1.0)]
