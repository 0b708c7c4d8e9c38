import io
import zlib

import pytest

from ledgerloom.sources import pdf, pdfpages, plainpdf


def make(pages, squeeze=True, broken=(), grid=()):
    """A PDF file of pages of (x, y, text), two levels of page tree; streams of ``broken`` pages are cut."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /Widths [" + b"600 " * 95 + b"] >>"}
    halves = [list(range(0, len(pages), 2)), list(range(1, len(pages), 2))]
    order = [i for h in halves for i in h]
    objects[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> /Kids [4 0 R 5 0 R] >>" % len(pages)
    for n, half in zip((4, 5), halves, strict=True):
        objects[n] = b"<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] >>" % (len(half), b" ".join(b"%d 0 R" % (10 + 3 * i) for i in half))
    for at, i in enumerate(order):
        body = b"BT /F1 10 Tf " + b" ".join(b"1 0 0 1 %d %d Tm (%s) Tj" % (x, y, t.encode("cp1252").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")) for x, y, t in pages[at]) + b" ET"
        if at in grid:
            body += b" 0 0 9 9 re 9 9 9 9 re 0 9 9 9 re 9 0 9 9 re S"
        data = zlib.compress(body) if squeeze else body
        data = data[: len(data) // 2] if at in broken else data
        objects[10 + 3 * i] = b"<< /Type /Page /Contents [%d 0 R] >>" % (11 + 3 * i)
        objects[11 + 3 * i] = b"<< /Length %d 0 R%s >>\nstream\n" % (12 + 3 * i, b" /Filter /FlateDecode" if squeeze else b"") + data + b"\nendstream"
        objects[12 + 3 * i] = b"%d" % len(data)
    out, where = b"%PDF-1.4\n", {}
    for n, body in objects.items():
        where[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in where.items())
    return out + table + b"trailer << /Size 99 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(out)


def said(i):
    return [(50, 700, f"Total (income) {i}"), (300, 700, "1,5\\0"), (50, 680, "café")]


@pytest.mark.parametrize("squeeze", [True, False])
def test_reader(squeeze):
    found = plainpdf.Document(io.BytesIO(make([said(i) for i in range(5)], squeeze, grid=(3,))))
    assert len(found) == 5
    assert [found.page(i).text for i in (4, 0)] == ["Total (income) 4 1,5\\0\ncafé", "Total (income) 0 1,5\\0\ncafé"]
    assert [found.page(i).ruled for i in range(5)] == [False, False, False, True, False]
    assert found.page(0).words[0] == ("Total", 50.0, 80.0, 90.0) and found.page(0).words[3][:2] == ("1,5\\0", 300.0)
    with pytest.raises(ValueError):
        found.page(5)


@pytest.mark.parametrize("data", [b"", b"no pdf", b"startxref 5", make([said(0)])[:-300], b"%PDF startxref\n99999\n"])
def test_broken_files(data):
    with pytest.raises((ValueError, StopIteration)):
        plainpdf.Document(io.BytesIO(data))


def test_slices():
    parts = pdfpages.sliced([("b", 10), ("a", 100), ("c", 3)], 40)
    assert [p.files for p in parts] == [[("a", j, 3, 100)] for j in range(3)] + [[("b", 0, 1, 10)], [("c", 0, 1, 3)]]
    assert len(pdfpages.sliced([(f"{i:03}", 5) for i in range(100)], 1 << 20)) == 7
    assert [p.files for p in pdfpages.sliced([("a", 100)], 40, 50)] == [[("a", 0, 1, 100)]]
    for pages in (0, 1, 2, 7, 100):
        for n in (1, 3, 9):
            assert sorted(i for j in range(n) for i in pdfpages.range_of(j, n, pages)) == list(range(pages))
            assert sorted(i for j in range(n) for i in pdfpages.range_of(j, n, pages, 2, 3)) == [i for i in (1, 2) if i < pages]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(make([said(i) for i in range(9)], broken=(4,)))
    (tmp_path / "sub" / "b.PDF").write_bytes(make([said(7)], squeeze=False))
    (tmp_path / "c.pdf").write_bytes(b"no pdf at all")
    (tmp_path / "d.txt").write_bytes(b"no matter")
    rows = pdfpages.read(spark, str(tmp_path), slice_bytes=1000)
    # One file is many tasks, yet each page is read once, and a broken page costs itself alone.
    assert rows.rdd.getNumPartitions() > 4
    got = sorted((r["doc"].rsplit("/", 1)[1], r["page"] or 0, r["content"], bool(r["error"])) for r in rows.collect())
    text = lambda i: f"Total (income) {i} 1,5\\0\ncafé"
    assert got == [*(("a.pdf", i + 1, None if i == 4 else text(i), i == 4) for i in range(9)), ("b.PDF", 1, text(7), False), ("c.pdf", 0, None, True)]
    first = pdfpages.read(spark, str(tmp_path), columns=("page", "doc"), pages=(1, 2), slice_bytes=1000)
    assert first.columns == ["page", "doc"] and first.where("page is not null").count() == 3
    assert pdfpages.read(spark, str(tmp_path / "a.pdf"), max_bytes=100).select("page", "error").collect()[0]["error"] == "larger than 100 bytes"
    placed = pdf.placed_words(pdfpages.read(spark, str(tmp_path / "sub"))).orderBy("ord").collect()
    assert [r["text"] for r in placed] == ["Total", "(income)", "7", "1,5\\0", "café"]


def test_columns_that_are_not_asked_for_are_not_made(tmp_path):
    (tmp_path / "a.pdf").write_bytes(make([said(i) for i in range(3)], broken=(0, 1, 2)))
    reader = pdfpages.PdfReader(["doc", "page"], {"path": str(tmp_path)})
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [1, 2, 3]
    (tmp_path / "none").mkdir()
    reader = pdfpages.PdfReader(["doc"], {"path": str(tmp_path / "none")})
    assert [r for p in reader.partitions() for r in reader.read(p)] == []


def test_storage_that_fails_fails_the_task(tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(make([said(0)]))
    reader = pdfpages.PdfReader(["content"], {"path": str(tmp_path)})

    def gone(*_):
        raise OSError("gone")

    monkeypatch.setattr(plainpdf.Document, "page", gone)
    with pytest.raises(OSError):
        [list(reader.read(p)) for p in reader.partitions()]
