"""Pages and words of documents.

A reader turns the bytes of one file into pages; any will do, so formats and libraries stay outside
the plan.  ``plumber`` is one for PDF files where that library is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.rules import looks_tabular


class Page(NamedTuple):
    text: str
    ruled: bool = False
    words: list[tuple[str, float, float, float]] = []  # text, x0, x1, top


Reader = Callable[[bytes], list[Page]]


def plumber(content: bytes) -> list[Page]:
    """Pages of a PDF file, with ruled tables and placed words."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [Page(p.extract_text() or "", bool(p.find_tables()), [(w["text"], w["x0"], w["x1"], w["top"]) for w in p.extract_words()]) for p in pdf.pages]


def scan(files: DataFrame, reader: Reader = plumber) -> DataFrame:
    """doc (digest), page, content, ruled, words of every page; ``files`` has digest and content.

    One file is one unit of work; a file that cannot be read gives no pages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files_ in batches:
            for digest, content in zip(files_["digest"], files_["content"], strict=True):
                try:
                    found = reader(bytes(content))
                except (ImportError, MemoryError):  # no fault of the file
                    raise
                except Exception:  # readers have errors of their own for broken files
                    found = []
                yield pd.DataFrame([(digest, i + 1, p.text, p.ruled, [dict(zip(("text", "x0", "x1", "top"), w, strict=True)) for w in p.words]) for i, p in enumerate(found)], columns=["doc", "page", "content", "ruled", "words"])

    return files.select("digest", "content").mapInPandas(run, "doc string, page int, content string, ruled boolean, words array<struct<text:string,x0:double,x1:double,top:double>>")


def page_blocks(scanned: DataFrame) -> DataFrame:
    """doc, page, content, kind: a page is a table by its rules, its dates or its words."""
    kind = F.when(looks_tabular(F.col("content"), F.col("ruled")), "table").otherwise("text")
    return scanned.select("doc", "page", "content", kind.alias("kind"))


def placed_words(scanned: DataFrame) -> DataFrame:
    """doc, page, ord, text, x0, x1, top."""
    return scanned.select("doc", "page", F.posexplode("words").alias("ord", "w")).select("doc", "page", "ord", "w.*")
