"""PDF files as a Spark data source: partitions are ranges of pages, and only asked-for columns cost work.

    pages = pdfpages.read(spark, "/filings", columns=("doc", "page", "content"), pages=(1, 2))

A file is cut by its size into slices, and slice j of n holds the pages whose place falls into the
j-th of n equal ranges, so planning lists files and opens none; small files share a partition.  A
page that cannot be read is a row with its number and ``error``; a file that cannot be opened is one
row without a page.  Failing storage is not caught: it fails the task, which Spark runs again.

Options: ``path`` (a file or folder of any file system that pyarrow opens), ``slice_bytes``,
``max_bytes`` (larger files are told as errors, none by default), ``first`` and ``last`` page,
``reader`` (``module:name`` of what makes a document, with ``len`` and ``page``, of an open file).
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "doc string, page int, content string, ruled boolean, words array<struct<text:string,x0:double,x1:double,top:double>>, error string"
READER = "ledgerloom.sources.plainpdf:Document"
#: Bytes of a slice of a file and of a partition of small files; what opening a file counts.
SLICE, OPENING = 16 << 20, 1 << 16


@dataclass
class Slices(InputPartition):
    """Slices (file, which, of how many, bytes of the file) that one task reads."""

    files: list[tuple[str, int, int, int]]

    def __init__(self, files: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.files = files


def sliced(files: list[tuple[str, int]], size: int, limit: int | None = None) -> list[Slices]:
    """Files (path, bytes) as partitions of about ``size`` bytes.  Files over ``limit`` are not opened, so they weigh nothing."""
    out: list[Slices] = []
    held, weight = [], 0
    for path, n in sorted(files):
        parts = 1 if limit is not None and n > limit else max(1, -(-n // size))
        if parts > 1:
            out += [Slices([(path, j, parts, n)]) for j in range(parts)]
            continue
        cost = OPENING + (0 if limit is not None and n > limit else n)
        if held and weight + cost > size:
            out.append(Slices(held))
            held, weight = [], 0
        held.append((path, 0, 1, n))
        weight += cost
    return out + ([Slices(held)] if held else [])


def range_of(j: int, parts: int, pages: int, first: int = 1, last: int | None = None) -> range:
    """Places (from 0) of slice ``j`` among those from page ``first`` to ``last``: each page is in exactly one slice."""
    low, high = j * pages // parts, (j + 1) * pages // parts
    return range(max(low, first - 1), min(high, pages if last is None else last))


class PdfReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict):
        self.columns, self.path = columns, options["path"]
        self.size = int(options.get("slice_bytes", SLICE))
        self.limit = int(options["max_bytes"]) if "max_bytes" in options else None
        self.first = int(options.get("first", 1))
        self.last = int(options["last"]) if "last" in options else None
        self.reader = options.get("reader", READER)

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Slices]:
        from pyarrow import fs

        system, path = self._system()
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".pdf")]
        return sliced([(f.path, f.size) for f in files], self.size, self.limit) or [Slices([])]

    def read(self, partition: Slices) -> Iterator[tuple]:
        module, name = self.reader.split(":")
        document, (system, _) = getattr(importlib.import_module(module), name), self._system()
        for path, j, parts, size in partition.files:
            if self.limit is not None and size > self.limit:
                yield self._row(doc=path, error=f"larger than {self.limit} bytes")
                continue
            with system.open_input_file(path) as file:
                try:
                    opened = document(file)
                    places = range_of(j, parts, len(opened), self.first, self.last)
                except (OSError, ImportError, MemoryError):  # no fault of the file
                    raise
                except Exception as e:  # readers have errors of their own for broken files
                    if j == 0:
                        yield self._row(doc=path, error=f"{type(e).__name__}: {e}")
                    continue
                for i in places:
                    yield self._page(path, opened, i)

    def _page(self, path: str, opened, i: int) -> tuple:
        if not {"content", "ruled", "words", "error"} & set(self.columns):
            return self._row(doc=path, page=i + 1)
        try:
            p = opened.page(i)
        except (OSError, ImportError, MemoryError):
            raise
        except Exception as e:
            return self._row(doc=path, page=i + 1, error=f"{type(e).__name__}: {e}")
        words = [tuple(w) for w in p.words] if "words" in self.columns else None
        return self._row(doc=path, page=i + 1, content=p.text, ruled=p.ruled, words=words)

    def _row(self, **values) -> tuple:
        return tuple(values.get(c) for c in self.columns)


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(schema.fieldNames(), dict(self.options))


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = (), pages: tuple[int, int] | None = None, **options) -> DataFrame:
    """Pages of the PDF files under ``path``: ``columns`` of ``SCHEMA`` (all by default) of ``pages`` (first, last).

    Columns that are not asked for are not made: without text, words and errors no page is read, only counted.
    """
    spark.dataSource.register(PdfPages)
    whole = StructType.fromDDL(SCHEMA)
    made = spark.read.format("pdf_pages").schema(StructType([whole[c] for c in columns or whole.fieldNames()])).options(**options)
    if pages:
        made = made.options(first=pages[0], last=pages[1])
    return made.load(path)
