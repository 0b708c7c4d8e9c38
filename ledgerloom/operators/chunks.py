"""Chunks of pages: recursive splitting with overlap, and ids that follow from content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Characters a token, tokens of a chunk by class (none: never split), overlap in characters, least characters of a chunk.
CHARS, OVERLAP, LEAST = 4, 600, 50
TOKENS = {"text": 200, "risk_disclosure": 250, "management_discussion": 200, "unknown": 200, "financial_statement": None, "table": None}
#: Pages that a worker opens at once, characters of chunks that it holds.
OPENED, GIVEN = 64, 1 << 21
SEPARATORS = ("\n\n", "\n", ". ", " ")


# Names of sections by class of block; any other is "General".
SECTION_LABELS = {"financial_statement": "Financial Statements", "table": "Tables", "risk_disclosure": "Risk Disclosures", "management_discussion": "Management Discussion", "text": "General", "unknown": "General"}


def section_label(block: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SECTION_LABELS.items() for x in pair)), block), F.lit("General"))


def described(chunks: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks (doc, page, block, position, text, chunk_id) with what retrieval filters by and citations print.

    ``pages`` has doc, page, financial_type.  ``documents`` has doc, tenant_id, company, filing_date,
    may have doc_id by financial_type, and any of ticker, fiscal_year, quarter, document_type,
    version; what it lacks is null.  A chunk of unknown type is of its file's first
    document.  A file that several tenants hold gives each of them its chunks.
    """
    own = documents if "financial_type" in documents.columns else documents.withColumn("financial_type", F.lit(None).cast("string"))
    for name, kind in (("doc_id", "string"), ("ticker", "string"), ("fiscal_year", "int"), ("quarter", "string"), ("document_type", "string"), ("version", "string")):
        if name not in own.columns:
            own = own.withColumn(name, (F.col("doc") if name == "doc_id" else F.lit(None)).cast(kind))
    by_file = own.groupBy("doc", "tenant_id").agg(*(F.min_by(c, F.coalesce("financial_type", F.lit(""))).alias(c) for c in ("company", "ticker", "fiscal_year", "quarter", "document_type", "filing_date", "version", "doc_id")), F.map_from_entries(F.collect_list(F.struct(F.coalesce("financial_type", F.lit("")), "doc_id"))).alias("ids"))
    rows = chunks.join(pages.select("doc", "page", "financial_type"), ["doc", "page"], "left").join(by_file, "doc")
    kind = F.coalesce("financial_type", F.lit("unknown"))
    return rows.select(
        F.coalesce(F.element_at("ids", kind), "doc_id").alias("doc_id"), "tenant_id", "chunk_id", "company", "ticker", "fiscal_year", "quarter", kind.alias("financial_type"), "document_type",
        F.lit("Ind AS").alias("reporting_standard"), "filing_date", F.col("filing_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_latest"), "version",
        F.col("page").alias("page_number"), section_label(F.col("block")).alias("section"), F.lit("").alias("subsection"), F.col("block").alias("chunk_type"), F.lit(None).cast("string").alias("table_header"),
        F.lit(False).alias("needs_review"), "position", "text",
    )


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of ``size`` characters, each starting ``overlap`` before the end of the last."""
    step = max(1, size - overlap)
    return [text[i : i + size] for i in range(0, len(text), step)]


def split(text: str, size: int, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where a separator allows it.

    Parts at the first separator that occurs are packed together; a new chunk opens with the end of
    the one before.  Chunks that are still too long are split by the finer separators, last by
    characters.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return [p for p in windows(text, size, overlap) if p.strip()]
    sign, finer = separators[at], separators[at + 1 :]
    packed, open_ = [], ""
    for part in text.split(sign):
        longer = f"{open_}{sign}{part}" if open_ else part
        if len(longer) <= size:
            open_ = longer
            continue
        packed.append(open_)
        tail = open_[-overlap:] if overlap else ""
        open_ = f"{tail}{sign}{part}" if tail else part
    packed.append(open_)
    out: list[str] = []
    for chunk in packed:
        out += split(chunk, size, overlap, finer) if len(chunk) > size else [chunk]
    return [c for c in out if c.strip()]


def chunk_id(doc: Column, page: Column, position: Column, text: Column) -> Column:
    """UUID form of the digest of document, page, position and the first 100 characters."""
    digest = F.md5(F.concat_ws(":", doc.cast("string"), page.cast("string"), position.cast("string"), F.substring(text, 1, 100)).cast("binary"))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def recursive_chunks(pages: DataFrame) -> DataFrame:
    """doc, page, block, position, text, chunk_id of every chunk; positions count before short chunks go.

    Splitting depends on what came before within a page only, so it runs on Arrow batches of pages; a
    worker opens few pages of a batch at a time and gives chunks away after about ``GIVEN`` characters.
    """

    def given(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema, strict=True)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in ("doc", "page", "block")), pa.field("position", pa.int32()), pa.field("text", pa.string())])
            out, held = [], 0
            for at in range(0, batch.num_rows, OPENED):
                for r in batch.slice(at, OPENED).to_pylist():
                    tokens = TOKENS.get(r["block"], TOKENS["unknown"])
                    text = r["content"] or ""
                    for i, piece in enumerate([text] if tokens is None else split(text, tokens * CHARS)):
                        out.append((r["doc"], r["page"], r["block"], i, piece))
                        held += len(piece)
                    if held > GIVEN:
                        yield given(out, schema)
                        out, held = [], 0
            if out:
                yield given(out, schema)

    kinds = dict(pages.dtypes)
    rows = pages.select("doc", "page", "block", "content").mapInArrow(cut, f"doc {kinds['doc']}, page {kinds['page']}, block string, position int, text string")
    return rows.where(F.length(F.trim("text")) >= LEAST).withColumn("chunk_id", chunk_id(F.col("doc"), F.col("page"), F.col("position"), F.col("text")))


def fixed_chunks(rows: DataFrame, item: str, size: int, overlap: int = 0) -> DataFrame:
    """Windows of equal size as a plain expression: item, position, text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(step))
    return rows.where(F.length("text") > 0).select(item, "text", F.posexplode(starts).alias("position", "start")).select(item, "position", F.col("text").substr(F.col("start") + 1, F.lit(size)).alias("text"))
