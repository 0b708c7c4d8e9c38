"""From pages and words of registered documents to checked facts and described chunks.

Facts are derived and checked before anything is written.  The gate is by document: one that fails
it leaves neither facts nor chunks behind, and the others of the batch go on.  Tenant, document and
filing date stay with every row, so that what comes out can be written as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import normal_label, skipped_row
from ..operators import chunks, derive, extract, growth, pages
from ..plans import registry
from . import store


def classify_pages(raw: DataFrame) -> DataFrame:
    """Pages (doc, page, content, kind) with their block and financial type."""
    return pages.classify(pages.place(raw, pages.sections(raw)))


def facts_of(classified: DataFrame, words: DataFrame, documents: DataFrame) -> DataFrame:
    """Long facts of statement pages: one for each metric and period, the first in page and row order.

    ``documents`` has doc, tenant_id, company, filing_date; a document's pages are few, so joins on it
    are the only shuffles of more than a page.
    """
    statements = classified.where("block = 'financial_statement'").select("doc", "page", "financial_type")
    found = extract.page_records(words.join(statements.select("doc", "page"), ["doc", "page"], "left_semi"))
    rows = found.where(~skipped_row(F.col("label"), F.array("value"))).withColumn("label", normal_label(F.col("label"), unicode_forms=True))
    named = registry.resolve_by_words(rows, registry.aliases(words.sparkSession)).join(statements, ["doc", "page"])
    first = derive.first_of_each(named, ["doc", "financial_type", "fiscal_year", "quarter", "metric"], ["page", "row_no"])
    columns = ["tenant_id", "company", "doc", "filing_date", "financial_type", "fiscal_year", "quarter", "metric", F.col("value").cast("decimal(28,6)").alias("value")]
    return first.join(documents, "doc").select(*columns)


def rejected(facts: DataFrame) -> DataFrame:
    """tenant_id, doc, n_failures of documents with a stated total beyond the gate."""
    return derive.gate_failures(derive.identity_failures(facts)).groupBy("tenant_id", "doc").agg(F.count("*").alias("n_failures"))


def checked(facts: DataFrame) -> DataFrame:
    """Facts with consistent totals of the documents that pass the gate."""
    bad = rejected(facts).select("tenant_id", "doc")
    sound = facts.join(bad, (facts["tenant_id"].eqNullSafe(bad["tenant_id"])) & facts["doc"].eqNullSafe(bad["doc"]), "left_anti")
    dates = sound.groupBy("tenant_id", "doc").agg(F.max("filing_date").alias("filing_date")).toDF("t", "d", "filing_date")
    totals = growth.lengthen(derive.derive_totals(sound), derive.USED)
    totals = totals.join(dates, F.col("tenant_id").eqNullSafe(F.col("t")) & F.col("doc").eqNullSafe(F.col("d")))
    columns = ["tenant_id", "company", "doc", "filing_date", "financial_type", "fiscal_year", "quarter", "metric", "value"]
    return totals.select(columns).unionByName(sound.where(~F.col("metric").isin(derive.USED)).select(columns))


def section_documents(documents: DataFrame, classified: DataFrame) -> DataFrame:
    """One document for each financial type of a file: doc, financial_type, doc_id (digest and type) and the file's other columns."""
    kinds = classified.where("financial_type <> 'unknown'").select("doc", "financial_type").distinct()
    return documents.join(kinds, "doc").withColumn("doc_id", store.section_digest(F.col("doc").cast("string"), F.col("financial_type")))


def filings_of(facts: DataFrame, seq: Column | int) -> DataFrame:
    """Checked facts as the store keeps them: the document of their section, and the batch that they came with."""
    return facts.withColumn("doc_id", store.section_digest(F.col("doc").cast("string"), F.col("financial_type"))).drop("doc").withColumn("seq", F.lit(seq) if isinstance(seq, int) else seq)


def ingest(raw: DataFrame, words: DataFrame, documents: DataFrame, path: str, seq: int) -> tuple[DataFrame, DataFrame]:
    """Check a batch of files and merge its facts into the store: counts by outcome, and the chunks of the documents that passed.

    ``errors`` among the outcomes counts the facts of documents that the gate rejected.  The batch's
    facts are few beside its pages and are asked for several times, so they are written beside the
    store once found, in a folder of their own under ``{path}.batches``.  The gate is by tenant and
    document: one tenant's rejected file leaves another's chunks of the same file alone.
    """
    classified = classify_pages(raw)
    beside = f"{path}.batches/{seq}-{uuid.uuid4().hex}"
    facts_of(classified, words, documents).write.parquet(f"{beside}/facts")
    facts = raw.sparkSession.read.parquet(f"{beside}/facts")
    rejected(facts).write.parquet(f"{beside}/rejected")
    bad = raw.sparkSession.read.parquet(f"{beside}/rejected").toDF("t", "d", "n_failures")
    theirs = F.col("tenant_id").eqNullSafe(F.col("t")) & F.col("doc").eqNullSafe(F.col("d"))
    counts = store.commit_facts(filings_of(checked(facts), seq), path)
    lost = facts.join(bad, theirs, "left_semi").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("errors").alias("outcome"), "n")
    passed = documents.join(bad, theirs, "left_anti")
    sound = classified.join(passed.select("doc").distinct(), "doc", "left_semi")
    return counts.unionByName(lost), chunks.described(chunks.recursive_chunks(sound), sound, section_documents(passed, sound))


def chunks_of(classified: DataFrame) -> DataFrame:
    return chunks.recursive_chunks(classified)
