"""Readers and writers: facts, chunks, audit rows, registered documents, files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..operators.latest import history, outcomes, upsert
from .snapshots import Table

#: Bytes of a file that may be ingested, characters of a query that the audit log keeps.
LARGEST, KEPT_TEXT = 50 * 1024 * 1024, 500
#: What facts are partitioned by; partitions of a batch that the scan of the stored facts is told by name.
PARTITIONS, NAMED = ["tenant_id", "fiscal_year"], 1_000


def acceptable(name: Column, length: Column) -> Column:
    """May a file be taken in?  A PDF file by name, not empty and within the size limit."""
    return F.lower(name).endswith(".pdf") & (length > 0) & (length <= LARGEST)


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, digest, content of files up to the size limit."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where(acceptable(F.col("path"), F.col("length")))
    return rows.select("path", "length", F.sha2("content", 256).alias("digest"), "content")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Scored results as JSON, one object a line."""
    results.write.mode("overwrite").json(path)


def section_digest(digest: Column, financial_type: Column) -> Column:
    return F.concat_ws("_", digest, financial_type)


def write_facts(existing: DataFrame, incoming: DataFrame, path: str) -> DataFrame:
    """Store a batch beside what is there, in a fresh folder partitioned for lookups, and return the outcomes' counts.

    Readers switch folders once the write is complete; running the same batch again gives the same table.
    """
    upsert(existing, incoming).write.mode("overwrite").partitionBy("tenant_id", "fiscal_year").parquet(path)
    columns = [c for c in existing.columns if c != "is_latest"]
    told = outcomes(existing.select(columns).withColumn("new", F.lit(False)).unionByName(incoming.select(columns).withColumn("new", F.lit(True))))
    return told.where("new").groupBy("outcome").agg(F.count("*").alias("n"))


def _beside(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``stored`` in the partitions that ``incoming`` touches; null tenants and years are partitions too.

    Up to ``NAMED`` partitions become a filter of the scan, so others are not read; the join then
    keeps exactly those touched, however many they are.
    """
    parts = incoming.select(PARTITIONS).distinct()
    named = parts.take(NAMED + 1)
    if len(named) <= NAMED:
        for c in PARTITIONS:
            values = {r[c] for r in named}
            within = F.col(c).isin([v for v in values if v is not None])
            stored = stored.where(within | F.col(c).isNull() if None in values else within)
    touched = parts.toDF(*(f"touched_{c}" for c in PARTITIONS))
    tenant, year = (F.col(c).eqNullSafe(F.col(f"touched_{c}")) for c in PARTITIONS)
    return stored.join(touched, tenant & year, "left_semi")


def merge_facts(incoming: DataFrame, path: str) -> DataFrame:
    """Merge a batch into the stored versions at ``path`` and return the outcomes' counts.

    Only the partitions (tenant and year) that the batch touches are read and rewritten; the others
    stay as they are.  Running the same batch again changes nothing.  Partitions are swapped once the
    whole batch is written, so lost executors do no harm.
    """
    spark = incoming.sparkSession
    incoming = incoming.select(*(c for c in incoming.columns if c not in PARTITIONS), *PARTITIONS)
    schema = incoming.withColumn("is_latest", F.lit(True)).schema
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing is stored yet
        stored = spark.createDataFrame([], schema)
    held = _beside(stored, incoming).select(incoming.columns)
    told = outcomes(held.withColumn("new", F.lit(False)).unionByName(incoming.withColumn("new", F.lit(True)))).where("new")
    counts = spark.createDataFrame(told.groupBy("outcome").agg(F.count("*").alias("n")).collect(), "outcome string, n bigint")
    upsert(held, incoming).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    return counts


def commit_facts(incoming: DataFrame, path: str, batch: tuple[str, int] | None = None) -> DataFrame:
    """Merge a batch into the versions at ``path`` as one commit, and return the outcomes' counts.

    As ``merge_facts``, but with many writers: none waits for another, and none's work is lost (see
    ``snapshots``).  The batch is written down once, so whatever it costs to find is paid once, and
    each stored version tells from when to when it counted.  A batch that was committed before
    (writer, number) changes nothing and has no outcomes.
    """
    spark = incoming.sparkSession
    folder = f"{path}/staged/{uuid.uuid4().hex}"
    incoming.write.parquet(folder)
    staged = spark.read.schema(incoming.schema).parquet(folder)
    columns = incoming.columns
    rewrite = lambda held, new: history(upsert(held.select(columns), new))
    told_as = "outcome string, n bigint"
    stored = history(spark.createDataFrame([], incoming.schema).withColumn("is_latest", F.lit(True))).schema
    table = Table(spark, path, stored, PARTITIONS)
    version, base = table.merge(staged, rewrite, batch)
    if version == base:
        return spark.createDataFrame([], told_as)
    touched = set(table.touched(staged))
    held = table.read(base, only=touched.__contains__) if base >= 0 else spark.createDataFrame([], stored)
    told = outcomes(held.select(columns).withColumn("new", F.lit(False)).unionByName(staged.withColumn("new", F.lit(True)))).where("new")
    return spark.createDataFrame(told.groupBy("outcome").agg(F.count("*").alias("n")).collect(), told_as)


def facts_at(spark: SparkSession, path: str, tenant: str | None = None, version: int | None = None, at=None) -> DataFrame:
    """Versions of facts as they stood after a commit or at a moment (now, if neither is given); a tenant opens its own folders only."""
    return Table(spark, path).read(version, at, only=(lambda p: p[0] == tenant) if tenant is not None else None)


def verify_facts(facts: DataFrame, company: str, fiscal_year: int, financial_type: str) -> DataFrame:
    """Latest facts of a company, year and type in the order of metrics, to be held against what was expected."""
    rows = facts.where(F.col("is_latest") & (F.col("company") == company) & (F.col("fiscal_year") == fiscal_year) & (F.col("financial_type") == financial_type))
    return rows.select("metric", "value", *(c for c in ("unit", "quarter", "filing_date") if c in rows.columns)).orderBy("metric", "quarter")


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """The user who signs in, before any tenant is known."""
    return users.where(F.col("email") == email).select("user_id", "tenant_id", "role", "password_hash")


def read_facts(spark: SparkSession, path: str, tenant: str | None) -> DataFrame:
    """A tenant's latest facts, of a folder or of a table with versions: other tenants' files are not read."""
    if Table(spark, path, StructType()).version() >= 0:
        return facts_at(spark, path, tenant if tenant is not None else "").where((F.col("tenant_id") == F.lit(tenant).cast("string")) & F.col("is_latest"))
    return spark.read.parquet(path).where((F.col("tenant_id") == F.lit(tenant).cast("string")) & F.col("is_latest"))


def read_sql(spark: SparkSession, sql: str, facts: DataFrame, **args) -> DataFrame:
    """A query with named parameters over the view ``facts``; values are never put into its text."""
    name = f"facts_{uuid.uuid4().hex}"
    facts.createOrReplaceTempView(name)
    return spark.sql(sql.replace("{facts}", name), args=args)


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks by id, a later one in place of an earlier: ids follow from content, so replays add nothing.

    Rows of one batch that share an id are alike but for errors; then the least counts, whatever their order.
    """
    rows = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("chunk_id").orderBy(F.desc("__new"), *(c for c, kind in existing.dtypes if c != "chunk_id" and not kind.startswith("map")))
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth", "__new")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("tenant_id", "company").parquet(path)


def register_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming documents with the id of an earlier registration of the same digest, if any."""
    known = existing.groupBy("digest").agg(F.min("doc_id").alias("known_id"))  # one id even where a digest was stored twice
    return incoming.join(known, "digest", "left").withColumn("doc_id", F.coalesce("known_id", "doc_id")).drop("known_id")


def set_state(documents: DataFrame, doc_ids: DataFrame, state: str) -> DataFrame:
    marked = doc_ids.select("doc_id").distinct().withColumn("__hit", F.lit(True))
    return documents.join(marked, "doc_id", "left").withColumn("ingestion_state", F.when(F.col("__hit"), state).otherwise(F.col("ingestion_state"))).drop("__hit")


def audit_rows(rows: DataFrame) -> DataFrame:
    """Audit rows as they are kept: queries are cut to a bounded length, the parsed query goes in as JSON."""
    out = rows.withColumn("query_text", F.substring("query_text", 1, KEPT_TEXT))
    if "dsl_generated" in rows.columns:
        out = out.withColumn("dsl_generated", F.to_json("dsl_generated"))
    return out


def append_audit(rows: DataFrame, path: str) -> None:
    """Append only."""
    audit_rows(rows).write.mode("append").parquet(path)


def embeddings_of_size(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the expected length; others are left out, and counted by their absence."""
    return vectors.where(F.size("embedding") == dim)


def collection_size(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"))


def collection_info(chunks: DataFrame) -> DataFrame:
    """n_chunks and the chunk of the least id as a sample: one pass."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.min_by(F.struct(*chunks.columns), "chunk_id").alias("sample"))
