"""The ingest job: parsed documents become passages and states; every failure leaves a document in a clear state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import chunker
from lodestone.operators.lineage import cut

# Passages of a document at most, and the reasons that the uploader reads.
MOST_PASSAGES = 3000
SCANNED = "No text was found. The PDF looks scanned, and scanned pages aren't supported yet."
NO_TEXT = "No readable text was found in this document."
UNREADABLE = "The file couldn't be read. It may be damaged or password-protected."
EMBEDDING = {
    "daily": "The daily Gemini embedding quota is used up. Reprocess this document tomorrow, or use a paid key.",
    "minute": "The Gemini embedding quota was busy. Wait a minute, then reprocess this document.",
    "model": "Embedding failed because the model provider returned an error. Try reprocessing.",
}


def cleared(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages or embeddings without those of the documents that are processed again."""
    return rows.join(documents.select("doc_id"), "doc_id", "left_anti")


def ingest(documents: DataFrame, now: Column, failed: DataFrame | None = None, most: int = MOST_PASSAGES) -> dict[str, DataFrame]:
    """`chunks`, `documents` (doc_id, parsed_status, parse_error, chunk_count, ...) and `audit` rows of one run.

    documents: one row for each doc_id with workspace_id, source, elements, problem (of parse_file; null: none) and
    pages_without_text. failed: doc_id, kind (a key of EMBEDDING) of documents whose embedding failed; their passages
    stay, so that the failure can be inspected. Documents over `most` passages are refused as a whole.
    """
    parsed = documents.where("problem is null and elements is not null")
    # passages are written once, then counted and filtered
    chunks = cut(chunker.chunk_documents(parsed))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("passages"))
    d = documents.select("doc_id", "workspace_id", "problem", F.col("elements").isNull().alias("unread"), "pages_without_text").join(counts, "doc_id", "left")
    if failed is None:
        d = d.withColumn("kind", F.lit(None).cast("string"))
    else:
        d = d.join(failed.groupBy("doc_id").agg(F.min("kind").alias("kind")), "doc_id", "left")
    n = F.coalesce("passages", F.lit(0))
    over = F.concat(F.lit("This document splits into "), n.cast("string"), F.lit(f" passages; the limit is {most}. Split it into smaller files."))
    embedding = F.lit(None).cast("string")
    for kind, reason in EMBEDDING.items():
        embedding = F.when(F.col("kind") == kind, F.lit(reason)).otherwise(embedding)
    scanned = F.coalesce(F.col("pages_without_text"), F.lit(0)) > 0
    early = F.coalesce("problem", F.when(F.col("unread"), F.lit(UNREADABLE)), F.when(n > most, over), F.when((n == 0) & scanned, F.lit(SCANNED)), F.when(n == 0, F.lit(NO_TEXT)))
    d = d.select("doc_id", "workspace_id", n.alias("n"), early.alias("early"), embedding.alias("late"))
    reason = F.coalesce("early", "late")
    kept = F.when(F.col("early").isNull(), F.col("n")).otherwise(0)
    states = d.select("doc_id", "workspace_id", F.when(reason.isNull(), "ready").otherwise("failed").alias("parsed_status"), F.lit(None).cast("string").alias("processing_stage"), reason.alias("parse_error"), kept.alias("chunk_count"), F.when(reason.isNull(), now).alias("processed_at"))
    details = F.when(reason.isNull(), F.to_json(F.struct(F.col("n").alias("chunks")))).otherwise(F.to_json(F.struct(reason.alias("reason"))))
    audit = d.select("workspace_id", F.lit("system").alias("actor_type"), F.when(reason.isNull(), "document.processed").otherwise("document.failed").alias("action"), F.lit("document").alias("target_type"), F.col("doc_id").cast("string").alias("target_id"), details.alias("details"), now.alias("timestamp"))
    return {"chunks": chunks.join(d.where("early is null").select("doc_id"), "doc_id", "left_semi"), "documents": states, "audit": audit}
