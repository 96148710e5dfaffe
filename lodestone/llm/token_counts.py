"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then answer the number of
documents, totals, quantiles and truncated totals for every context limit. Lengths are summed in blocks,
so no task holds more than a block of lengths and one row per block.

Defined results: null, empty and blank texts have length 0; repeated rows each count; an empty table has an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_columns, materialize, slices, table
from .tokens import encoder

BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        e = encoder(path)
        for batch in slices(batches, 4 << 20):
            _, sizes, _ = e.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], schema=schema)

    return doc_columns(docs).mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit: exact answers over all documents.

    docs_at_least, tokens_at_least: suffix sums over lengths >= L. truncated_tokens: sum of min(length, L).
    lost_tokens: what a limit of L cuts. quantile: share of documents no longer than L.
    Between two occurring lengths truncated_tokens is linear in the limit (slope: docs_at_least of the longer).
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(everything).alias("all_docs"),
        F.sum("b_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    suffix = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_tokens")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    shorter = F.col("all_tokens") - F.col("tokens_at_least")
    truncated = shorter + F.col("docs_at_least") * F.col("n_tokens")
    return suffix.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        truncated.alias("truncated_tokens"),
        (F.col("all_tokens") - truncated).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the histogram is read twice, by length and by block: written once, texts are encoded once
    histogram = materialize(length_histogram(encoded_lengths(table(spark, sf_dir, "documents"))), "lengths")
    return context_limits(histogram)
