"""Reads and summaries of runs: the corpus as a whole, ingest totals, results with their metrics, fields beside the model, the review feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A corpus of fewer passages is called small; entries of the review feed.
SMALL_CORPUS, FEED = 150, 20


def corpus(documents: DataFrame, chunks: DataFrame, workspace_id=None) -> DataFrame:
    """Documents (doc_id, workspace_id, file_name, parsed_status, ...) of a workspace with `chunks`: an array of their passages in order.

    A document's passages are gathered, never more; documents without any have an empty array.
    """
    own = documents if workspace_id is None else documents.where(F.col("workspace_id") == F.lit(workspace_id))
    fields = [c for c in chunks.columns if c not in ("doc_id", "chunk_index")]
    held = chunks.join(own.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", *fields))).alias("chunks"))
    kind = held.schema["chunks"].dataType
    return own.join(held, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(kind)))


def ingest_totals(results: DataFrame) -> DataFrame:
    """One row from the outcomes of an ingest run (file_name, status, passages, embedded): files by status, passages of what can be searched, and whether that is a small corpus."""
    usable = F.col("status").isin("ready", "skipped")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    total = F.coalesce(F.sum(F.when(usable, F.col("passages"))), F.lit(0)).cast("long")
    return results.agg(F.count("*").alias("files"), count("ready"), count("skipped"), count("failed"), total.alias("passages"), F.coalesce(F.sum("embedded"), F.lit(0)).cast("long").alias("embedded"), ((total > 0) & (total < SMALL_CORPUS)).alias("small"))


def read_run(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of results files ({"run": {...}, "questions": [...]}), one row each with its run's mode. record: schema of a question.

    A run without a mode is a full one; a file without questions gives no row.
    """
    files = spark.read.schema(f"run struct<mode:string,started_at:string>, questions array<struct<{record}>>").json(path, multiLine=True).withColumn("file", F.input_file_name())
    return files.select("file", F.coalesce("run.mode", F.lit("full")).alias("mode"), F.explode("questions").alias("q")).select("file", "mode", "q.*")


def write_metrics(metrics: DataFrame, results_path: str) -> str:
    """Metrics as JSON beside the results they are of; the place."""
    place = results_path.removesuffix(".json") + ".metrics.json"
    metrics.coalesce(1).write.mode("overwrite").json(place)
    return place


def raw_field(spark: SparkSession, path: str, key: str) -> DataFrame:
    """id and value of each text in an array field that the model of golden questions leaves out; comment lines and other values are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' and value not like '//%'")
    rows = lines.select(F.get_json_object("value", "$.id").alias("id"), F.try_parse_json(F.get_json_object("value", f"$.{key}")).alias("v"))
    each = rows.select("id", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("x"))
    return each.where(F.schema_of_variant("x") == "STRING").select("id", F.variant_get("x", "$", "string").alias("value"))


def review_feed(reviews: DataFrame, answers: DataFrame, actions: DataFrame, users: DataFrame, limit: int = FEED) -> DataFrame:
    """The newest decisions of each workspace: kind, target_id, decision, notes, correction, at, summary (the question, or the proposed title; '' if unknown) and by.

    reviews: workspace_id, review_target_id, decision, notes, correction, created_at, reviewer_id; answers: answer_id, question; actions:
    action_id, workspace_id, status, proposed_payload, decided_at, decided_by; users: user_id, full_name, email. Each side gives its newest
    `limit`, then the two are merged.
    """
    who = users.select("user_id", F.coalesce(F.nullif("full_name", F.lit("")), "email").alias("by"))
    newest = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc_nulls_last("at"), "kind", "target_id"))).where(F.col("nth") <= limit)
    r = reviews.where("review_target_type = 'answer'").select("workspace_id", F.lit("answer").alias("kind"), F.col("review_target_id").alias("target_id"), "decision", "notes", "correction", F.col("created_at").alias("at"), F.col("reviewer_id").alias("user_id"))
    r = newest(r).join(answers.select(F.col("answer_id").alias("target_id"), F.col("question").alias("summary")), "target_id", "left")
    none = F.lit(None).cast("string")
    a = actions.where("status in ('approved', 'rejected')").select("workspace_id", F.lit("action").alias("kind"), F.col("action_id").alias("target_id"), F.col("status").alias("decision"), none.alias("notes"), none.alias("correction"), F.col("decided_at").alias("at"), F.col("decided_by").alias("user_id"), F.get_json_object("proposed_payload", "$.title").alias("summary"))
    both = r.unionByName(newest(a)).drop("nth").join(who, "user_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return newest(both).select("workspace_id", F.col("nth").alias("place"), "kind", "target_id", "decision", "notes", "correction", "at", "summary", "by")
