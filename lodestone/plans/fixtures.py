"""Workspace tables derived from the driver's tables, each as a DataFrame and as the same SQL.

region = workspace, customer = member, orders = tasks, events = retrieval runs and answers, documents by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY, DAYS = "2024-01-30", 30


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def members(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("workspace_id"),
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("Admin")).otherwise(F.lit("Member")).alias("auth_role"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("full_name"),
    )


MEMBERS = """members as (select n_regionkey as workspace_id, c_custkey as user_id, case when c_custkey % 10 = 0 then 'Admin' else 'Member' end as auth_role,
 lower(replace(c_name, '#', '.')) || '@example.com' as email, c_name as full_name from customer join nation on c_nationkey = n_nationkey)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    o, m = read(spark, d, "orders"), members(spark, d).select("user_id", "workspace_id")
    status = F.create_map(F.lit("O"), F.lit("todo"), F.lit("P"), F.lit("in_progress"), F.lit("F"), F.lit("done"))
    level = F.create_map(F.lit("1-URGENT"), F.lit("urgent"), F.lit("2-HIGH"), F.lit("high"), F.lit("3-MEDIUM"), F.lit("medium"), F.lit("5-LOW"), F.lit("low"))
    key = F.col("o_orderkey")
    return o.join(m, F.col("o_custkey") == F.col("user_id")).select(
        key.alias("task_id"),
        "workspace_id",
        F.concat(F.lit("Order "), key.cast("string")).alias("title"),
        status[F.col("o_orderstatus")].alias("status"),
        F.coalesce(F.try_element_at(level, F.col("o_orderpriority")), F.lit("none")).alias("priority"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("assignee_id"),
        F.when(key % 11 != 0, F.to_date("o_orderdate")).alias("due_date"),
        F.when(key % 5 != 0, F.floor(key / 3)).alias("parent_task_id"),
        F.when(key % 4 != 0, key % 9).alias("sprint_id"),
    )


TASKS = f"""{MEMBERS}, tasks as (select o_orderkey as task_id, workspace_id, 'Order ' || o_orderkey as title,
 case o_orderstatus when 'O' then 'todo' when 'P' then 'in_progress' else 'done' end as status,
 case o_orderpriority when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' when '5-LOW' then 'low' else 'none' end as priority,
 case when o_custkey % 7 <> 0 then o_custkey end as assignee_id, case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as due_date,
 case when o_orderkey % 5 <> 0 then o_orderkey // 3 end as parent_task_id, case when o_orderkey % 4 <> 0 then o_orderkey % 9 end as sprint_id
 from orders join members on o_custkey = user_id)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    grade = F.when(F.col("event_type").isin("purchase", "signup"), F.lit("good")).when(F.col("event_type") == "view", F.lit("ambiguous")).otherwise(F.lit("weak"))
    i = F.col("event_id")
    return e.select(
        i.alias("run_id"),
        F.col("ts").alias("created_at"),
        grade.alias("grade_outcome"),
        (i % 3).alias("retry_count"),
        F.when(i % 13 != 0, F.round(F.col("value") * 100).cast("long")).alias("latency_ms"),
        F.when(i % 17 != 0, F.col("value") / 1000).alias("top_score"),
        F.lit(5).alias("n_scores"),
        F.when(i % 5 != 0, F.element_at(F.array(F.lit("lookup"), F.lit("explore"), F.lit("summarize")), (i % 3 + 1).cast("int"))).alias("profile"),
    )


RUNS = """runs as (select event_id as run_id, ts as created_at, case when event_type in ('purchase', 'signup') then 'good' when event_type = 'view' then 'ambiguous' else 'weak' end as grade_outcome,
 event_id % 3 as retry_count, case when event_id % 13 <> 0 then cast(round(value * 100) as bigint) end as latency_ms, case when event_id % 17 <> 0 then value / 1000 end as top_score, 5 as n_scores,
 case when event_id % 5 <> 0 then ['lookup', 'explore', 'summarize'][event_id % 3 + 1] end as profile from events)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    e, i = read(spark, d, "events"), F.col("event_id")
    low, bad = F.col("value") < 20, F.col("event_type") == "error"
    return e.select(
        i.alias("answer_id"),
        (i % 5).cast("int").alias("workspace_id"),
        F.col("ts").alias("created_at"),
        (~bad).alias("groundedness_pass"),
        (bad | low).alias("flagged"),
        F.array_compact(F.array(F.when(bad, F.lit("groundedness_failed")), F.when(low, F.lit("low_confidence")))).alias("flag_reasons"),
        F.when(i % 6 != 0, F.concat(F.lit("model-"), (i % 4).cast("string"))).alias("model"),
    )


ANSWERS = """answers as (select event_id as answer_id, cast(event_id % 5 as int) as workspace_id, ts as created_at, event_type <> 'error' as groundedness_pass, event_type = 'error' or value < 20 as flagged,
 list_filter([case when event_type = 'error' then 'groundedness_failed' end, case when value < 20 then 'low_confidence' end], lambda x: x is not null) as flag_reasons,
 case when event_id % 6 <> 0 then 'model-' || (event_id % 4) end as model from events)"""


def reviews(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("answer_id % 3 = 0")
    return a.select(F.lit("answer").alias("review_target_type"), F.col("answer_id").alias("review_target_id"), F.when(F.col("answer_id") % 2 == 0, F.lit("approved")).otherwise(F.lit("corrected")).alias("decision"), F.col("created_at"))


REVIEWS = """reviews as (select 'answer' as review_target_type, answer_id as review_target_id, case when answer_id % 2 = 0 then 'approved' else 'corrected' end as decision, created_at from answers where answer_id % 3 = 0)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one passage, with the embedding of the same id (a convention of ours) where there is one."""
    docs, emb = read(spark, d, "documents"), read(spark, d, "embeddings")
    return docs.join(emb, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), F.col("embedding").alias("vector"), "label")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Scored evaluation records, from events."""
    e, i = read(spark, d, "events"), F.col("event_id")
    ids = lambda n, k: F.transform(F.sequence(F.lit(1), n), lambda x: F.concat(F.lit("c"), ((i + x * k) % 7).cast("string")))
    return e.select(
        i.alias("id"),
        F.col("event_type").alias("kind"),
        (i % 9 != 0).alias("answerable"),
        F.when(i % 4 == 0, i % 8 == 0).alias("gate"),
        F.when(i % 6 != 0, i % 7 + 1).alias("rank"),
        (i % 19 == 0).alias("rank_unknown"),
        (i % 6 != 0).alias("retrieved"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(ids((i % 3 + 1).cast("int"), 2)).alias("cited"),
        ids(F.lit(2), 3).alias("expected"),
        F.when(i % 10 == 0, i % 20 == 0).alias("citation_acceptable"),
        F.when(i % 4 == 0, F.lit("true")).when(i % 4 == 1, F.lit("partial")).when(i % 4 == 2, F.lit("false")).alias("answer_correct"),
        (i % 11 != 0).alias("grounded"),
        (i % 11 == 0).alias("flagged"),
        (i % 9 == 0).alias("refused"),
        F.when(i % 3 != 0, F.round(F.col("value") / 1000, 3)).alias("confidence"),
        F.round(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.concat(F.lit("model-"), (i % 3).cast("string")).alias("model"),
        (i % 4 + 1).alias("attempts"),
        (i % 5 != 0).alias("reranked"),
    ).withColumn("cited_expected", F.arrays_overlap("cited", "expected"))


RECORDS = """records as (select *, len(list_intersect(cited, expected)) > 0 as cited_expected from (select event_id as id, event_type as kind, event_id % 9 <> 0 as answerable, case when event_id % 4 = 0 then event_id % 8 = 0 end as gate,
 case when event_id % 6 <> 0 then event_id % 7 + 1 end as rank, event_id % 19 = 0 as rank_unknown, event_id % 6 <> 0 as retrieved,
 case when event_id % 5 = 0 then [] else list_transform(range(1, event_id % 3 + 2), lambda x: 'c' || ((event_id + x * 2) % 7)) end as cited,
 list_transform(range(1, 3), lambda x: 'c' || ((event_id + x * 3) % 7)) as expected,
 case when event_id % 10 = 0 then event_id % 20 = 0 end as citation_acceptable,
 case event_id % 4 when 0 then 'true' when 1 then 'partial' when 2 then 'false' end as answer_correct, event_id % 11 <> 0 as grounded, event_id % 11 = 0 as flagged, event_id % 9 = 0 as refused,
 case when event_id % 3 <> 0 then round(value / 1000, 3) end as confidence, cast(round(value * 100) as bigint) as latency_ms, 'model-' || (event_id % 3) as model, event_id % 4 + 1 as attempts, event_id % 5 <> 0 as reranked from events))"""
