"""Tools that answer from documents: each call is retrieved for by its tool's profile, answered, checked, and read back by the assistant.

What writes answers is a column of drafts, as a model would give them; what searches is a function of calls, hybrid search by default.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import answers, lineage, retrieval, tools

# The profile that each tool searches by.
PROFILE_OF = {"lookup_fact": retrieval.LOOKUP, "explore_documents": retrieval.EXPLORE, "summarize_documents": retrieval.SUMMARIZE}

Search = Callable[[DataFrame, retrieval.Profile], DataFrame]


def searcher(chunks: DataFrame, postings, documents: DataFrame | None = None) -> Search:
    """Hybrid search of passages, scanned for text that gives instructions. Calls need query_vector."""

    def search(calls: DataFrame, profile: retrieval.Profile) -> DataFrame:
        found = retrieval.hybrid_search(calls.select("query_id", "query_text", "query_vector"), chunks, postings, profile, documents=documents)
        return found.select("query_id", "position", "chunk_id", "rerank_score", "content", text.injection_reasons(F.col("content")).alias("injection_reasons"))

    return search


def answer_calls(calls: DataFrame, search: Search, draft: Callable[[Column, Column], Column]) -> dict[str, DataFrame]:
    """`replies`, one row a call; `answers` of those within their turn's limit; `turns` with what their passages tried.

    calls: request_id, turn_id, tool, question and what search needs; calls of other tools are left out, those of a turn count in order of
    request_id. search gives query_id, position, chunk_id, rerank_score, content, injection_reasons. draft(question, passages) is a struct of
    answerable, grounded, unsupported and sentences, null for output that couldn't be read.
    """
    own = calls.where(F.col("tool").isin(*PROFILE_OF))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("turn_id").orderBy("request_id")))
    asked = own.where(F.col("nth") <= tools.ANSWERS_A_TURN).withColumnsRenamed({"request_id": "query_id", "question": "query_text"})
    parts = []
    for tool, profile in PROFILE_OF.items():
        found = search(asked.where(F.col("tool") == tool), profile)
        place = Window.partitionBy("query_id")
        graded = retrieval.gate(F.min_by("rerank_score", "position").over(place), F.count("*").over(place), profile.name)
        parts.append(found.select("query_id", "position", "chunk_id", "rerank_score", "content", "injection_reasons", graded.alias("grade")))
    passages = lineage.cut(reduce(DataFrame.unionByName, parts))
    bad = F.coalesce("injection_reasons", F.array().cast("array<string>"))
    one = F.struct("position", "chunk_id", "rerank_score", (F.size(bad) > 0).alias("injected"), "content", bad.alias("reasons"))
    listed = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("passages"), F.first("grade").alias("grade"))
    rows = asked.join(listed, "query_id", "left").withColumns({"passages": F.coalesce("passages", F.array().cast(listed.schema["passages"].dataType)), "grade": F.coalesce("grade", F.lit("weak"))})
    drafts = rows.select(F.col("query_id").alias("answer_id"), draft(F.col("query_text"), F.col("passages")).alias("draft"), "grade", "passages")
    out = answers.outcomes(drafts)
    given = rows.select(F.col("query_id").alias("answer_id"), "turn_id", "nth", "tool", "query_text", "grade").join(out, "answer_id")
    reply = tools.checked_answer(F.col("nth"), *[F.col(c) for c in ("answer", "answerable", "grounded", "confidence", "flagged")])
    replies = own.select(F.col("request_id").alias("answer_id"), "turn_id", "nth").join(out, "answer_id", "left").select(F.col("answer_id").alias("request_id"), "turn_id", "nth", reply.alias("reply"))
    reasons = F.flatten(F.transform("passages", lambda p: p["reasons"]))
    told = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", reasons.alias("reasons")))), lambda x: x["reasons"]))
    turns = rows.groupBy("turn_id").agg(told.alias("taint_reasons")).withColumn("tainted", F.size("taint_reasons") > 0)
    return {"replies": replies, "answers": given, "turns": turns}
