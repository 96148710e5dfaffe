"""Records of evaluation runs: one row a question, with what was shown, what was retrieved and cited, and how it scores.

A record holds a question's own rows only: the passages of its attempts, its citations, its tool steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import facts_found
from lodestone.operators import evaluation

# Tools that answer from documents, and the characters of a cited passage that are kept.
DOCUMENT_TOOLS = ("lookup_fact", "explore_documents", "summarize_documents")
EXCERPT = 600


def _listed(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """id and its rows as an array of structs, in the order of the columns named."""
    rest = [c for c in rows.columns if c not in ("id", *order)]
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def _with(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with the array column of listed; empty where an id has none."""
    (name,) = (c for c in listed.columns if c != "id")
    return rows.join(listed, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))


def _first_place(ids: Column, expected: Column) -> Column:
    return evaluation.retrieval_score(ids, expected)["rank_of_expected"]


def full_records(questions: DataFrame, outcomes: DataFrame, retrieved: DataFrame, citations: DataFrame, first_model: str) -> DataFrame:
    """Records of questions put to retrieval and answering alone.

    questions: id, question, expect_answer, expected (array of chunk ids); outcomes: id, answer, answerable, model, ...; retrieved: id, rank,
    chunk_id, ... of the best attempt; citations: id, ordinal, chunk_id, content, .... A question without an outcome has no record.
    """
    cited = _listed(citations.withColumn("excerpt", F.left("content", F.lit(EXCERPT))).drop("content"), "citations", ["ordinal"])
    rows = _with(_with(questions.join(outcomes, "id"), _listed(retrieved, "retrieved", ["rank"])), cited)
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    place = _first_place(F.transform("citations", lambda c: c["chunk_id"]), expected)
    score = evaluation.retrieval_score(F.transform("retrieved", lambda c: c["chunk_id"]), expected)
    return rows.select(
        *rows.columns,
        *[score[f].alias(f) for f in ("expected_chunk_retrieved", "rank_of_expected", "reciprocal_rank", "retrieved_count")],
        place.isNotNull().alias("expected_chunk_cited"),
        place.alias("cited_position_of_expected"),
        (~F.col("model").eqNullSafe(F.lit(first_model))).alias("answered_by_fallback_model"),
        (~F.col("answerable")).alias("refused"),
        F.when(~F.col("expect_answer"), ~F.col("answerable")).alias("refusal_correct"),
    )


def first_seen(retrieved: DataFrame) -> DataFrame:
    """Each passage of a question once, where it was met first: rows (id, run, rank, chunk_id)."""
    return retrieved.groupBy("id", "chunk_id").agg(F.min(F.struct("run", "rank")).alias("at")).select("id", "at.run", "at.rank", "chunk_id")


def agent_records(questions: DataFrame, replies: DataFrame, steps: DataFrame, answers: DataFrame, citations: DataFrame, retrieved: DataFrame, first_model: str) -> DataFrame:
    """Records of questions put to the assistant, which chooses its tools and may answer from documents several times.

    questions: id, expect_answer, expected, groups (array of arrays), distractors, expected_tools, must_not_include; replies: id, reply, models;
    steps: id, step, tool, ok, summary; answers: id, nth, answer, answerable, grounded, flagged, flag_reasons, confidence, model; citations: id,
    nth, ordinal, chunk_id; retrieved: id, run, rank, chunk_id of every retrieval the tools ran. What is shown is the reply and each answer.
    Null arrays of a question are empty.
    """
    none = F.array().cast("array<string>")
    q = questions.select("id", "expect_answer", *[F.coalesce(c, none).alias(c) for c in ("expected", "distractors", "expected_tools", "must_not_include")], F.coalesce("groups", F.array().cast("array<array<string>>")).alias("groups"))
    hits = retrieved.join(q.select("id", "expected"), "id").where(F.array_contains("expected", F.col("chunk_id")))
    best = hits.groupBy("id").agg(F.min("rank").alias("rank_of_expected"))
    rows = q.join(replies, "id").join(best, "id", "left")
    for df, name, order in ((steps, "steps", ["step"]), (answers, "answers", ["nth"]), (citations, "citations", ["nth", "ordinal"]), (first_seen(retrieved), "retrieved", ["run", "rank"])):
        rows = _with(rows, _listed(df, name, order))
    each = lambda field, of="answers": F.transform(of, lambda a: a[field])
    cited = F.array_distinct(each("chunk_id", "citations"))
    tools = F.filter(each("tool", "steps"), lambda t: t.isin(*DOCUMENT_TOOLS))
    first = F.coalesce(F.try_element_at(tools, F.lit(1)), F.lit("none"))
    shown = F.array_join(F.concat(F.array("reply"), each("answer")), "\n\n")
    found = F.arrays_zip(F.col("must_not_include").alias("term"), facts_found(shown, F.col("must_not_include")).alias("found"))
    some = F.size("answers") > 0
    all_true = lambda field: F.when(some, F.forall("answers", lambda a: a[field]))
    rows = rows.withColumns({"cited": cited, "document_tools": tools, "violations": F.transform(F.filter(found, lambda x: x["found"]), lambda x: x["term"]), "refused": ~F.exists("answers", lambda a: a["answerable"])})
    place, groups = _first_place(F.col("cited"), F.col("expected")), evaluation.group_score(F.col("cited"), F.col("groups"), F.col("distractors"))
    return rows.select(
        "id",
        "reply",
        F.when(some, F.array_join(each("answer"), "\n\n")).otherwise(F.col("reply")).alias("answer"),
        (~F.col("refused")).alias("answerable"),
        "citations",
        F.try_element_at(each("confidence"), F.lit(1)).alias("confidence"),
        each("confidence").alias("confidences"),
        all_true("grounded").alias("grounded"),
        F.exists("answers", lambda a: a["flagged"]).alias("flagged"),
        F.array_sort(F.array_distinct(F.flatten(each("flag_reasons")))).alias("flag_reasons"),
        F.when(some, F.try_element_at(each("model"), F.lit(1))).otherwise(F.try_element_at("models", F.lit(1))).alias("model"),
        "steps",
        "document_tools",
        F.filter(each("summary", "steps"), lambda s: s.startswith("ERROR")).alias("tool_errors"),
        "retrieved",
        first.alias("document_tool_chosen"),
        F.when(F.size("expected_tools") > 0, F.array_contains("expected_tools", first)).alias("routing_ok"),
        F.col("rank_of_expected").isNotNull().alias("expected_chunk_retrieved"),
        "rank_of_expected",
        F.coalesce(F.bround(1.0 / F.col("rank_of_expected"), 4), F.lit(0.0)).alias("reciprocal_rank"),
        F.size("retrieved").alias("retrieved_count"),
        place.isNotNull().alias("expected_chunk_cited"),
        place.alias("cited_position_of_expected"),
        groups["required_groups"].alias("required_groups"),
        groups["required_groups_cited"].alias("required_groups_cited"),
        ((F.size("groups") > 0) & groups["all_required_cited"]).alias("all_required_cited"),
        groups["cited_distractor"].alias("cited_distractor"),
        "violations",
        F.exists("answers", lambda a: ~a["model"].eqNullSafe(F.lit(first_model))).alias("answered_by_fallback_model"),
        "refused",
        F.when(~F.col("expect_answer"), F.col("refused") & (F.size("violations") == 0)).alias("refusal_correct"),
    )


def repeated_rank(records: DataFrame, passages: DataFrame, expected: DataFrame) -> DataFrame:
    """id, rank and whether it was retrieved, scored anew from the passages that records kept, for expected passages that changed since.

    passages: id, rank, chunk_id; expected: id, chunk_id. Records without a kept passage are unknown, not missed.
    """
    kept = passages.join(records.select("id"), "id", "left_semi")
    seen = kept.groupBy("id").agg(F.count("*").alias("n"))
    hit = kept.join(expected.distinct(), ["id", "chunk_id"], "left_semi").groupBy("id").agg(F.min("rank").alias("rank"))
    rows = records.select("id").join(seen, "id", "left").join(hit, "id", "left")
    return rows.select("id", "rank", F.col("rank").isNotNull().alias("retrieved"), F.col("n").isNull().alias("rank_unknown"))


