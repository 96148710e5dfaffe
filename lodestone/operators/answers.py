"""Answers from drafts: composition, citations, confidence, groundedness, review flags.

A draft is struct<answerable, grounded, unsupported, sentences: array<struct<text, sources>>>; passages shown
to the model are numbered from 1. Everything is a column expression over nested arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.functions.text import redact_secrets, wrap_untrusted

DRAFT = "struct<answerable:boolean,grounded:boolean,unsupported:array<string>,sentences:array<struct<text:string,sources:array<int>>>>"
# Fixed value: below this an answer goes to review.
REVIEW_CONFIDENCE = 0.45


def _tidy(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\[\d+\]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"\s+([.!?,;:])", "$1")


def compose(sentences: Column) -> Column:
    """Sentences joined by spaces, each with the markers of its sources before its final mark."""
    def one(s: Column) -> Column:
        text = _tidy(s["text"])
        marks = F.array_join(F.transform(F.array_distinct(F.coalesce(s["sources"], F.array().cast("array<int>"))), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")
        ended = F.concat(F.regexp_replace(text, r"[.!?]$", ""), F.lit(" "), marks, F.right(text, F.lit(1)))
        return F.when(marks == "", text).when(text.rlike(r"[.!?]$"), ended).otherwise(F.concat(text, F.lit(" "), marks))

    said = F.filter(F.coalesce(sentences, F.array().cast("array<struct<text:string,sources:array<int>>>")), lambda s: F.trim(s["text"]) != "")
    return F.array_join(F.transform(said, one), " ")


def cited_ids(answer: Column, n_passages: Column) -> Column:
    """Valid passage numbers in the order of first use: position i holds the passage that becomes [i]."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda i: (i >= 1) & (i <= n_passages)))


def renumber(answer: Column, n_passages: Column) -> Column:
    """struct<text, cited>: valid markers renumbered by first use, the rest dropped, spaces before marks removed."""
    cited = cited_ids(answer, n_passages)
    parts = F.split(answer, r"(?=\[\d{1,3}\])|(?<=\[\d{1,3}\])")

    def one(p: Column) -> Column:
        n = F.array_position(cited, F.regexp_extract(p, r"^\[(\d{1,3})\]$", 1).try_cast("int"))
        return F.when(~p.rlike(r"^\[\d{1,3}\]$"), p).when(n > 0, F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise(F.lit(""))

    text = F.array_join(F.transform(parts, one), "")
    return F.struct(F.trim(F.regexp_replace(text, r"[ \t]+([.,;:])", "$1")).alias("text"), cited.alias("cited"))


def unsupported_sentences(draft: Column, n_passages: Column) -> Column:
    """Sentences that cite nothing although the draft answers, or cite a passage that was never shown."""
    def broken(s: Column) -> Column:
        sources = F.coalesce(s["sources"], F.array().cast("array<int>"))
        outside = F.exists(sources, lambda i: (i < 1) | (i > n_passages))
        return (F.trim(s["text"]) != "") & (((F.size(sources) == 0) & draft["answerable"]) | outside)

    return F.transform(F.filter(draft["sentences"], broken), lambda s: F.trim(s["text"]))


def flag_reasons(n_passages: Column, n_citations: Column, answerable: Column, grounded: Column, confidence: Column, injected: Column, review: float = REVIEW_CONFIDENCE) -> Column:
    nothing = F.array(F.lit("no_supporting_passages"))
    flags = F.array_compact(
        F.array(
            F.when(answerable & (n_citations == 0), F.lit("no_citations")),
            F.when(~answerable, F.lit("not_answerable_from_documents")),
            F.when(~grounded, F.lit("groundedness_failed")),
            F.when(confidence < review, F.lit("low_confidence")),
            F.when(injected, F.lit("injection_suspected_in_sources")),
        )
    )
    return F.when(n_passages == 0, nothing).otherwise(flags)


# Answers where none was written.
NOTHING_FOUND = "The workspace documents don't cover this. Upload a document that does, or rephrase the question."
NO_ANSWER = "No answer was produced."
UNREADABLE = "the answer model returned output that could not be read"


def outcomes(drafts: DataFrame) -> DataFrame:
    """Answers from rows (answer_id, draft, grade, passages: array<struct<chunk_id, rerank_score, injected>>[, raw_text]).

    Secrets are redacted before markers are renumbered. Without passages nothing was asked of a model; a null draft is
    output that couldn't be read, and raw_text is then shown as it came.
    """
    n, texts = F.size("passages"), F.array().cast("array<string>")
    raw = F.col("raw_text") if "raw_text" in drafts.columns else F.lit(None).cast("string")
    none, unread = n == 0, F.col("draft").isNull()
    out = drafts.withColumn("_safe", redact_secrets(F.when(unread, raw).otherwise(compose(F.col("draft.sentences")))))
    out = out.withColumn("_r", renumber(F.col("_safe.text"), n))
    out = out.withColumn("citations", F.when(none, F.slice("passages", 1, 0)).otherwise(F.transform("_r.cited", lambda i: F.element_at("passages", i))))
    broken = F.coalesce(unsupported_sentences(F.col("draft"), n), texts)
    said = F.array_distinct(F.concat(F.coalesce("draft.unsupported", texts), broken))
    out = out.withColumn("unsupported", F.when(none, texts).when(unread, F.array(F.lit(UNREADABLE))).otherwise(said))
    out = out.withColumn("grounded", none | (~unread & F.coalesce("draft.grounded", F.lit(False)) & (F.size(broken) == 0)))
    out = out.withColumn("answerable", ~none & F.when(unread, F.col("_r.text") != "").otherwise(F.coalesce("draft.answerable", F.lit(False))))
    scores = F.transform("citations", lambda c: c["rerank_score"])
    out = out.withColumn("confidence", F.when(none, F.lit(0.0)).otherwise(stats.confidence(scores, F.size("citations"), F.col("grade"))))
    injected = F.exists("passages", lambda p: F.coalesce(p["injected"], F.lit(False)))
    flags = flag_reasons(n, F.size("citations"), F.col("answerable"), F.col("grounded"), F.col("confidence"), injected)
    out = out.withColumn("flag_reasons", F.when(~none & unread, F.array(F.lit("groundedness_failed"))).otherwise(flags))
    text = F.when(none, F.lit(NOTHING_FOUND)).when(F.coalesce("_r.text", F.lit("")) == "", F.lit(NO_ANSWER)).otherwise(F.col("_r.text"))
    redacted = F.when(none, texts).otherwise(F.col("_safe.found"))
    return out.select("answer_id", text.alias("answer"), "answerable", F.transform("citations", lambda c: c["chunk_id"]).alias("cited"), "grounded", "unsupported", "confidence", "flag_reasons", (F.size("flag_reasons") > 0).alias("flagged"), redacted.alias("redacted"))


def render_passages(passages: DataFrame) -> DataFrame:
    """query_id, rendered: the passages of each query as one block of labelled data, numbered from 1 by position.

    passages: query_id, position, file_name, section, page, kind, context, content, injection_reasons. A table that goes on
    carries its header row, which is all of the context after its first line. A query's passages are at most a profile's `keep`.
    """
    page = F.when(F.col("page").isNotNull() & (F.col("page") != 0), F.concat(F.lit("page "), F.col("page").cast("string")))
    head = F.array_join(F.filter(F.array("file_name", "section", page), lambda x: x.isNotNull() & (x != "")), " | ")
    context = F.coalesce("context", F.lit(""))
    table_head = F.when((F.col("kind") == "table") & F.contains(context, F.lit("\n")), F.regexp_replace(context, r"(?s)^[^\n]*\n", "")).otherwise(F.lit(""))
    body = F.array_join(F.filter(F.array(head, table_head, F.col("content")), lambda x: x != ""), "\n")
    w = Window.partitionBy("query_id").orderBy("position")
    rows = passages.withColumn("_body", body).withColumn("_n", F.row_number().over(w))
    one = wrap_untrusted(F.col("_body"), F.col("_n"), F.col("file_name"), F.size(F.coalesce("injection_reasons", F.array().cast("array<string>"))) > 0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", one.alias("text")))), lambda x: x["text"])
    return rows.groupBy("query_id").agg(F.concat(F.lit("<workspace_documents>\n"), F.array_join(listed, "\n\n"), F.lit("\n</workspace_documents>")).alias("rendered"))


def question_part(question: Column) -> Column:
    """The question as labelled data that can't close its own label."""
    return F.concat(F.lit("<question>\n"), F.replace(F.replace(question, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n</question>"))


def recorded(questions: DataFrame, attempts: DataFrame, passages: DataFrame, outcome: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Rows to append for answered questions: runs, answers, citations and audit, keyed by hashes of what they describe.

    questions: answer_id, workspace_id, user_id, question, profile, model, latency_ms; attempts: answer_id, attempt, query, grade, note,
    top_score, candidates; passages: answer_id, attempt, position, chunk_id, rerank_score, fused_score; outcome: as outcomes() gives.
    """
    rank = F.struct((F.col("grade") == "good").cast("int"), F.coalesce("top_score", F.lit(0.0)), -F.col("attempt"))
    log = F.transform(F.array_sort(F.collect_list(F.struct("attempt", "query", "grade", "note", "candidates"))), lambda x: x)
    best = attempts.groupBy("answer_id").agg(F.max_by(F.struct("attempt", "query", "grade", "top_score"), rank).alias("best"), F.to_json(log).alias("candidates_json"), (F.count("*") - 1).alias("retry_count"))
    shown = passages.join(best.select("answer_id", F.col("best.attempt").alias("attempt")), ["answer_id", "attempt"], "left_semi")
    one = F.struct("position", "chunk_id", "rerank_score", F.round("fused_score", 6).alias("fused_score"))
    scores = shown.groupBy("answer_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("position"))).alias("rerank_scores_json"))
    all_ = questions.join(outcome, "answer_id").join(best, "answer_id", "left").join(scores, "answer_id", "left")
    all_ = all_.withColumn("run_id", F.sha2(F.concat(F.lit("run:"), F.col("answer_id").cast("string")), 256))
    runs = all_.select("run_id", "workspace_id", F.col("user_id").alias("asked_by"), "question", "candidates_json", F.coalesce("rerank_scores_json", F.lit("[]")).alias("rerank_scores_json"), F.col("best.grade").alias("grade_outcome"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "latency_ms", F.col("best.query").alias("final_query"), "profile", F.col("best.top_score").alias("top_score"), now.alias("created_at"))
    answers = all_.select("answer_id", "workspace_id", F.col("user_id").alias("asked_by"), F.col("run_id").alias("retrieval_run_id"), "question", "answer", "confidence", F.col("grounded").alias("groundedness_pass"), "flagged", "flag_reasons", F.lit(False).alias("general_knowledge"), "model", now.alias("created_at"))
    citations = all_.select("answer_id", F.posexplode("cited").alias("at", "chunk_id")).select("answer_id", "chunk_id", (F.col("at") + 1).alias("ordinal"))
    details = F.to_json(F.struct(F.col("user_id").alias("asked_by"), "confidence", "grounded", "flag_reasons", F.size("cited").alias("citations"), (F.coalesce("retry_count", F.lit(-1)) + 1).alias("retrieval_attempts"), "latency_ms", "redacted"))
    audit = all_.select("workspace_id", F.lit("agent").alias("actor_type"), F.lit("answer.generated").alias("action"), F.lit("agent_answer").alias("target_type"), F.col("answer_id").alias("target_id"), details.alias("details"), now.alias("created_at"))
    return {"runs": runs, "answers": answers, "citations": citations, "audit": audit}


def segments(answer: Column) -> Column:
    """Text and marker segments of an answer, in order: array<struct<text, marker>>."""
    parts = F.filter(F.split(answer, r"(?=\[\d{1,3}\])|(?<=\[\d{1,3}\])"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(p.alias("text"), F.regexp_extract(p, r"^\[(\d{1,3})\]$", 1).try_cast("int").alias("marker")))


def history_tail(turns: DataFrame, last: int = 8) -> DataFrame:
    """The last turns of each conversation, in order."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= last).drop("_nth")
