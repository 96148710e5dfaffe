"""Run records against plain Python on small cases, with questions that have nothing."""

from pyspark.sql import functions as F

from lodestone.operators import runs

Q = "id long, expect_answer boolean, expected array<string>, groups array<array<string>>, distractors array<string>, expected_tools array<string>, must_not_include array<string>"
A = "id long, nth int, answer string, answerable boolean, grounded boolean, flagged boolean, flag_reasons array<string>, confidence double, model string"


def records(spark, questions, replies, steps=(), answers=(), citations=(), retrieved=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    frames = [make(questions, Q), make(replies, "id long, reply string, models array<string>"), make(steps, "id long, step int, tool string, ok boolean, summary string"), make(answers, A), make(citations, "id long, nth int, ordinal int, chunk_id string"), make(retrieved, "id long, run int, rank int, chunk_id string")]
    return {r.id: r for r in runs.agent_records(*frames, "first").collect()}


def test_a_question_without_tools_or_answers(spark):
    r = records(spark, [(1, False, None, None, None, None, None), (2, True, ["a"], [], [], ["lookup_fact"], ["bad"])], [(1, "no", ["p", "q"]), (2, "a bad reply", [])])
    assert (r[1].refused, r[1].refusal_correct, r[1].model, r[1].grounded, r[1].routing_ok, r[1].document_tool_chosen) == (True, True, "p", None, None, "none")
    assert (r[1].answer, r[1].citations, r[1].retrieved_count, r[1].all_required_cited, r[1].cited_distractor) == ("no", [], 0, False, False)
    assert (r[2].refusal_correct, r[2].violations, r[2].routing_ok, r[2].model, r[2].reciprocal_rank) == (None, ["bad"], False, None, 0.0)


def test_several_answers_and_retrievals(spark):
    q = [(1, False, ["x", "y"], [["x"], ["y", "z"]], ["t"], ["explore_documents"], ["secret"])]
    steps = [(1, 2, "explore_documents", True, "ok"), (1, 1, "list_tasks", False, "ERROR: down"), (1, 3, "lookup_fact", True, "ok")]
    answers = [(1, 2, "two", True, True, True, ["b", "a"], 0.5, "second"), (1, 1, "one", False, False, False, ["a"], 0.25, "first")]
    cited = [(1, 2, 1, "z"), (1, 1, 2, "x"), (1, 1, 1, "o"), (1, 2, 2, "o")]
    got = [(1, 1, 1, "o"), (1, 1, 3, "y"), (1, 2, 1, "q"), (1, 2, 2, "x"), (1, 2, 3, "y")]
    r = records(spark, q, [(1, "see below", ["p"])], steps, answers, cited, got)[1]
    assert (r.answer, r.confidence, r.confidences, r.model, r.answered_by_fallback_model) == ("one\n\ntwo", 0.25, [0.25, 0.5], "first", True)
    assert (r.grounded, r.flagged, r.flag_reasons, r.document_tools, r.tool_errors, r.routing_ok) == (False, True, ["a", "b"], ["explore_documents", "lookup_fact"], ["ERROR: down"], True)
    assert (r.rank_of_expected, r.reciprocal_rank, r.retrieved_count) == (2, 0.5, 4)
    assert [(x.run, x.rank, x.chunk_id) for x in r.retrieved] == [(1, 1, "o"), (1, 3, "y"), (2, 1, "q"), (2, 2, "x")]
    assert (r.cited_position_of_expected, r.required_groups_cited, r.all_required_cited, r.cited_distractor) == (2, 2, True, False)
    assert (r.refused, r.refusal_correct) == (False, False)


def test_full_records_keep_order_and_excerpts(spark):
    q = spark.createDataFrame([(1, "q", True, ["b"]), (2, "q", False, None), (3, "no outcome", True, ["b"])], "id long, question string, expect_answer boolean, expected array<string>")
    o = spark.createDataFrame([(1, "a", True, "first"), (2, "b", False, None)], "id long, answer string, answerable boolean, model string")
    r = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "b")], "id long, rank int, chunk_id string")
    c = spark.createDataFrame([(1, 1, "b", "é" * 700)], "id long, ordinal int, chunk_id string, content string")
    got = {x.id: x for x in runs.full_records(q, o, r, c, "first").collect()}
    assert set(got) == {1, 2} and [x.chunk_id for x in got[1].retrieved] == ["a", "b"] and len(got[1].citations[0].excerpt) == runs.EXCERPT
    assert (got[1].rank_of_expected, got[1].cited_position_of_expected, got[1].refusal_correct, got[1].answered_by_fallback_model) == (2, 1, None, False)
    assert (got[2].retrieved, got[2].expected_chunk_cited, got[2].refused, got[2].refusal_correct, got[2].answered_by_fallback_model) == ([], False, True, True, True)


def test_rescored_ranks(spark):
    ids, passages = spark.range(1, 4), spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "a"), (9, 1, "b")], "id long, rank int, chunk_id string")
    expected = ids.select("id", F.lit("b").alias("chunk_id"))
    got = {r.id: (r.rank, r.retrieved, r.rank_unknown) for r in runs.repeated_rank(ids, passages, expected.unionByName(expected)).collect()}
    assert got == {1: (2, True, False), 2: (None, False, False), 3: (None, False, True)}
