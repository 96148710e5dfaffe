"""Document tools: the limit of a turn, calls without passages, unreadable drafts, and what passages tried."""

from pyspark.sql import functions as F

from lodestone.operators import answers, document_tools, tools


def answered(spark, calls, found, draft=None):
    c = spark.createDataFrame(calls, "request_id long, turn_id long, tool string, question string")
    p = spark.createDataFrame(found, "query_id long, position int, chunk_id string, rerank_score double, content string, injection_reasons array<string>")
    asked = []

    def search(own, profile):
        asked.append((profile.name, sorted(r.query_id for r in own.collect())))
        return p.join(own.select("query_id"), "query_id", "left_semi")

    said = lambda q, own: F.struct(F.lit(True).alias("answerable"), F.lit(True).alias("grounded"), F.array().cast("array<string>").alias("unsupported"), F.array(F.struct(F.concat(F.lit("On "), q).alias("text"), F.array(F.lit(1)).alias("sources"))).alias("sentences"))
    out = document_tools.answer_calls(c, search, draft or said)
    return asked, {k: {r[0]: r for r in df.collect()} for k, df in out.items()}


def test_calls_of_a_turn(spark):
    calls = [(5, 1, "lookup_fact", "a"), (3, 1, "explore_documents", "b"), (4, 1, "list_tasks", "c"), (9, 1, "lookup_fact", "d"), (2, 2, "summarize_documents", "e")]
    found = [(3, 2, "y", 0.1, "t", None), (3, 1, "x", 0.9, "t", ["override"]), (5, 1, "z", 0.3, "t", ["role"]), (9, 1, "w", 0.9, "t", ["never seen"])]
    asked, got = answered(spark, calls, found)
    assert asked == [("lookup", [5]), ("explore", [3]), ("summarize", [2])]
    assert {k: r.nth for k, r in got["replies"].items()} == {3: 1, 5: 2, 9: 3, 2: 1}
    assert got["replies"][9].reply == tools.TOO_MANY_ANSWERS and 9 not in got["answers"]
    assert got["replies"][3].reply.startswith("CHECKED ANSWER #1") and "On b [1]" in got["replies"][3].reply
    assert (got["answers"][3].grade, got["answers"][3].confidence, got["answers"][5].grade, got["answers"][5].confidence) == ("good", 0.9, "ambiguous", 0.18)
    assert (got["turns"][1].tainted, got["turns"][1].taint_reasons) == (True, ["override", "role"])
    assert (got["turns"][2].tainted, got["answers"][2].answer, got["answers"][2].grade) == (False, answers.NOTHING_FOUND, "weak")
    assert got["answers"][2].answerable is False and answers.NOTHING_FOUND in got["replies"][2].reply


def test_unreadable_drafts_and_no_calls(spark):
    kind = "struct<answerable:boolean,grounded:boolean,unsupported:array<string>,sentences:array<struct<text:string,sources:array<int>>>>"
    _, got = answered(spark, [(1, 1, "lookup_fact", "a")], [(1, 1, "x", None, "t", None)], lambda q, own: F.lit(None).cast(kind))
    assert (got["answers"][1].grounded, got["answers"][1].flagged, got["answers"][1].answer, got["answers"][1].grade) == (False, True, answers.NO_ANSWER, "ungraded")
    _, got = answered(spark, [(1, 1, "list_tasks", "a")], [])
    assert got == {"replies": {}, "answers": {}, "turns": {}}
