"""Results files, their metrics, fields beside the model, totals of an ingest run."""

import json

from pyspark.sql import functions as F

from lodestone.operators import reporting


def test_results_and_their_metrics(spark, tmp_path):
    run = {"run": {"mode": "agent"}, "questions": [{"id": "q1", "rank": 2}, {"id": "q2", "rank": None}]}
    (tmp_path / "a.json").write_text(json.dumps(run, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"run": {}, "questions": [{"id": "q3", "rank": 1}]}))
    (tmp_path / "c.json").write_text(json.dumps({"run": {}, "questions": []}))
    rows = reporting.read_run(spark, f"{tmp_path}/*.json", "id:string,rank:int")
    assert sorted((r.mode, r.id, r["rank"]) for r in rows.collect()) == [("agent", "q1", 2), ("agent", "q2", None), ("full", "q3", 1)]
    place = reporting.write_metrics(rows.agg(F.count("rank").alias("ranked")), f"{tmp_path}/a.json")
    assert place.endswith("/a.metrics.json") and spark.read.json(place).first().ranked == 2


def test_fields_beside_the_model(spark, tmp_path):
    lines = ["// golden", "", json.dumps({"id": "q1", "lost": ["a", 5, "b", None, {"x": 1}]}), json.dumps({"id": "q2"}), json.dumps({"id": "q3", "lost": "text"}), "{broken"]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    assert sorted(map(tuple, reporting.raw_field(spark, str(tmp_path), "lost").collect())) == [("q1", "a"), ("q1", "b")]


def test_ingest_totals_and_empty_corpus(spark):
    r = spark.createDataFrame([("a", "ready", 100, 100), ("b", "skipped", 40, 0), ("c", "failed", 900, 3)], "file_name string, status string, passages long, embedded long")
    assert tuple(reporting.ingest_totals(r).first()) == (3, 1, 1, 1, 140, 103, True)
    assert tuple(reporting.ingest_totals(r.where("false")).first()) == (0, 0, 0, 0, 0, 0, False)
    docs = spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "doc_id long, workspace_id long")
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc_id long, chunk_index int, content string")
    got = {r.doc_id: [c.content for c in r.chunks] for r in reporting.corpus(docs, chunks, 7).collect()}
    assert got == {1: ["a", "b"], 3: []}


def test_review_feed_defaults(spark):
    reviews = spark.createDataFrame([(1, "answer", 5, "approved", None, None, "2024-01-02 00:00:00", 9), (1, "answer", 6, "corrected", "n", "c", "2024-01-03 00:00:00", 9)], "workspace_id long, review_target_type string, review_target_id long, decision string, notes string, correction string, created_at string, reviewer_id long")
    answers = spark.createDataFrame([(5, "why?")], "answer_id long, question string")
    actions = spark.createDataFrame([(8, 1, "rejected", '{"title": "T"}', "2024-01-01 00:00:00", 10), (9, 1, "pending", "{}", None, None)], "action_id long, workspace_id long, status string, proposed_payload string, decided_at string, decided_by long")
    users = spark.createDataFrame([(9, "", "a@b.c"), (10, "Ann", "x@y.z")], "user_id long, full_name string, email string")
    got = [(r.place, r.kind, r.target_id, r.summary, r.by) for r in reporting.review_feed(reviews, answers, actions, users).orderBy("place").collect()]
    assert got == [(1, "answer", 6, "", "a@b.c"), (2, "answer", 5, "why?", "a@b.c"), (3, "action", 8, "T", "Ann")]
    assert reporting.review_feed(reviews, answers, actions, users, limit=1).count() == 1
