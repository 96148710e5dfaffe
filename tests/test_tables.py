"""Changes by key leave other buckets' files alone; several tables change together or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import tables, work


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = tables.KeyedTable(path, ("id",), 16)
    t.create(spark.range(200).select("id", (F.col("id") * 2).alias("v"), F.lit("a").alias("s")))
    before = files(path)
    t.merge(changed=spark.createDataFrame([(5, 0, "new"), (900, 1, "new")], "id long, v long, s string"), gone=spark.createDataFrame([(7,), (5000,)], "id long"))
    expected = {i: (i, i * 2, "a") for i in range(200) if i != 7} | {5: (5, 0, "new"), 900: (900, 1, "new")}
    assert rows(t.read(spark)) == sorted(expected.values())
    bucket = lambda ids: {r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(t._bucket()).collect()}
    touched = bucket([5, 900, 7, 5000])
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {int(f.rpartition("bucket=")[2].partition("/")[0]) for f in before.keys() - same} == touched and len(same) >= 12
    assert rows(t.lookup(spark.createDataFrame([(5,), (7,)], "id long"))) == [(5, 0, "new")]


def test_buckets_that_lose_all_rows_and_composite_keys(spark, tmp_path):
    t = tables.KeyedTable(f"{tmp_path}/t", ("a", "b"), 4)
    start = [(a, b, "x") for a in range(3) for b in ("p", "q")]
    t.create(spark.createDataFrame(start, "a long, b string, v string"))
    t.delete(spark.createDataFrame([(a, b) for a, b, _ in start if (a, b) != (2, "q")], "a long, b string"))
    assert rows(t.read(spark)) == [(2, "q", "x")]
    t.upsert(spark.createDataFrame([(0, "p", "back"), (2, "q", "y")], "a long, b string, v string"))
    assert rows(t.read(spark)) == [(0, "p", "back"), (2, "q", "y")]
    t.merge(gone=spark.createDataFrame([], "a long, b string"))
    assert t.read(spark).count() == 2


@pytest.fixture
def ledger(tmp_path):
    return tables.Ledger(f"{tmp_path}/l", {"answers": ("answer_id",), "citations": ("answer_id", "ordinal")})


def test_batches_are_seen_whole_or_not_at_all(spark, ledger):
    a = lambda *x: spark.createDataFrame(x, "answer_id long, text string")
    c = lambda *x: spark.createDataFrame(x, "answer_id long, ordinal int")
    assert ledger.read(spark, "answers") is None
    assert ledger.commit(spark, "b1", {"answers": a((1, "one")), "citations": c((1, 1), (1, 2))})
    assert not ledger.commit(spark, "b1", {"answers": a((1, "other"))})  # the batch came again

    fail = F.udf(lambda i: 1 // 0, "int")
    with pytest.raises(Exception, match="division"):  # between the two tables
        ledger.commit(spark, "b2", {"answers": a((2, "two")), "citations": c((2, 1)).withColumn("ordinal", fail("ordinal"))})
    assert rows(ledger.read(spark, "answers")) == [(1, "one")] and ledger.read(spark, "citations").count() == 2
    assert ledger.commit(spark, "b2", {"answers": a((2, "two"), (1, "changed"))}, gone={"citations": c((1, 2))})
    assert rows(ledger.read(spark, "answers")) == [(1, "changed"), (2, "two")] and rows(ledger.read(spark, "citations")) == [(1, 1)]


def test_rules_are_checked_before_anything_is_published(spark, ledger):
    a = spark.createDataFrame([(1, "one")], "answer_id long, text string")
    c = spark.createDataFrame([(1, 1), (2, 1)], "answer_id long, ordinal int")
    orphan = {"citations have answers": lambda _, staged: staged["citations"].join(staged["answers"], "answer_id", "left_anti")}
    with pytest.raises(tables.RuleBroken, match="citations have answers: 1"):
        ledger.commit(spark, "b1", {"answers": a, "citations": c}, rules=orphan)
    with pytest.raises(tables.RuleBroken, match="answers holds a key once"):
        ledger.commit(spark, "b1", {"answers": a.union(a), "citations": c})
    assert ledger.read(spark, "answers") is None
    assert ledger.commit(spark, "b1", {"answers": a, "citations": c.where("answer_id = 1")}, rules=orphan)


def test_approval_is_one_batch(spark, tmp_path):
    keys = {"actions": ("action_id",), "tasks": ("task_id",), "audit": ("target_id", "action")}
    ledger = tables.Ledger(f"{tmp_path}/l", keys)
    members = spark.createDataFrame([(1, 9, "Admin")], "workspace_id long, user_id long, auth_role string")
    actions = spark.createDataFrame([(7, 1, "pending", '{"title": "T"}', None)], "action_id long, workspace_id long, status string, proposed_payload string, decided_at timestamp")
    ledger.commit(spark, "load", {"actions": actions})
    ids = spark.createDataFrame([(7,)], "action_id long")
    for again in (True, False):
        done = work.approve(ledger.read(spark, "actions"), ids, members, 9, F.lit("2024-01-01").cast("timestamp"))
        assert ledger.commit(spark, "approve-7", done) is again
    assert ledger.read(spark, "actions").first().status == "approved"
    assert ledger.read(spark, "tasks").first().title == "T" and ledger.read(spark, "audit").count() == 1
