"""State machines of streams against their batch forms, with late and repeated rows and a restart."""

import datetime as dt

import pytest

from lodestone.streaming import machines

START = dt.datetime(2024, 1, 1)
CHANGES = "document_id string, status string, stage string, at timestamp"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    machines.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


FILES = [
    [("a", "pending", None, 0), ("a", "processing", "parsing", 1), ("b", "pending", None, 0), ("b", "ready", None, 2), ("c", "processing", "parsing", 3), ("d", "pending", None, 1), ("d", "processing", "parsing", 2)],
    [("a", "processing", "embedding", 5), ("a", "processing", "embedding", 6), ("b", "processing", "parsing", 4), ("b", "pending", None, 3), ("d", "ready", None, 70)],
    [("a", "ready", None, 8), ("b", "failed", None, 9), ("b", "processing", "parsing", 10), ("e", "pending", None, 200)],
    [("a", "processing", "parsing", 210), ("e", "failed", None, 400)],
]


def stream(spark, folder, checkpoint, out):
    q = machines.document_history(spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(folder), 3600.0, "30 days")
    q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_document_machine_equals_the_batch_form_over_a_restart(spark, rocks, tmp_path):
    every = []
    for part in (FILES[:2], FILES[2:]):  # the second run goes on from the first one's checkpoint
        for rows in part:
            own = [(d, s, g, at(m)) for d, s, g, m in rows]
            every += own
            spark.createDataFrame(own, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream(spark, f"{tmp_path}/in", f"{tmp_path}/c", f"{tmp_path}/out")
    got = sorted((r.document_id, r.at, r.status, r.stage or "", r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    changes = spark.createDataFrame(every, CHANGES)
    assert len(got) == len(every) + sum(r[-1] == machines.STUCK for r in got)
    by = lambda d: [r[2:] for r in got if r[0] == d]
    assert by("c") == [("processing", "parsing", "refused: new to processing")]
    assert by("d") == [("pending", "", "taken"), ("processing", "parsing", "taken"), ("failed", "", machines.STUCK), ("ready", "", "refused: failed to ready")]
    assert ("processing", "embedding", "repeated") in by("a") and ("failed", "", "taken") in by("e")
    # in order of time, as a batch sees them, the documents without late changes have the same history
    batch = sorted((r.document_id, r.at, r.status, r.stage or "", r.outcome) for r in machines.document_history_batch(changes).collect())
    assert [r for r in batch if r[0] != "b"] == [r for r in got if r[0] != "b"]
    assert ("pending", "", "refused: processing is later") not in by("b") and len(by("b")) == len([r for r in batch if r[0] == "b"])


def test_stuck_documents_fail_by_event_time(spark, rocks, tmp_path):
    for i, own in enumerate([[("x", "pending", None, 0), ("x", "processing", "parsing", 1)], [("y", "pending", None, 300)], [("y", "processing", "parsing", 301)]]):
        spark.createDataFrame([(d, s, g, at(m)) for d, s, g, m in own], CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        q = machines.document_history(spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in/*"), 3600.0, "1 minute")
        q = q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = sorted((r.document_id, r.at, r.status, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert ("x", at(61), "failed", machines.STUCK) in got and not any(r[0] == "y" and r[2] == "failed" for r in got)
    changes = spark.createDataFrame([("x", "pending", None, at(0)), ("x", "processing", "parsing", at(1))], CHANGES)
    until = (at(300) - dt.datetime(1970, 1, 1)).total_seconds()
    assert (at(61), machines.STUCK) in [(r.at, r.outcome) for r in machines.document_history_batch(changes, 3600.0, until).collect()]


def test_responses_are_kept_across_batches_and_the_oldest_leave(spark, rocks, tmp_path):
    length = lambda requests: requests.str.len().astype(float)
    batches = [["aa", "b", "aa", "ccc"], ["aa", "b"], ["dddd", "eeeee", "aa"], ["b", "ccc", "aa"]]
    n, fresh = 0, []
    for i, own in enumerate(batches):
        spark.createDataFrame([(n + j, r) for j, r in enumerate(own)], "request_id long, request string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        n += len(own)
        source = spark.readStream.schema("request_id long, request string").parquet(f"{tmp_path}/in/*")
        q = machines.cached_responses(source, length, size=3, shards=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    flat = [r for own in batches for r in own]
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("request_id").collect()
    assert [r.score for r in got] == [float(len(r)) for r in flat]
    kept: list[str] = []
    for r in flat:  # least recently used of three
        fresh.append(r not in kept)
        kept = [k for k in kept if k != r] + [r]
        kept = kept[-3:]
    assert [r.fresh for r in got] == fresh and fresh.count(True) == 8
