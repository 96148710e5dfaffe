"""Keyed state machines of a stream: the states of a document with a timer for stuck ones, and a cache of responses kept across batches.

Both need the RocksDB state store (`use_rocksdb`). The document machine has a batch form that runs the same steps.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The states of a document and the stages of its processing.
PENDING, PROCESSING, READY, FAILED = "pending", "processing", "ready", "failed"
#: Steps that a document may take; processing again starts from ready or failed.
STEPS = {None: (PENDING,), PENDING: (PROCESSING, FAILED), PROCESSING: (PROCESSING, READY, FAILED), READY: (PROCESSING,), FAILED: (PROCESSING,)}
STUCK = "Processing did not finish in time."
HISTORY = "document_id string, at timestamp, status string, stage string, outcome string"
_STATE = "status string, stage string, at double"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def step(now: tuple | None, status: str, stage: str | None, at: float, limit: float) -> tuple[tuple | None, list[tuple]]:
    """State (status, stage, at) after a change, and rows (at, status, stage, outcome): what was taken, repeated, or refused and why.

    A document that was being processed for longer than `limit` seconds failed before the change came.
    """
    rows = []
    if now is not None and now[0] == PROCESSING and at > now[2] + limit:
        now = (FAILED, None, now[2] + limit)
        rows.append((now[2], FAILED, None, STUCK))
    kind = now[0] if now else None
    if now is not None and at < now[2]:
        return now, [*rows, (at, status, stage, f"refused: {kind} is later")]
    if now is not None and (status, stage) == now[:2]:
        return now, [*rows, (at, status, stage, "repeated")]
    if status not in STEPS.get(kind, ()):
        return now, [*rows, (at, status, stage, f"refused: {kind or 'new'} to {status}")]
    return (status, stage, at), [*rows, (at, status, stage, "taken")]


def _frame(key: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(key, *r) for r in rows], columns=["document_id", "at", "status", "stage", "outcome"])
    out["at"] = pd.to_datetime(out["at"], unit="s")
    return out


def _ordered(pdf: pd.DataFrame) -> Iterator[tuple]:
    text = lambda v: None if v is None or pd.isna(v) else v
    for at, status, stage in sorted(zip(pdf["seconds"], pdf["status"], map(text, pdf["stage"]), strict=True), key=lambda r: (r[0], r[1], r[2] or "")):
        yield at, status, stage


class DocumentMachine(StatefulProcessor):
    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  Spark's names
        now, out = (tuple(self.state.get()) if self.state.exists() else None), []
        for at, status, stage in _ordered(pd.concat(list(rows))):
            now, more = step(now, status, stage, at, self.limit)
            out += more
        if now is not None:
            self.state.update((now[0], now[1], float(now[2])))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if now[0] == PROCESSING:
                self.handle.registerTimer(int((now[2] + self.limit) * 1000))
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        status, stage, at = self.state.get()
        if status == PROCESSING:
            self.state.update((FAILED, None, float(at + self.limit)))
            yield _frame(key[0], [(at + self.limit, FAILED, None, STUCK)])

    def close(self) -> None:
        pass


def _changes(changes: DataFrame) -> DataFrame:
    return changes.select(F.col("document_id").cast("string").alias("document_id"), "status", "stage", "at", (F.unix_micros("at") / 1e6).alias("seconds"))


def document_history(changes: DataFrame, limit: float = 3600.0, watermark: str = "1 hour") -> DataFrame:
    """What became of each change (document_id, status, stage, at), in the order of its time: a stream's, with its state kept.

    Changes that come later than the watermark allows are dropped by Spark; a stuck document fails by event time.
    """
    rows = _changes(changes.withWatermark("at", watermark))
    return rows.groupBy("document_id").transformWithStateInPandas(DocumentMachine(limit), HISTORY, "Append", "EventTime")


def document_history_batch(changes: DataFrame, limit: float = 3600.0, until=None) -> DataFrame:
    """Batch form over all changes; until: time by which stuck documents fail (null: only where a later change shows it)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None

        def end() -> list[pd.DataFrame]:
            stuck = key is not None and now is not None and now[0] == PROCESSING and until is not None and now[2] + limit <= until
            return [_frame(key, [(now[2] + limit, FAILED, None, STUCK)])] if stuck else []

        for pdf in frames:
            for k, own in pdf.groupby("document_id", sort=False):
                if k != key:
                    yield from end()
                    key, now = k, None
                out = []
                for at, status, stage in _ordered(own):
                    now, more = step(now, status, stage, at, limit)
                    out += more
                yield _frame(key, out)
        yield from end()

    rows = _changes(changes)
    # a task streams its documents in order: no document's changes are held together
    return rows.repartition("document_id").sortWithinPartitions("document_id", "seconds", "status", F.coalesce("stage", F.lit(""))).mapInPandas(run, HISTORY)


class ResponseCache(StatefulProcessor):
    """Responses by key in one shard: a fixed number, the least recently used leave first; each expires after its time to live."""

    def __init__(self, scorer: Callable[[pd.Series], pd.Series], size: int, live_ms: int | None):
        self.scorer, self.size, self.live = scorer, size, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "keys array<string>, scores array<double>, used array<long>, made array<long>, clock long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("request_id")
        keys, scores, ticks, made, clock = self.kept.get() if self.kept.exists() else ([], [], [], [], 0)
        now = int(time.time() * 1000)
        alive = [i for i, m in enumerate(made) if self.live is None or now - m <= self.live]
        used, value, since = ({keys[i]: column[i] for i in alive} for column in (ticks, scores, made))
        out = []
        for request_id, k, request in zip(pdf["request_id"], pdf["k"], pdf["request"], strict=True):
            clock += 1
            out.append((request_id, k, request, k not in used))
            used[k] = clock
            if len(used) > self.size:
                del used[min(used, key=used.get)]
        asked = pd.DataFrame(out, columns=["request_id", "k", "request", "fresh"])
        new = asked[asked["fresh"]].drop_duplicates("k")
        if len(new):
            value |= dict(zip(new["k"], map(float, self.scorer(new["request"])), strict=True))
            since |= dict.fromkeys(new["k"], now)
        self.kept.update((list(used), [value[k] for k in used], list(used.values()), [since[k] for k in used], clock))
        yield pd.DataFrame({"request_id": asked["request_id"], "score": asked["k"].map(value), "fresh": asked["fresh"]})

    def close(self) -> None:
        pass


def cached_responses(requests: DataFrame, scorer: Callable[[pd.Series], pd.Series], size: int = 256, shards: int = 64, live_ms: int | None = None) -> DataFrame:
    """request_id, score, fresh (scored now) of a stream of requests (request_id, request): equal requests share a response kept in state.

    The cache is dealt to shards by the request's hash, each of `size` responses; the scorer sees a batch's new requests of a shard at
    once, a key that left and came back within the batch only once. live_ms: time to live in processing time.
    """
    k = F.sha2(F.col("request").cast("string"), 256)
    rows = requests.select("request_id", "request", k.alias("k"), F.pmod(F.xxhash64("request"), F.lit(shards)).cast("int").alias("shard"))
    schema = f"request_id {requests.schema['request_id'].dataType.simpleString()}, score double, fresh boolean"
    return rows.groupBy("shard").transformWithStateInPandas(ResponseCache(scorer, size, live_ms), schema, "Append", "None")
