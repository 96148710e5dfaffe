"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1, a bounded sample. The unlabelled set is the text of every document outside the
held-out fold: its features are written once, and its part of the risk and of the gradient is summed over all of them in Spark. A
logistic scorer over features of the whole text minimises the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])
A first fit in numpy takes labelled rows, with their labels not looked at, for the unlabelled set; STEPS steps over all documents
follow, scaled by the curvature of that sample. The class prior is the least ratio of the shares of unlabelled and positive
rows above a threshold, by a scorer fitted with prior 1/2, over all documents too.

Defined results: null and empty texts have the features of the empty text and get its score; without any
positive in the training fold every score is 0.5 without labels and 0 with negative ones only; a doc_id that
has both labels is a positive; repeated rows score alike; rows without doc_id are unlabelled text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, doc_columns, materialize, slices, table

#: Most labelled documents in the training sample of each set, taken in the order of a hash of doc_id.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 8_000, 12_000
#: Steps over all unlabelled text.
STEPS = 5
THRESHOLD = 0.7
#: Bytes of text whose features are made at once: the work takes some eighty times as much memory.
SLICE = 1 << 18

# classes of bytes: each ASCII byte alone, all others together
_CLASS = np.minimum(np.arange(256), 128)
# coarse kinds for transitions: lower, upper, digit, blank, line end, sentence mark, other mark, beyond ASCII
_KIND = np.full(256, 6)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 32]], _KIND[[10, 13]], _KIND[[33, 44, 46, 63]], _KIND[128:] = 0, 1, 2, 3, 4, 5, 7
_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True
N_FEATURES = 129 + 64 + 5


def _distinct_share(words: Words) -> np.ndarray:
    n = words.count()
    doc = np.repeat(np.arange(len(n)), n)
    key = words.hash ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return np.bincount(doc[order][new], minlength=len(n)) / np.maximum(n, 1)


def features(column: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each whole text."""
    words, lines = Words(column), Words(column, space=_LINE_END)
    size = np.diff(words.off)
    n = len(size)
    doc = np.repeat(np.arange(n), size)
    data = words.data
    share = np.bincount(doc * 129 + _CLASS[data], minlength=n * 129).reshape(n, 129)
    kind = _KIND[data]
    inside = doc[1:] == doc[:-1]
    steps = np.bincount((doc[1:] * 64 + kind[:-1] * 8 + kind[1:])[inside], minlength=n * 64).reshape(n, 64)
    many = np.maximum(size, 1)[:, None]
    count = words.count()
    extra = np.stack([np.log1p(count), _distinct_share(words), _distinct_share(lines), (np.bincount(np.repeat(np.arange(n), count), words.end - words.start, n) / np.maximum(count, 1)) / 10, np.log1p(lines.count())], axis=1)
    return np.concatenate([np.sqrt(share / many), np.sqrt(steps / many), extra], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.03, ridge: float = 1e-4) -> dict:
    """Weights that minimise the non-negative risk; where the bracket is negative, its gradient is reversed."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (standard(x, {"mean": mean, "scale": scale}) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        # logistic loss: d loss(+) = s - 1, d loss(-) = s
        bracket = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gp, gu = prior * (sp - 1) / len(p), su / len(u)
        gn = -prior * sp / len(p)
        if bracket < 0:
            grad = np.append(-(p.T @ gn + u.T @ gu), -(gn.sum() + gu.sum()))
        else:
            grad = np.append(p.T @ (gp + gn) + u.T @ gu, (gp + gn).sum() + gu.sum())
        grad[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return {"mean": mean, "scale": scale, "w": w, "b": b}


def standard(x: np.ndarray, model: dict) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -8, 8).astype(np.float64)


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior, from the shares of both sets above the same thresholds."""
    return float(min(max(min(unlabelled / np.maximum(positive, 1e-9)), 0.01), 0.99))


class Unlabelled:
    """Features of every document, written once; sums over all of them go through Spark's aggregates."""

    def __init__(self, docs: DataFrame):
        def pack(batches):
            for batch in slices(batches, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([features(batch.column("text")).tobytes()], pa.binary())], ["x"])

        self.rows = materialize(docs.mapInArrow(pack, "x binary"), "quality-features")

    def summed(self, of) -> np.ndarray:
        """Sum over all documents of the rows that `of` makes from a batch of features; a task sends one row of sums."""

        def run(batches):
            total = None
            for batch in batches:
                for x in batch.column("x"):
                    part = of(np.frombuffer(x.as_buffer(), np.float32).reshape(-1, N_FEATURES)).sum(axis=0)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["k", "v"])

        found = self.rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toArrow()
        return np.asarray(found["v"], np.float64)


def refine(model: dict, positive: np.ndarray, sample: np.ndarray, unlabelled: Unlabelled, prior: float, steps: int = STEPS, ridge: float = 1e-3) -> dict:
    """Steps down the risk over all documents: its gradient, scaled by the curvature of the sample, and of several lengths the one of least risk.

    A second pass over the features weighs the lengths, 0 among them, so a step never raises the risk.
    """
    one = lambda x: np.concatenate([standard(x, model), np.ones((len(x), 1))], axis=1)
    p, u = one(positive), one(sample)
    w = np.append(model["w"], model["b"])
    keep = ridge * np.append(np.ones(len(w) - 1), 0)
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of a negative; loss(-z) of a positive

    for _ in range(steps):
        *total, lost, n = unlabelled.summed(lambda x: np.concatenate([(x := one(x)) * _sigmoid(z := x @ w)[:, None], loss(z)[:, None], np.ones((len(x), 1))], axis=1))  # noqa: B023
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        slope = prior * (p.T @ (sp - 1)) / len(p) + keep * w
        if lost / n > prior * loss(p @ w).mean():
            slope = slope + np.array(total) / n - prior * (p.T @ sp) / len(p)
            bend = (u.T * (su * (1 - su))) @ u / len(u)
        else:
            bend = prior * (p.T * (sp * (1 - sp))) @ p / len(p)
        move = np.linalg.solve(bend + np.diag(keep + 1e-3), slope)
        tries = [w - t * move for t in (0, 0.03, 0.1, 0.3, 1)]
        *lost, n = unlabelled.summed(lambda x: np.concatenate([loss(one(x) @ np.stack(tries, 1)), np.ones((len(x), 1))], axis=1))  # noqa: B023
        risks = [prior * loss(-(p @ v)).mean() + max(0.0, e / n - prior * loss(p @ v).mean()) + (keep * v * v).sum() / 2 for v, e in zip(tries, lost, strict=True)]
        w = tries[int(np.argmin(risks))]
    return model | {"w": w[:-1], "b": w[-1]}


def apply_model(model: dict, x: np.ndarray) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(x), model["b"])
    return _sigmoid(standard(x, model) @ model["w"] + model["b"])


def held_out() -> F.Column:
    """False for rows without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, ids: DataFrame, size: int) -> np.ndarray:
    """Features of at most size documents: ids by hash, then their whole texts by a join with those few ids."""
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    chosen = docs.join(F.broadcast(picked), "doc_id", "left_semi")  # at most `size` ids

    def rows(batches):
        for batch in slices(batches, SLICE):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32()))], ["x"])

    found = chosen.mapInArrow(rows, "x array<float>").toArrow()
    return np.array(found.column("x").to_pylist(), np.float32).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    docs = doc_columns(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & ~held_out())
    positive = _sample(docs, known.where("quality = 1").select("doc_id").distinct(), SAMPLE_POSITIVE)
    if not len(positive):
        return {"w": None, "b": 0.5 if known.isEmpty() else 0.0}
    sample = _sample(docs, known.select("doc_id").distinct(), SAMPLE_UNLABELLED)
    unlabelled = Unlabelled(docs.where(~held_out()))
    first = fit_nnpu(positive, sample, 0.5)
    own = apply_model(first, positive)
    cuts = np.quantile(own, np.linspace(0.05, 0.5, 10))
    above = lambda s: np.concatenate([s[:, None] >= cuts, np.ones((len(s), 1))], axis=1)
    counts = unlabelled.summed(lambda x: above(apply_model(first, x)))
    prior = least_ratio(above(own).mean(axis=0)[:-1], counts[:-1] / counts[-1])
    return refine(fit_nnpu(positive, sample, prior), positive, sample, unlabelled, prior) | {"prior": prior}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(apply_model(sent.value, features(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that reach the threshold, with all their columns: the score travels with its own row, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for batch in slices(batches, SLICE):
            yield batch.filter(pa.array(apply_model(sent.value, features(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
