"""Language identification by a byte convolutional network in numpy.

Filters of several widths slide over windows of WINDOW bytes (A-Z lower-cased); max pooling and a softmax
layer follow. As bytes are one-hot, a filter of width w is w table lookups; for scoring, pairs of bytes
share one lookup. Every window of a whole text is scored and the mean log-probability decides.

Defined results: null texts and texts without a letter are `und` with score 0; texts shorter than a window
are padded with zero bytes; the last window of a longer text ends with the text; without a training row
every text with a letter is `und` with score 0; ties go to the language first by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, slices, table, text_bytes

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Training documents of each language (about): the bound of the fitting sample of labelled rows. Their whole texts are used.
SAMPLE = 800
#: Windows that an epoch draws from a text on average, of all that it has.
WINDOWS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover each text whole (rows of WINDOW bytes) and the text of each; an empty text has one of zeros."""
    size = np.diff(off)
    many = np.maximum(1, -(-size // WINDOW))
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.maximum(np.minimum(nth * WINDOW, size[doc] - WINDOW), 0)
    at = (off[:-1][doc] + start)[:, None] + np.arange(WINDOW)
    inside = (start[:, None] + np.arange(WINDOW)) < size[doc][:, None]
    padded = np.append(_LOWER[data], np.uint8(0))
    return padded[np.where(inside, at, len(data))], doc


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, share: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> dict:
    """Filters {width: (width, 256, FILTERS)}, biases and the softmax layer, by Adam on cross-entropy.

    share: of each window in its text, so that a text counts alike however long it is: an epoch draws windows by it, WINDOWS of a text
    on average, and every window of every text may be drawn.
    """
    rng = np.random.default_rng(seed)
    p = {f"w{w}": rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    hidden = FILTERS * len(WIDTHS)
    p |= {"c": np.zeros(hidden, np.float32), "v": rng.normal(0, 0.1, (hidden, classes)).astype(np.float32), "b": np.zeros(classes, np.float32)}
    m, s = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    texts = np.bincount(y, share, classes)
    weight = (texts.sum() / (classes * np.maximum(texts, 1e-9)))[y]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(rng.random(len(x)) < WINDOWS * share))  # others in each epoch
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            own, pooled, best = x[rows], [], []
            for w in WIDTHS:
                conv = sum(p[f"w{w}"][j][own[:, j : WINDOW - w + 1 + j]] for j in range(w))
                best.append(conv.argmax(axis=1))
                pooled.append(conv.max(axis=1))
            z = np.concatenate(pooled, axis=1) + p["c"]
            h = np.maximum(z, 0)
            d = _softmax(h @ p["v"] + p["b"])
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= (weight[rows] / len(rows))[:, None]
            g = {"v": h.T @ d, "b": d.sum(axis=0)}
            back = (d @ p["v"].T) * (z > 0)
            g["c"] = back.sum(axis=0)
            f = np.arange(FILTERS)[None]
            for i, w in enumerate(WIDTHS):
                grad = np.zeros_like(p[f"w{w}"])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(grad[j], (np.take_along_axis(own, best[i] + j, axis=1), np.broadcast_to(f, part.shape)), part)
                g[f"w{w}"] = grad
            t += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                s[name] = 0.999 * s[name] + 0.001 * g[name] ** 2
                p[name] = (p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return p


class Network:
    """The trained network with lookups of byte pairs."""

    def __init__(self, p: dict):
        self.p = p
        self.tables = {}
        for w in WIDTHS:
            own = p[f"w{w}"]
            self.tables[w] = [(own[j][:, None] + own[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else own[j] for j in range(0, w, 2)]

    def log_probs(self, x: np.ndarray, chunk: int = 128) -> np.ndarray:
        out = np.empty((len(x), len(self.p["b"])), np.float32)
        for k in range(0, len(x), chunk):
            own = x[k : k + chunk]
            pair = own[:, :-1].astype(np.uint16) << 8 | own[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                conv = None
                for i, lookup in enumerate(self.tables[w]):
                    j = 2 * i
                    part = lookup[(pair if j + 1 < w else own)[:, j : j + n]]
                    conv = part if conv is None else np.add(conv, part, out=conv)
                pooled.append(conv.max(axis=1))
            h = np.maximum(np.concatenate(pooled, axis=1) + self.p["c"], 0)
            z = h @ self.p["v"] + self.p["b"]
            z -= z.max(axis=1, keepdims=True)
            out[k : k + chunk] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
    return found


def held_out() -> F.Column:
    """False for rows without doc_id, which may be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], dict | None]:
    """Languages and network, from about SAMPLE documents of each language, chosen by a hash of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").count().collect()  # a row for each language: the classes of the network
    if not counts:
        return [], None
    names = sorted(r.lang for r in counts)
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, SAMPLE / r["count"])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) / 1_000_003.0
    picked = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def cut(batches):
        for batch in slices(batches):
            data, off, _ = text_bytes(batch.column("text"))
            x, doc = windows(data, off)
            end = np.searchsorted(doc, np.arange(batch.num_rows), side="right")
            rows = [r.tobytes() for r in np.split(x, end[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "bytes"])

    found = picked.mapInArrow(cut, "doc_id long, lang string, bytes binary").toArrow().sort_by("doc_id")
    texts = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW) for b in found.column("bytes").to_pylist()]
    many = np.array([len(t) for t in texts])
    y = np.repeat([names.index(v) for v in found.column("lang").to_pylist()], many)
    return names, fit(np.concatenate(texts), y, len(names), np.repeat(1 / many, many))


def predict(docs: DataFrame, model: tuple[list[str], dict | None]) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept: list[Network] = []

    def run(batches):
        names, p = sent.value
        if p is not None and not kept:
            kept.append(Network(p))
        for batch in slices(batches, 2 << 20):
            data, off, null = text_bytes(batch.column("text"))
            known = has_letter(data, off) & ~null & (p is not None)
            lang, score = np.full(len(null), "und", object), np.zeros(len(null))
            if known.any():
                x, doc = windows(data, off)
                use = known[doc]
                logs = kept[0].log_probs(x[use])
                doc = doc[use]
                many = np.maximum(np.bincount(doc, minlength=len(null)), 1)
                mean = np.stack([np.bincount(doc, logs[:, c], len(null)) for c in range(len(names))], axis=1) / many[:, None]
                prob = _softmax(mean)
                best = prob.argmax(axis=1)
                lang[known] = np.array(names, object)[best[known]]
                score[known] = prob[np.arange(len(null)), best][known]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
