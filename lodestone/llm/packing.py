"""Packing along a Hilbert curve.

Each document's hashed words are projected to DIMS dimensions; the Hilbert key of the projection orders
documents so that similar ones are neighbours. The encoded documents are range-sorted by that key and cut
into full sequences along the curve; what is left at the end of a range is cut into powers of two, which
need no padding.

Defined results: a null or empty text is the end id alone; equal texts share a key and are ordered by
doc_id; one key may fill many ranges, as doc_id is part of the sort; repeated rows are packed each;
an empty table packs nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, materialize, mix, slices, table
from .tokens import encoder

SEQUENCE = 4096
END_ID = 2
DIMS, BITS = 4, 12
#: Encoded ids in one range of the curve, about; ranges are at least as many as shuffle partitions.
RANGE_BYTES = 64 << 20
_SCALE = 1.0 / 2**63


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows; each coordinate under 2**bits).

    Works bit plane by bit plane from the top: the plane's corner is Gray-decoded in the current
    orientation of the cell, and the orientation (reflections and a swap of axes) follows from the corner.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(word_hash: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
    """Sums of a hashed vector for each word, by document, scaled by the root of the word count: about standard normal."""
    n = len(doc_off) - 1
    out = np.zeros((n, DIMS))
    counts = np.diff(doc_off)
    for k in range(DIMS):
        u = mix(word_hash + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64) * _SCALE
        total = np.concatenate([[0.0], np.cumsum(u)])
        out[:, k] = (total[doc_off[1:]] - total[doc_off[:-1]]) * np.sqrt(3.0 / np.maximum(counts, 1))
    return out


def curve_keys(word_hash: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
    z = project(word_hash, doc_off)
    cells = (2**BITS / (1 + np.exp(-1.702 * z))).astype(np.int64)  # about the normal distribution's quantile
    return hilbert_key(np.clip(cells, 0, 2**BITS - 1), BITS)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, Hilbert key, ids (little-endian unsigned 16-bit, with the end id) and their number."""
    schema = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        e = encoder(path)
        for batch in slices(batches, 4 << 20):
            ids, sizes, words = e.encode(batch.column("text"))
            keys = curve_keys(words.hash, words.doc_off)
            small, at = ids.astype("<u2", copy=False), np.concatenate([[0], np.cumsum(sizes)])
            end = np.array([END_ID], "<u2").tobytes()
            blobs = [small[a:b].tobytes() + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array(sizes + 1, pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

    return doc_columns(docs).mapInArrow(run, "doc_id long, curve long, n_ids long, ids binary")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _cut(batches, size: int):
    """Pieces of sorted documents. Only the ids of the open, not yet full sequence are held."""
    from pyspark import TaskContext

    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 40
    held: list[tuple[int, int, int, bytes]] = []  # doc, start, doc_tokens, ids as 16-bit
    filled, rows = 0, []

    def close(parts, number):
        offset = 0
        for doc, start, total, raw in parts:
            wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            rows.append((doc, start, len(raw) // 2, zlib.crc32(wide), total, number, offset, wide))
            offset += len(raw) // 2

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
        rows.clear()
        return out

    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            raw = raw.as_py()
            total, start = len(raw) // 2, 0
            while start < total:
                take = min(size - filled, total - start)
                held.append((doc, start, total, raw[2 * start : 2 * (start + take)]))
                start, filled = start + take, filled + take
                if filled == size:
                    close(held, sequence)
                    held, filled, sequence = [], 0, sequence + 1
            if len(rows) >= 2000:
                yield flush()
    # the rest of the range: powers of two, largest first
    while filled:
        want, parts = 1 << (filled.bit_length() - 1), []
        filled -= want
        while want:
            doc, start, total, raw = held.pop(0)
            n = min(want, len(raw) // 2)
            parts.append((doc, start, total, raw[: 2 * n]))
            if 2 * n < len(raw):
                held.insert(0, (doc, start + n, total, raw[2 * n :]))
            want -= n
        close(parts, sequence)
        sequence += 1
    if rows:
        yield flush()


def pack(docs: DataFrame, size: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit).

    The encoded table is written once to the shared folder, so that the range sort's sampling reads it
    instead of encoding twice and a lost executor repeats no encoding.
    """
    encoded = materialize(encode_documents(docs, path), "packing")
    spark = docs.sparkSession
    size_of_all = 2 * (encoded.agg(F.sum("n_ids")).first()[0] or 0)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_of_all // RANGE_BYTES + 1)
    ordered = encoded.repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.select("doc_id", "ids").mapInArrow(lambda b: _cut(b, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def padding(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Tokens and padding over all sequences; a sequence of a power of two needs none."""
    sums = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.expr("(n & (n - 1)) = 0")
    return sums.agg(F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(size - F.col("n"))).alias("padding"), F.count("*").alias("sequences"))
