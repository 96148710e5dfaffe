"""Helpers shared by the training-data operators: shared folders, word hashing, Arrow slices."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where a local session has no such setting (tests, one machine) a temporary folder is set once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: a batch of long texts is held by the JVM and by its Python worker at once.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE, _BASE2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd. Kept for the process."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for b in (base, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            pair.append(p)
        have = _powers[base] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, their offsets (n + 1) and which are null, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        off_type = np.int64
    else:
        off_type = np.int32
    n = len(column)
    nulls = np.asarray(column.is_null())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, off_type)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], nulls


def slices(batches, max_bytes: int = 3 << 20, column: str = "text"):
    """Arrow batches cut so that each holds about max_bytes of text, or one longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off, _ = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


class Words:
    """Words of a batch of texts: byte spans, 64-bit hashes, and where each document's words start."""

    def __init__(self, column: pa.Array, lower: bool = False, space: np.ndarray = ASCII_SPACE, hashed: bool = True):
        self.data, self.off, self.null = text_bytes(column)
        n = len(self.data)
        solid = ~space[self.data]
        first = np.zeros(n, bool)
        first[self.off[:-1][self.off[:-1] < n]] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.doc_off = np.searchsorted(self.start, self.off)
        if hashed:
            self.hash = self._hashes(lower)

    def _hashes(self, lower: bool) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U64)
        up, down = powers(_BASE, n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def count(self) -> np.ndarray:
        return np.diff(self.doc_off)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(_BASE2, n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; LODESTONE_TOKENIZERS names another folder."""
    folder = os.environ.get("LODESTONE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))
