"""Vectors of whole numbers, per-query top lists and their merging tree: shared by exact search and hard-negative mining."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Queries of one packed row, lists merged at once, candidates of a tile.
GROUP, FAN, TILE = 1024, 16, 2048
#: Bytes of the query vectors that one broadcast may hold, and its most rows.
BLOCK_BYTES, BLOCK_ROWS = 1 << 26, 1 << 16
PACKED = "grp int, shard long, keys array<long>, ids array<long>, scores array<long>"
_LONGS = pa.list_(pa.int64())
_PACKED = pa.schema([("grp", pa.int32()), ("shard", pa.int64()), ("keys", _LONGS), ("ids", _LONGS), ("scores", _LONGS)])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and every component a finite number (magnitudes from 1e305 on don't count as such)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e305))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as doubles that hold whole numbers; shorter vectors are padded with zeros.

    scale is a power of two, so the product is exact.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.floor(np.asarray(column.flatten(), np.float64) * scale)
    size = np.diff(np.asarray(column.offsets, np.int64))
    width = int(size.max(initial=0))
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = values
    return out


class Side:
    """One side of a product: the matrix, its single-precision form where that is exact enough, and its greatest magnitude."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.most = float(np.abs(matrix).max(initial=0))
        self.single = matrix.astype(np.float32) if self.most < 1 << 24 else None

    def take(self, rows) -> Side:
        out = Side.__new__(Side)
        out.matrix, out.most, out.single = self.matrix[rows], self.most, None if self.single is None else self.single[rows]
        return out


def product(a: Side, b: Side) -> np.ndarray:
    """Exact inner products: single or double precision where every sum fits its whole numbers, else Python integers held to 64 bits."""
    w = min(a.matrix.shape[1], b.matrix.shape[1])
    bound = w * a.most * b.most
    if bound < 1 << 24 and a.single is not None and b.single is not None:
        return a.single[:, :w] @ b.single[:, :w].T
    if bound < 1 << 51:
        return a.matrix[:, :w] @ b.matrix[:, :w].T
    left, right = ([[int(x) for x in row[:w]] for row in m] for m in (a.matrix, b.matrix))
    return np.array([[min(max(sum(map(int.__mul__, x, y)), LEAST + 1), MOST) for y in right] for x in left], np.int64).reshape(len(left), len(right))


def lowest(kind: np.dtype):
    return LEAST if kind == np.int64 else -np.inf


def comparable(bounds: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Whole-number bounds as the kind of a product; those beyond its range become infinite."""
    if kind == np.int64:
        return bounds
    edge = 1 << (24 if kind == np.float32 else 53)
    return np.where(bounds > edge, np.inf, np.where(bounds < -edge, -np.inf, bounds)).astype(kind)


class TopLists:
    """For each query the k best candidates so far: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), LEAST)
        self.ids = np.full((n, k), MOST)

    def kth(self) -> np.ndarray:
        """Score of each list's last place; LEAST while it isn't full."""
        return self.scores[:, -1]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates as parallel arrays: number of the query, score, id."""
        if not len(rows):
            return
        own = np.unique(rows)
        q = np.concatenate([np.repeat(own, self.k), rows])
        s = np.concatenate([self.scores[own].ravel(), scores])
        i = np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, own)
        place = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
        kept = place < self.k
        self.scores[q[kept], place[kept]] = s[kept]
        self.ids[q[kept], place[kept]] = i[kept]

    def offer_tile(self, rows: np.ndarray, tile: np.ndarray, ids: np.ndarray) -> None:
        """Partial selection from a tile of scores (queries by candidates, ids ascending); the lowest value marks what doesn't count."""
        low = lowest(tile.dtype)
        kth, last = comparable(self.scores[rows, -1], tile.dtype), self.ids[rows, -1]
        hit = (tile >= kth[:, None]) & (tile > low)
        many = np.flatnonzero(np.count_nonzero(hit, 1) > 4 * self.k)
        if len(many):  # ties with the last place count only from smaller ids
            hit[many] &= (tile[many] > kth[many, None]) | (ids < last[many, None])
            many = many[np.count_nonzero(hit[many], 1) > 4 * self.k]
        if len(many):
            part, n = np.where(hit[many], tile[many], low), tile.shape[1]
            if tile.dtype == np.int64:
                best = np.argsort(~part, axis=1, kind="stable")[:, : self.k]
            else:  # score and place in one number, so that ties go to smaller ids
                key = np.where(part > low, part, 0).astype(np.int64) * n + np.arange(n - 1, -1, -1)
                key[part == low] = LEAST
                best = np.argpartition(key, n - self.k, axis=1)[:, n - self.k :]
            hit[many] = False
            at = np.repeat(many, best.shape[1]), best.ravel()
            hit[at] = tile[at] > low
        r, c = np.nonzero(hit)
        self.offer(rows[r], tile[r, c].astype(np.int64), ids[c])

    def packed(self, keys: np.ndarray, shard: int) -> Iterator[pa.RecordBatch]:
        """Packed rows of GROUP queries; keys (queries by columns) name the queries. Lists without candidates are left out."""
        for g, a in enumerate(range(0, len(keys), GROUP)):
            own = slice(a, a + GROUP)
            if (self.ids[own, 0] < MOST).any() or (self.scores[own, 0] > LEAST).any():
                yield packed_row(g, shard, keys[own], self.ids[own], self.scores[own])


def packed_row(group: int, shard: int, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.int64())) for x in (keys, ids, scores)]
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([shard], pa.int64()), *lists], schema=_PACKED)


def merged(lists: DataFrame, k: int, columns: int, name: str) -> DataFrame:
    """The tree: FAN neighbouring shards' lists become one, until one shard is left. A merge holds FAN packed rows at most."""

    def join(table: pa.Table) -> pa.Table:
        row = lambda i, c: np.asarray(table[c][i].values, np.int64)
        keys = row(0, "keys").reshape(-1, columns)
        top = TopLists(len(keys), k)
        for i in range(table.num_rows):
            ids, scores = row(i, "ids"), row(i, "scores")
            real = scores > LEAST
            top.offer(np.repeat(np.arange(len(keys)), k)[real], scores[real], ids[real])
        return pa.Table.from_batches([packed_row(table["grp"][0].as_py(), table["shard"][0].as_py() // FAN, keys, top.ids, top.scores)])

    while True:
        lists = materialize(lists, name)
        most = lists.agg(F.max("shard")).first()[0]
        if not most:
            return lists
        lists = lists.groupBy("grp", F.floor(F.col("shard") / FAN)).applyInArrow(join, PACKED)


def unpacked(batches, k: int, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of merged lists: keys of each candidate's query, rank from 1, id and score."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, ids, scores = (np.asarray(batch.column(c)[i].values, np.int64) for c in ("keys", "ids", "scores"))
            real = scores > LEAST
            yield np.repeat(keys.reshape(-1, columns), k, axis=0)[real], np.tile(np.arange(1, k + 1), len(keys) // columns)[real], ids[real], scores[real]


def query_blocks(queries: DataFrame, vector: str, name: str) -> list[DataFrame]:
    """Queries in written blocks, each proven to fit one broadcast: a block is one file of a limited number of rows."""
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not n:
        return []
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    path = shared_dir(queries.sparkSession, name)
    queries.repartition(-(-n // rows)).write.option("maxRecordsPerFile", rows).parquet(path)
    read = queries.sparkSession.read.schema(queries.schema)
    return [read.parquet(f) for f in sorted(read.parquet(path).inputFiles())]


def in_blocks(queries: DataFrame, vector: str, one: Callable[[DataFrame], DataFrame], schema: str, name: str) -> DataFrame:
    """Results of all blocks of queries, each appended to one written table as it ends."""
    spark = queries.sparkSession
    path = shared_dir(spark, name)
    blocks = query_blocks(queries, vector, name + "-queries")
    for block in blocks:
        one(block).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
