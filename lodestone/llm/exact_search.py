"""Operator 11, exact top-k search: tiled products of query blocks and shards, partial selection per tile, tree merging of lists.

Rows without an id, and vectors that are null or hold a null or non-finite component, take no part. An empty vector scores 0
with all; vectors of different lengths are compared as if the shorter ended in zeros. Scores beyond 64 bits count as its limits.
A row that has the query's id isn't its candidate; repeated query rows get a list each, repeated candidates a place each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import GROUP, PACKED, TILE, Side, TopLists, in_blocks, lowest, merged, product, unpacked, usable, whole_numbers

RESULT = "query_id long, rank int, vec_id long, score long"
_RESULT = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def taking_part(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    return rows.where(F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k greatest integer inner products of every query with all candidates, over floor(scale * x); scale is a power of two.

    A block of queries of limited bytes is broadcast; each task multiplies it with the tiles of its own shard and keeps k places a
    query, so what is shuffled is k places for each query and shard, whatever the data. The broadcast is released after its block.
    """
    spark = queries.sparkSession
    corpus = taking_part(candidates, id_column, vector)

    def one(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(rows["id"], np.int64), whole_numbers(rows["v"], scale)))

        def shard(batches):
            ids, matrix = sent.value
            top = TopLists(len(ids), k)
            groups = [(np.arange(a, min(a + GROUP, len(ids))), Side(matrix[a : a + GROUP])) for a in range(0, len(ids), GROUP)]
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    tile = batch.slice(at, TILE)
                    own = np.asarray(tile.column("id"), np.int64)
                    order = np.argsort(own, kind="stable")
                    own, side = own[order], Side(whole_numbers(tile.column("v"), scale)[order])
                    for rows, group in groups:
                        scores = product(group, side)
                        first, end = np.searchsorted(own, ids[rows]), np.searchsorted(own, ids[rows], side="right")
                        for r in np.flatnonzero(first < end):
                            scores[r, first[r] : end[r]] = lowest(scores.dtype)
                        top.offer_tile(rows, scores, own)
            yield from top.packed(ids[:, None], TaskContext.get().partitionId())

        lists = merged(corpus.mapInArrow(shard, PACKED), k, 1, "exact-search")
        sent.destroy()
        return lists.mapInArrow(rows_of_lists, RESULT)

    def rows_of_lists(batches):
        for keys, rank, ids, scores in unpacked(batches, k, 1):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(rank, pa.int32()), pa.array(ids), pa.array(scores)], schema=_RESULT)

    return in_blocks(taking_part(queries, id_column, vector), "v", one, RESULT, "exact-search-result")


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows.where("vec_id % 20 = 0"), rows)
