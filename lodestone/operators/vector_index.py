"""An inverted-file index of vectors: k-means cells trained in Spark, vectors written by cell, cells visited by their bound.

Unit vectors are dealt to the cell of the nearest centroid and written in a folder a cell, so a search reads the files of the cells
that it visits and no others. A cell stores its centroid c and radius r; for a unit query q every row of it has a cosine of at most
q.c + r. Queries visit cells in the order of q.c: `probes` of them at first, then twice as many in each round while a query has fewer
than k rows that pass the document filter, or, for an exact search, while the bound of a cell not yet visited reaches the kth score.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import lineage

#: Rows that centroids are fitted on (a sample by hash), most cells, rounds of fitting, queries sent to every task at once.
SAMPLE, MOST_CELLS, ROUNDS, QUERY_BLOCK = 200_000, 1024, 6, 2_000
CELL = "cell int, centroid array<double>, radius double, n long"


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def train_cells(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds over a sample: each task sums its rows by cell, Spark adds the sums."""
    spark = vectors.sparkSession
    n = vectors.count()
    keep = F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample = lineage.cut(vectors.where(keep).select("chunk_id", "vector"))
    first = sample.orderBy(F.xxhash64("chunk_id", F.lit(4)), "chunk_id").limit(cells).toPandas()
    centroids = unit(matrix(first.vector)) if len(first) else np.zeros((0, 0))
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)  # at most MOST_CELLS rows

        def sums(frames, sent=sent):
            c, total, many = sent.value, np.zeros_like(sent.value), np.zeros(len(sent.value))
            for pdf in frames:
                x = unit(matrix(pdf.vector))
                own = nearest(x, c)
                np.add.at(total, own, x)
                many += np.bincount(own, minlength=len(c))
            cell, at = np.indices(total.shape).reshape(2, -1)
            yield pd.DataFrame({"cell": cell, "at": at, "v": total.ravel(), "n": np.repeat(many, total.shape[1])})

        found = sample.select("vector").mapInPandas(sums, "cell int, at int, v double, n double").groupBy("cell", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
        sent.destroy()
        total, many = np.zeros_like(centroids), np.zeros_like(centroids)
        total[found["cell"], found["at"]], many[found["cell"], found["at"]] = found["v"], found["n"]
        centroids = np.where(many > 0, total / np.maximum(many, 1), centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


@dataclass(frozen=True)
class VectorIndex:
    path: str

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(CELL).parquet(f"{self.path}/cells")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def build(vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
    """Index of vectors (chunk_id, vector and any further columns, e.g. document_id) in a folder; null vectors are left out.

    cells: about the square root of the rows if not given, at most MOST_CELLS.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vector").isNotNull())
    centroids = train_cells(vectors, min(cells or max(1, math.isqrt(vectors.count())), MOST_CELLS))
    sent = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("struct<cell:int,far:double>")
    def placed(v: pd.Series) -> pd.DataFrame:
        x = unit(matrix(v))
        own = nearest(x, sent.value)
        return pd.DataFrame({"cell": own, "far": np.linalg.norm(x - sent.value[own], axis=1)})

    rows = vectors.withColumn("_at", placed("vector")).select(*vectors.columns, F.col("_at.cell").alias("cell"), F.col("_at.far").alias("far"))
    # a cell of very many rows is dealt to several tasks and files
    rows.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = VectorIndex(path)
    if len(centroids):
        sizes = stored.rows(spark).groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        known.join(sizes, "cell").select("cell", "centroid", "radius", "n").coalesce(1).write.parquet(f"{path}/cells")
    else:
        spark.createDataFrame([], CELL).write.parquet(f"{path}/cells")
    sent.destroy()
    return stored


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, scope: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """query_id, chunk_id, score, dense_rank: the k nearest vectors by cosine, ties by the smaller id.

    queries: query_id, query_vector. probes: cells visited at first; None: exact. scope: a frame of document_id, of which alone rows
    count; where: a condition on the stored columns. Zero vectors are never found.
    """
    spark = queries.sparkSession
    cells = index.cells(spark).toPandas().sort_values("cell")  # at most MOST_CELLS rows
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), index.rows(spark).schema["chunk_id"].dataType.simpleString() if len(cells) else "long"
    schema = f"query_id {q_type}, chunk_id {c_type}, score double, dense_rank int"
    rows, out = [], f"{lineage.folder(spark)}/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(out)

    def flush() -> None:
        _search_block(spark, rows, cells, index, k, probes, scope, where, schema).write.mode("append").parquet(out)
        rows.clear()

    for row in queries.select("query_id", "query_vector").where("query_vector is not null").toLocalIterator() if len(cells) else ():
        rows.append(row)
        if len(rows) == QUERY_BLOCK:
            flush()
    if rows:
        flush()
    return spark.read.schema(schema).parquet(out)


def _search_block(spark, rows, cells: pd.DataFrame, index: VectorIndex, k: int, probes, scope, where, schema: str) -> DataFrame:
    ids = [r.query_id for r in rows]
    queries = unit(np.array([r.query_vector for r in rows], float))
    centroids = matrix(cells.centroid)
    near = queries @ centroids.T
    bound = near + cells.radius.to_numpy()[None] + 1e-6  # scores are rounded to six digits
    order = np.argsort(-(bound if probes is None else near), axis=1, kind="stable")
    number = cells.cell.to_numpy()
    source = index.rows(spark)
    if where is not None:
        source = source.where(where)
    if scope is not None:
        source = source.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    found, step, at = None, max(1, probes or 4), np.zeros(len(ids), int)
    waiting = np.arange(len(ids))
    while len(waiting):
        by_cell: dict[int, list[int]] = {}
        for i in waiting:
            for c in order[i, at[i] : at[i] + step]:
                by_cell.setdefault(int(number[c]), []).append(int(i))
            at[i] = min(at[i] + step, len(number))
        part = _visit(source, by_cell, ids, queries, k, schema)
        found = lineage.cut(_best(part if found is None else found.drop("dense_rank").unionByName(part), k))
        last = {r.query_id: (r.n, r.kth) for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).collect()}  # a row a query of the block
        still = []
        for i in waiting:
            n, kth = last.get(ids[i], (0, None))
            if at[i] < len(number) and (n < k or (probes is None and bound[i, order[i, at[i]]] >= kth)):
                still.append(i)
        waiting, step = np.array(still, int), step * 2
    return found


def _visit(source: DataFrame, by_cell: dict[int, list[int]], ids: list, queries: np.ndarray, k: int, schema: str) -> DataFrame:
    """The k best rows of each task for each query, from the cells that queries visit; the files of other cells aren't read."""
    sent = source.sparkSession.sparkContext.broadcast((by_cell, queries))

    def best(frames):
        asked, q = sent.value
        top: dict[int, list[tuple]] = {}
        for pdf in frames:
            for cell, own in pdf.groupby("cell"):
                who = asked[int(cell)]
                x = matrix(own.vector)
                norm = np.linalg.norm(x, axis=1)
                sims = np.round(q[who] @ unit(x).T, 6)
                sims[:, norm == 0] = -np.inf
                chunk = own.chunk_id.to_numpy()
                for i, s in zip(who, sims, strict=True):
                    take = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    take = take[np.lexsort((chunk[take], -s[take]))[:k]]
                    top[i] = sorted(top.get(i, []) + [(-s[j], chunk[j]) for j in take if s[j] > -np.inf])[:k]
        yield pd.DataFrame([(ids[i], c, -s) for i, own in top.items() for s, c in own], columns=["query_id", "chunk_id", "score"])

    return source.where(F.col("cell").isin(list(by_cell))).select("cell", "chunk_id", "vector").mapInPandas(best, schema.rpartition(",")[0])


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("dense_rank", F.row_number().over(w)).where(F.col("dense_rank") <= k)


def probes_for(spark: SparkSession, index: VectorIndex, k: int = 20, target: float = 0.93, sample: int = 200) -> int:
    """Fewest cells whose search finds a share of `target` of the k nearest rows, measured on a sample of the index's own rows.

    The exact search tells in which cells their neighbours lie; the rank of these cells in the queries' orders gives the recall of
    every number of probes at once. What comes to the driver is sample * k rows.
    """
    asked = index.rows(spark).orderBy(F.xxhash64("chunk_id", F.lit(5)), "chunk_id").limit(sample).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    asked = lineage.cut(asked)
    found = search(asked, index, k).join(index.rows(spark).select("chunk_id", "cell"), "chunk_id").join(asked, "query_id").select("query_vector", "cell").toPandas()
    if not len(found):
        return 1
    cells = index.cells(spark).toPandas().sort_values("cell")
    near = unit(matrix(found.query_vector)) @ matrix(cells.centroid).T
    own = np.searchsorted(cells.cell.to_numpy(), found.cell.to_numpy())
    rank = (near > near[np.arange(len(near)), own][:, None]).sum(1) + 1
    return int(np.quantile(rank, target, method="higher"))


def recall(approximate: DataFrame, exact: DataFrame) -> float:
    """Share of the exact search's rows that the other search has."""
    pair = ["query_id", "chunk_id"]
    n = exact.count()
    return approximate.select(*pair).join(exact.select(*pair), pair, "left_semi").count() / n if n else 1.0
