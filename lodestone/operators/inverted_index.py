"""A stored inverted index: postings in blocks of documents with the greatest weight of each block, searched without reading them all.

Documents of similar length share a block, as longer ones hold a word more often; a block has about BLOCK documents, so a list is
bounded however common its word. A query first looks at the greatest weights alone: their sum over its words bounds every score in a
block. The blocks of the greatest bounds are scored, which gives a kth score; of the others, only those whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.english import with_stems
from lodestone.operators import fulltext, lineage

#: Documents of a block, about; classes of length; blocks of a query that are scored first.
BLOCK, CLASSES, FIRST = 256, 64, 4


@dataclass(frozen=True)
class InvertedIndex:
    path: str

    def postings(self, spark: SparkSession) -> DataFrame:
        """lexeme, block, most (greatest weight), docs: array<struct<chunk_id, weight>>."""
        return spark.read.parquet(self.path)


def weights(chunks: DataFrame, content: str, context: str | None, stemmer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunk_id, lexeme, weight: the sum of the weights of its occurrences. Occurrences are counted by word before they are stemmed."""
    each = lambda c, w: chunks.select("chunk_id", F.explode(fulltext.words(F.col(c))).alias("word"), F.lit(fulltext.WEIGHT[w]).alias("w"))
    rows = each(content, "A") if context is None else each(content, "A").unionByName(each(context, "B"))
    counted = rows.where(~F.col("word").isin(fulltext.STOP_WORDS)).groupBy("chunk_id", "word").agg(F.sum("w").alias("w"))
    return stemmer(counted).groupBy("chunk_id", "lexeme").agg(F.sum("w").alias("weight"))


def by_suffix(rows: DataFrame) -> DataFrame:
    """The stemmer of a few suffix rules, as an expression."""
    return rows.withColumn("lexeme", fulltext.stem(F.col("word")))


def english(rows: DataFrame) -> DataFrame:
    """The Porter2 stemmer, over the distinct words."""
    return with_stems(rows)


def english_terms(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """query_id, lexeme by the Porter2 stemmer; stop words give none."""
    each = queries.select("query_id", F.explode(fulltext.words(F.col(text))).alias("word")).where(~F.col("word").isin(fulltext.STOP_WORDS))
    return with_stems(each).select("query_id", "lexeme").distinct()


def block_of(chunks: DataFrame, content: str) -> DataFrame:
    """chunk_id, block: classes of length, each dealt by a hash to as many blocks as its documents need."""
    sized = lineage.cut(chunks.select("chunk_id", F.coalesce(F.length(content), F.lit(0)).alias("size")))
    cuts = sized.agg(F.percentile_approx("size", [i / CLASSES for i in range(1, CLASSES)], 1000)).first()[0] or []
    kind = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<int>"), lambda c: c < F.col("size")))
    sized = sized.withColumn("kind", kind)
    many = {r.kind: r["count"] for r in sized.groupBy("kind").count().collect()}  # at most CLASSES rows
    parts, first, at = {}, {}, 0
    for k in sorted(many):
        parts[k], first[k] = -(-many[k] // BLOCK), at
        at += parts[k]
    if not many:
        return sized.select("chunk_id", F.lit(0).cast("long").alias("block"))
    look = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("kind")]
    return sized.select("chunk_id", (look(first) + F.pmod(F.xxhash64("chunk_id"), look(parts))).cast("long").alias("block"))


def build(chunks: DataFrame, path: str, content: str = "content", context: str | None = None, stemmer: Callable[[DataFrame], DataFrame] = by_suffix) -> InvertedIndex:
    """Index of chunks (chunk_id, content[, context]) in a folder, sorted by lexeme so that a scan skips the row groups of others."""
    rows = weights(chunks, content, context, stemmer).join(block_of(chunks, content), "chunk_id")
    blocks = rows.groupBy("lexeme", "block").agg(F.max("weight").alias("most"), F.collect_list(F.struct("chunk_id", "weight")).alias("docs"))
    blocks.repartitionByRange("lexeme", "block").sortWithinPartitions("lexeme", "block").write.parquet(path)
    return InvertedIndex(path)


def score(r: Column) -> Column:
    return F.round(r / (r + 1), 9)


def search(queries: DataFrame, index: InvertedIndex, k: int, allowed: DataFrame | None = None, terms: Callable[[DataFrame], DataFrame] = fulltext.query_terms) -> DataFrame:
    """query_id, chunk_id, score, sparse_rank: each query's k best chunks by the weights of its terms, ties by the smaller id.

    allowed: a frame of chunk_id, of which alone chunks count. terms: query_id, lexeme of queries (the index's stemmer).
    """
    posts = index.postings(queries.sparkSession)
    asked = lineage.cut(terms(queries))
    bounds = posts.select("lexeme", "block", "most").join(asked, "lexeme").groupBy("query_id", "block").agg(score(F.sum("most")).alias("bound"))
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = lineage.cut(bounds.withColumn("nth", F.row_number().over(w)))

    def scored(blocks: DataFrame) -> DataFrame:
        wanted = blocks.select("query_id", "block").join(asked, "query_id")
        hits = posts.join(wanted, ["lexeme", "block"]).select("query_id", F.explode("docs").alias("d")).select("query_id", "d.*")
        if allowed is not None:
            hits = hits.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        return best(hits.groupBy("query_id", "chunk_id").agg(score(F.sum("weight")).alias("score")))

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return rows.withColumn("sparse_rank", F.row_number().over(order)).where(F.col("sparse_rank") <= k)

    first = lineage.cut(scored(bounds.where(F.col("nth") <= FIRST)))
    kth = first.where(F.col("sparse_rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = bounds.where(F.col("nth") > FIRST).join(kth, "query_id", "left").where("kth is null or bound >= kth")
    return best(first.drop("sparse_rank").unionByName(scored(rest).drop("sparse_rank")))


def blocks_scored(queries: DataFrame, index: InvertedIndex, found: DataFrame, k: int) -> tuple[int, int]:
    """Blocks that a search looks into and all that hold a term: what the bounds spare."""
    posts = index.postings(queries.sparkSession)
    bounds = posts.select("lexeme", "block", "most").join(fulltext.query_terms(queries), "lexeme").groupBy("query_id", "block").agg(score(F.sum("most")).alias("bound"))
    kth = found.where(F.col("sparse_rank") == k).select("query_id", F.col("score").alias("kth"))
    both = bounds.join(kth, "query_id", "left").agg(F.count_if(F.expr("kth is null or bound >= kth")), F.count("*")).first()
    return both[0], both[1]
