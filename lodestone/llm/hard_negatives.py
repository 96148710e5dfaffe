"""Operator 12, hard negatives: k-means inverted lists with stored radii, visited by their Cauchy-Schwarz bound.

For an anchor a and a row x of a list with centroid c and radius r: a.c - |a| r <= a.x <= a.c + |a| r. Lists are visited from the
greatest upper bound on; one that lies outside an anchor's window is skipped, and an anchor stops where the bound falls strictly
below its kth score. Every row is in a list; only the centroids are fitted on a sample (SAMPLE rows, by hash of the id), which moves
the work and never the result.

Rows with a null id, label or vector, or with a null or non-finite component, take no part (magnitudes from 1e305 on count as
non-finite). Labels are compared as they are after `relabel`. A positive score below zero leaves an empty window, as 30 p > 90 p; a
score of zero leaves scores of zero. Repeated anchor rows give results each, repeated rows a place each; a row that has the anchor's
id is never its positive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, table
from .vectors import LEAST, MOST, PACKED, TILE, Side, TopLists, comparable, in_blocks, lowest, merged, product, unpacked, usable, whole_numbers

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_RESULT = pa.schema([(c, pa.int32() if c == "rank" else pa.int64()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
LISTS = "cluster int, radius double, ids array<long>, labels array<long>, width int, vectors binary"
_LISTS = pa.schema([("cluster", pa.int32()), ("radius", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary())])
#: Rows that centroids are fitted on, most clusters, rounds of fitting, parts of lists that a task holds at once, anchors visited together.
SAMPLE, CLUSTERS, ROUNDS, HELD, TOGETHER = 20_000, 1024, 8, 64, 256


def padded(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):  # beyond doubles any list will do
        return np.argmin((centroids**2).sum(1) - 2 * padded(x, centroids.shape[1]) @ centroids.T, axis=1)


def fitted(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample; a cluster that loses all rows keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=k)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


class Index:
    """Inverted lists as a written table: parts of TILE rows of one cluster, each with its radius, ids, labels and whole numbers."""

    def __init__(self, rows: DataFrame, scale: int):
        """rows: id, label, v."""
        spark = rows.sparkSession
        n = rows.count()
        sample = whole_numbers(rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"], scale)
        k = max(1, min(CLUSTERS, len(sample), round(n**0.5 / 2)))
        self.centroids = fitted(sample, k) if n else np.zeros((1, 0))
        sent = spark.sparkContext.broadcast(self.centroids)

        def assign(batches):
            seen = 0
            for b in batches:
                own = nearest(whole_numbers(b.column("v"), scale), sent.value)
                place = mix(np.arange(seen, seen + b.num_rows, dtype=np.uint64)).view(np.int64)  # deals a cluster of any size evenly, equal rows too
                seen += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(place), *(b.column(c) for c in ("id", "label", "v"))], names=["cluster", "place", "id", "label", "v"])

        def pack(batches):
            for b in batches:
                cluster = np.asarray(b.column("cluster"))
                cuts = np.flatnonzero(np.diff(cluster, prepend=-1))
                for a, end in zip(cuts, [*cuts[1:], len(cluster)], strict=True):
                    for at in range(a, end, TILE):
                        part = b.slice(at, min(TILE, end - at))
                        ids = np.asarray(part.column("id"), np.int64)
                        order = np.argsort(ids, kind="stable")
                        x = whole_numbers(part.column("v"), scale)[order]
                        c = sent.value[cluster[a]]
                        far = np.sqrt(((padded(x, max(x.shape[1], len(c))) - np.pad(c, (0, max(0, x.shape[1] - len(c))))) ** 2).sum(1)).max()
                        row = [cluster[a], far, ids[order], np.asarray(part.column("label"), np.int64)[order], x.shape[1], x.astype("<f8").tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _LISTS.types, strict=True)], schema=_LISTS)

        dealt = rows.mapInArrow(assign, f"cluster int, place long, id long, label long, v {dict(rows.dtypes)['v']}").repartitionByRange("cluster", "place").sortWithinPartitions("cluster")
        self.lists = materialize(dealt.mapInArrow(pack, LISTS), "inverted-lists")
        sent.destroy()


class Wanted:
    """Lists that anchors ask for: the anchor of each (ascending), scores from low to high, of the anchor's own label or of others."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool):
        self.anchor, self.low, self.high, self.same = anchor, low, high, same


def unbounded(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles; the ends of the range stand for anything beyond it."""
    return np.where(scores <= LEAST + 1, -np.inf, np.where(scores == MOST, np.inf, scores.astype(np.float64)))


def visited(parts: list[tuple], anchors: tuple, wanted: Wanted, centroids: np.ndarray, top: TopLists) -> int:
    """Offer the held parts' rows to the lists; the number of products of anchors and parts that bounds spared."""
    ids, labels, matrix, home = anchors
    spared = 0
    width = max(matrix.shape[1], centroids.shape[1])
    a, c = padded(matrix, width), padded(centroids[[p[0] for p in parts]], width)
    radius, size = np.array([p[1] for p in parts]), np.sqrt((a**2).sum(1))
    slack = 1e-9 * (size[:, None] * (np.sqrt((c**2).sum(1)) + radius)[None]) + 1e-6
    middle, reach = a @ c.T, size[:, None] * radius[None] + slack
    upper, lower = middle + reach, middle - reach
    side = Side(matrix)
    for start in range(0, len(ids), TOGETHER):  # anchors of one home cluster stand together
        own = np.arange(start, min(start + TOGETHER, len(ids)))
        lists = np.arange(*np.searchsorted(wanted.anchor, [own[0], own[-1] + 1]))
        if not len(lists):
            continue
        order = np.argsort(-upper[own].max(0), kind="stable")
        ahead = np.maximum.accumulate(upper[:, order[::-1]][own], axis=1)[:, ::-1]  # greatest bound from here on
        of = wanted.anchor[lists]
        for step, p in enumerate(order):
            kth = unbounded(top.kth()[lists])
            if (ahead[of - start, step] < kth).all():
                spared += (len(order) - step) * len(own)
                break
            _, _, rows, kinds, x = parts[p]
            out = (upper[of, p] < kth) | (upper[of, p] < unbounded(wanted.low[lists])) | (lower[of, p] > unbounded(wanted.high[lists])) | (wanted.low[lists] > wanted.high[lists])
            go = lists[~out]
            asking = np.unique(wanted.anchor[go])
            spared += len(own) - len(asking)
            if not len(go):
                continue
            scores = product(side.take(asking), x)
            no = lowest(scores.dtype)
            equal = labels[asking][:, None] == kinds[None, :]
            scores[~equal if wanted.same else equal] = no
            scores[ids[asking][:, None] == rows[None, :]] = no
            tile = scores[np.searchsorted(asking, wanted.anchor[go])]
            low, high = (comparable(v[go], scores.dtype)[:, None] for v in (wanted.low, wanted.high))
            tile[(tile < low) | (tile > high)] = no
            top.offer_tile(go, tile, rows)
    return spared


def search(index: Index, anchors: tuple, wanted: Wanted, keys: np.ndarray, k: int) -> DataFrame:
    """Merged lists of all wanted. The anchors (a block of limited bytes) are broadcast, each task visits the lists it holds."""
    context = index.lists.sparkSession.sparkContext
    sent = context.broadcast((anchors, wanted, keys, index.centroids))

    def visit(batches):
        asking, lists, names, centroids = sent.value
        top, parts = TopLists(len(names), k), []

        def look():
            visited(parts, asking, lists, centroids, top)
            parts.clear()

        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r] for n in b.schema.names}
                own, kinds = (np.asarray(row[n].values, np.int64) for n in ("ids", "labels"))
                x = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(len(own), row["width"].as_py())
                parts.append((row["cluster"].as_py(), row["radius"].as_py(), own, kinds, Side(x)))
                if len(parts) == HELD:
                    look()
        if parts:
            look()
        yield from top.packed(names, TaskContext.get().partitionId())

    out = merged(index.lists.mapInArrow(visit, PACKED), k, keys.shape[1], "hard-negatives")
    sent.destroy()
    return out


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number bounds of low * p <= 100 * n <= high * p."""
    held = lambda x: min(max(x, LEAST + 1), MOST)
    p = [int(x) for x in positive]
    return np.array([held(-(-low * x // 100)) for x in p], np.int64), np.array([held(high * x // 100) for x in p], np.int64)


def mine(
    rows: DataFrame, is_anchor, relabel: Callable = lambda label, id_: label, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels within low to high hundredths of the positive's score.

    is_anchor: condition on the id column; relabel: of label and id, applied first. Blocks of anchors go through two searches of the
    inverted lists, positives then negatives; what the driver holds is a block's anchors and positives.
    """
    own = (
        rows.where(F.col(id_column).isNotNull() & F.col("label").isNotNull() & usable(F.col(vector)))
        .select(F.col(id_column).cast("long").alias("id"), relabel(F.col("label").cast("long"), F.col(id_column)).cast("long").alias("label"), F.col(vector).alias("v"), is_anchor.alias("asks"))
    )
    index = Index(own.select("id", "label", "v"), scale)

    def one(block: DataFrame) -> DataFrame:
        t = block.toArrow()
        matrix = whole_numbers(t["v"], scale)
        home = nearest(matrix, index.centroids)
        order = np.argsort(home, kind="stable")
        anchors = np.asarray(t["id"], np.int64)[order], np.asarray(t["label"], np.int64)[order], matrix[order], home[order]
        n = len(order)
        every = Wanted(np.arange(n), np.full(n, LEAST + 1), np.full(n, MOST), True)
        found = search(index, anchors, every, np.arange(n)[:, None], positives).toArrow()  # a block's lists
        pairs = [np.stack([key[:, 0], ids, scores], 1) for key, _, ids, scores in unpacked(found.to_batches(), positives, 1)]
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        pairs = pairs[np.lexsort((pairs[:, 1], ~pairs[:, 2], pairs[:, 0]))]
        wanted = Wanted(pairs[:, 0], *window(pairs[:, 2], low, high), False)
        keys = np.column_stack([anchors[0][pairs[:, 0]], pairs[:, 1:]])
        return search(index, anchors, wanted, keys, negatives).mapInArrow(rows_of_lists, RESULT)

    def rows_of_lists(batches):
        for keys, rank, ids, scores in unpacked(batches, negatives, 3):
            columns = keys[:, 0], keys[:, 1], rank, ids, keys[:, 2], scores
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RESULT.types, strict=True)], schema=_RESULT)

    return in_blocks(own.where("asks").drop("asks"), "v", one, RESULT, "hard-negatives-result")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows, F.col("vec_id") % 100 == 0, lambda label, i: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
