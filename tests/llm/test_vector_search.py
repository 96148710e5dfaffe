"""Exact search and hard-negative mining against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_search, hard_negatives, vectors

NAN, INF = float("nan"), float("inf")


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) or abs(x) >= 1e305 for x in v):
        return None
    return [int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x) for x in v]


def inner(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=False)), vectors.LEAST + 1), vectors.MOST)


def brute_search(rows, k, scale=64):
    rows = [(i, w) for i, v, *_ in rows if i is not None and (w := whole(v, scale)) is not None]
    out = []
    for i, q in rows:
        if i % 20 == 0:
            best = sorted(((-inner(q, c), j) for j, c in rows if j != i))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, scale=256):
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, w) for i, v, lab in rows if i is not None and lab is not None and (w := whole(v, scale)) is not None]
    out = []
    for i, lab, a in rows:
        if i % 100:
            continue
        positives = sorted((-inner(a, c), j) for j, m, c in rows if j != i and m == lab)[:5]
        others = sorted((-inner(a, c), j) for j, m, c in rows if m != lab)
        for p, j in positives:
            found = [(s, n) for s, n in others if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows, kind="double", parts=3):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(parts)
    return df.selectExpr("*", "1 as id", "'x' as v", "2 as rank", "true as asks", "3 as score", "4 as cluster")


def unit(r, n=8, centre=None, spread=1.0):
    x = np.array([r.gauss(0, spread) for _ in range(n)]) + (0 if centre is None else centre)
    return [float(v) for v in x / np.linalg.norm(x)]


def planted(kind):
    r = random.Random(5)
    if kind == "plain":
        return [(i, unit(r), r.randrange(10)) for i in range(400)]
    if kind == "ties":  # a third of all rows is one vector
        return [(i, [0.5, -0.5, 0.25] if i % 3 else unit(r, 3), r.randrange(3)) for i in range(360)]
    if kind == "repeated":
        own = [(i, unit(r, 4), r.randrange(2)) for i in range(0, 200, 4)]
        return own + own[:30]
    if kind == "clusters":
        centres = [np.array(unit(r)) * 6 for _ in range(8)]
        return [(i, unit(r, 8, centres[i % 8], 0.3), (i % 8) // 2 if r.random() < 0.9 else r.randrange(4)) for i in range(900)]
    odd = [[], [0.0], [1.0, None], None, [NAN, 1.0], [INF], [-INF, 1.0], [1e306], [1e300, 1.0], [-1e300, 2.0], [3e18, -3e18], [1e9, 1e9], [-0.01] * 3, [0.01] * 5, [4.7e7, 1.0]]
    return [(None if i == 7 else i * 20 if i < 30 else i, odd[i % len(odd)], None if i % 11 == 3 else -3 if i % 13 == 0 else i % 4) for i in range(90)]


KINDS = ["plain", "ties", "repeated", "odd", "clusters"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("tile", [7, 2048])
def test_search_equals_brute_force(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(exact_search, "TILE", tile)
    rows = planted(kind)
    df = frame(spark, rows)
    got = exact_search.search(df.where("vec_id % 20 = 0"), df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_search(rows, 20)


def test_lists_merge_over_more_shards_than_one_level_and_blocks(spark, monkeypatch):
    rows = planted("plain")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 6)
    got = exact_search.search(frame(spark, rows, "float", 8).where("vec_id % 20 = 0"), frame(spark, rows, "float", 40), k=3)
    single = [(i, [float(np.float32(x)) for x in v], m) for i, v, m in rows]
    assert sorted(map(tuple, got.collect())) == brute_search(single, 3)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("tile", [7, 2048])
def test_negatives_equal_brute_force(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "HELD", 5)
    monkeypatch.setattr(hard_negatives, "TOGETHER", 3)
    rows = planted(kind)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, lambda label, i: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
    expected = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == [r for r in expected]


def test_bounds_spare_products_on_clustered_rows(spark):
    rows = [(i, v, m) for i, v, m in planted("clusters")]
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    label = np.array([m for *_, m in rows])
    centroids = hard_negatives.fitted(x, 8)
    own = hard_negatives.nearest(x, centroids)
    parts = []
    for c in range(8):
        at = np.flatnonzero(own == c)
        parts.append((c, np.sqrt(((x[at] - centroids[c]) ** 2).sum(1)).max(), at, label[at], vectors.Side(x[at])))
    asked = np.arange(0, 900, 9)
    asked = asked[np.argsort(own[asked], kind="stable")]
    anchors = asked, label[asked], x[asked], own[asked]
    n = len(asked)
    top = vectors.TopLists(n, 5)
    spared = hard_negatives.visited(parts, anchors, hard_negatives.Wanted(np.arange(n), np.full(n, vectors.LEAST + 1), np.full(n, vectors.MOST), True), centroids, top)
    assert spared > n  # more than one list an anchor isn't visited
    for row, a in enumerate(asked):
        best = sorted((-int(x[a] @ x[j]), j) for j in range(900) if j != a and label[j] == label[a])[:5]
        assert list(zip((-top.scores[row]).tolist(), top.ids[row].tolist(), strict=True)) == best
