"""Masks and tables of page boxes: known answers and brute force."""

import random

import pytest

from lodestone.sources import boxes

BOX = "doc_id long, page int, block_id long, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("side", [7.0, 100.0])
def test_masks_equal_brute_force(spark, side):
    r = random.Random(6)
    box = lambda w, h: (x := r.uniform(0, 300), y := r.uniform(0, 300), x + r.uniform(0, w), y + r.uniform(0, h))
    blocks = [(d, 1, i, *box(60, 30)) for d in range(3) for i in range(60)] + [(0, 1, 99, 5.0, 5.0, 5.0, 9.0), (0, 2, 0, 0.0, 0.0, 10.0, 10.0)]
    tables = [(d, 1, i, *box(150, 150)) for d in range(3) for i in range(4)] + [(0, 2, 9, 0.0, 0.0, 5.0, 10.0)]

    def hidden(b):
        for d, p, _, *t in tables:
            if (d, p) == b[:2]:
                w, h = min(b[5], t[2]) - max(b[3], t[0]), min(b[6], t[3]) - max(b[4], t[1])
                area = (b[5] - b[3]) * (b[6] - b[4])
                if w > 0 and h > 0 and area > 0 and w * h / area >= 0.5:
                    return True
        return False

    t = spark.createDataFrame(tables, BOX).withColumnRenamed("block_id", "region_id")
    got = boxes.unmasked(spark.createDataFrame(blocks, BOX), t, side=side)
    assert sorted(map(tuple, got.select("doc_id", "page", "block_id").collect())) == sorted(b[:3] for b in blocks if not hidden(b))


def test_table_of_words(spark):
    words = [("Name", 0, 0, 30, 10), ("Unit", 100, 1, 130, 11), ("price", 132, 1, 160, 11), ("a|b", 0, 20, 20, 30), ("3", 105, 21, 110, 31), ("c", 0, 40, 9, 50), ("below", 0, 95, 30, 105)]
    w = spark.createDataFrame([(1, 1, t, *map(float, b)) for t, *b in words], "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double")
    region = spark.createDataFrame([(1, 1, 7, True, -5.0, -5.0, 200.0, 60.0), (1, 2, 8, True, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, region_id int, ruled boolean, x0 double, y0 double, x1 double, y1 double")
    got = boxes.tables_of(w, region).collect()
    # the two words of a heading stand side by side: a column each, as their boxes don't overlap
    assert [(r.region_id, r.rows, r.columns, r.filled) for r in got] == [(7, 3, 3, 6)]
    assert got[0].markdown == "|Name|Unit|price|\n|---|---|---|\n|a\\|b|3||\n|c|||"
    pages = spark.createDataFrame([(1, 1, 20000.0)], "doc_id long, page int, page_area double")
    keep = lambda regions, pages: boxes.accepted(boxes.tables_of(w, regions), regions, pages).count()
    assert keep(region, pages) == 1
    assert keep(region, pages.selectExpr("doc_id", "page", "14000D as page_area")) == 0  # all of the page
    assert keep(region.selectExpr("doc_id", "page", "region_id", "false as ruled", "x0", "y0", "x1", "y1"), pages) == 1
    assert keep(region.selectExpr("doc_id", "page", "region_id", "false as ruled", "x0", "y0", "x1", "32D as y1"), pages) == 0  # two rows and no ruling


@pytest.mark.parametrize("side", [None, 40.0])
def test_tables_equal_brute_force(spark, side):
    r = random.Random(9)
    texts = ["a", "bc", "d|e", "|", "", None]
    words = []
    for d in range(12):
        for _ in range(r.randrange(1, 40)):
            x, y = r.randrange(0, 200, 5), r.randrange(0, 200, 5)
            words.append((d % 4, d // 4, r.choice(texts), float(x), float(y), float(x + r.choice([0, 10, 25])), float(y + r.choice([8, 12]))))
    words += r.choices(words, k=20)  # boxes that are alike in all
    regions = [(d % 4, d // 4, i, *box) for d in range(12) for i, box in enumerate([(0.0, 0.0, 90.0, 200.0), (90.0, 0.0, 210.0, 100.0), (50.0, 50.0, 150.0, 150.0)])]

    def lanes(boxes, start, end):
        number, reach, out = -1, None, {}
        for i in sorted(boxes, key=lambda i: (words[i][start], words[i][end], words[i][4], words[i][3], words[i][2] is not None, words[i][2] or "")):
            if reach is None or words[i][start] >= reach:
                number += 1
            reach = max(words[i][end], words[i][end] if reach is None else reach)
            out[i] = number
        return out

    def table(d, p, x0, y0, x1, y1):
        inside = []
        for i, (a, b, _, *w) in enumerate(words):
            area, width, height = (w[2] - w[0]) * (w[3] - w[1]), min(x1, w[2]) - max(x0, w[0]), min(y1, w[3]) - max(y0, w[1])
            if (a, b) == (d, p) and area > 0 and width > 0 and height > 0 and width * height / area >= 0.5:
                inside.append(i)
        row, col = lanes(inside, 4, 6), lanes(inside, 3, 5)
        cells = {}
        for i in sorted(inside, key=lambda i: (words[i][3], words[i][4], words[i][2] is not None, words[i][2] or "")):
            cells.setdefault((row[i], col[i]), []).extend([] if words[i][2] is None else [words[i][2].replace("|", "\\|")])
        if not inside:
            return None
        n, m = max(row.values()) + 1, max(col.values()) + 1
        lines = ["|" + "|".join(" ".join(cells.get((i, j), [])) for j in range(m)) + "|" for i in range(n)]
        return n, m, len(cells), sum(len(" ".join(c)) for c in cells.values()), "\n".join([lines[0], "|" + "---|" * m, *lines[1:]])

    expected = sorted((d, p, i, *t) for d, p, i, *box in regions if (t := table(d, p, *box)))
    w = spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = boxes.tables_of(w, spark.createDataFrame(regions, "doc_id long, page int, region_id int, x0 double, y0 double, x1 double, y1 double"), side=side)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 30


def test_a_table_costs_the_same_whatever_its_region_covers(spark, small):
    """A region is one row, not one for each grid cell it covers, and words that are dealt by document stay where they are."""
    from lodestone.plans import layout_queries, queries  # noqa: F401  registers them

    w = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 9.0, 9.0), (1, 1, "b", 0.0, 20.0, 9.0, 29.0)], "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double")
    wide = spark.createDataFrame([(1, 1, 0, -1e13, -1e13, 1e13, 1e13)], "doc_id long, page int, region_id int, x0 double, y0 double, x1 double, y1 double")
    assert [r.markdown for r in boxes.tables_of(w, wide).collect()] == ["|a|\n|---|\n|b|"]
    plan = queries.QUERIES["box_tables"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan
    # the order lines once; the documents for the regions of the join, for those of the result and for the pages
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("Exchange") == 4


def test_regions_are_not_broadcast(spark, small):
    """There is a region a page: Spark would guess these small by their few columns and gather them in the driver."""
    from lodestone.plans import layout_queries, queries  # noqa: F401  registers them

    for name in ("box_tables", "unmasked_blocks"):
        assert "Broadcast" not in queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString(), name
