"""Page layout from boxes: blocks that tables mask, and tables made of the boxes inside a region.

Boxes are rows (doc_id, page, ..., x0, y0, x1, y1). All work is on pages dealt by key. Masks meet their blocks by grid cells, which share a
page with very many boxes. The words of a table meet again by table anyway, so they meet their page's regions by page: no copy of a region
for each cell it covers, and what the join has dealt needs no second shuffle. There are as many regions as pages, so none are broadcast,
however small Spark guesses them from few columns: joins merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a grid cell in points.
CELL = 100.0
# Share of a block that a table must cover, share of a page beyond which a region is no table, fewest rows of a table, and
# what a table without ruling lines must have: rows, columns, filled share of its cells, mean length of a cell.
COVERED, WHOLE_PAGE, LEAST_ROWS = 0.5, 0.92, 2
BORDERLESS_ROWS, BORDERLESS_COLUMNS, BORDERLESS_FILLED, BORDERLESS_CHARS = 3, 2, 0.5, 40


def _cells(df: DataFrame, side: float, of: str = "") -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(of + a) / side), F.floor(F.greatest(F.col(of + a), F.col(of + b)) / side))
    return df.withColumn("_gx", F.explode(span("x0", "x1"))).withColumn("_gy", F.explode(span("y0", "y1")))


def shared_area(boxes: DataFrame, regions: DataFrame, side: float | None = CELL) -> DataFrame:
    """Pairs of boxes and regions (region_id) of a page that overlap, with `share`: of the box's area inside the region.

    Both are dealt to grid cells and meet by (page, cell); a pair that meets in several is kept in the first that they share. A region
    costs a row for each cell it covers. Without a side they meet by page, which costs boxes by regions of a page and no copies.
    """
    r = regions.select("doc_id", "page", "region_id", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    if side is None:
        both, first = boxes.join(r.hint("merge"), ["doc_id", "page"]), F.lit(True)
    else:
        both = _cells(boxes, side).join(_cells(r, side, "r").hint("merge"), ["doc_id", "page", "_gx", "_gy"])
        first = (F.col("_gx") == F.floor(F.greatest("x0", "rx0") / side)) & (F.col("_gy") == F.floor(F.greatest("y0", "ry0") / side))
    width, height = F.least("x1", "rx1") - F.greatest("x0", "rx0"), F.least("y1", "ry1") - F.greatest("y0", "ry0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return both.where(first & (width > 0) & (height > 0) & (area > 0)).withColumn("share", width * height / area).select(*boxes.columns, "region_id", "share")


def unmasked(blocks: DataFrame, tables: DataFrame, key: str = "block_id", side: float = CELL) -> DataFrame:
    """Blocks of which no table covers half or more."""
    hidden = shared_area(blocks, tables, side).where(F.col("share") >= COVERED).select("doc_id", "page", key).distinct()
    return blocks.join(hidden.hint("merge"), ["doc_id", "page", key], "left_anti")


def _lanes(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Numbers bands of a table's boxes along one axis (`name`), and counts them (`name`s): a box that begins beyond all before it opens the next.

    Of rows, a box belongs to the band that its middle is past; of a table's boxes alone, so a group is one table.
    """
    table = Window.partitionBy("doc_id", "page", "region_id")
    order = table.orderBy(start, end, "y0", "x0", "text")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    # a box equal to another never opens a band, so counting by rows gives equal boxes one number
    number = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return df.withColumn("_opens", opens).withColumns({name: number, f"{name}s": F.sum("_opens").over(table)}).drop("_opens")


def tables_of(words: DataFrame, regions: DataFrame, side: float | None = None) -> DataFrame:
    """doc_id, page, region_id, rows, columns, filled, chars and markdown of each region's table.

    words: doc_id, page, text, x0, y0, x1, y1. A word that lies in a region by half or more is in its table; rows are bands of
    words one above the other, columns bands side by side; words of one cell are joined in reading order. The first row is the head.
    A side of grid cells pays where single pages have thousands of small regions.
    """
    table = ["doc_id", "page", "region_id"]
    inside = shared_area(words.select("doc_id", "page", "text", "x0", "y0", "x1", "y1"), regions, side).where(F.col("share") >= COVERED).drop("share")
    placed = _lanes(_lanes(inside, "y0", "y1", "row").drop("rows"), "x0", "x1", "column").withColumn("text", F.replace("text", F.lit("|"), F.lit("\\|")))
    # words without text come first in their cell, as they need no space before the next
    listed = F.sort_array(F.collect_list(F.struct("column", F.col("text").isNotNull().alias("said"), "x0", "y0", "text")))
    before = lambda i: F.get(F.col("_w"), i - 1)

    def piece(x: Column, i: Column) -> Column:
        gap = F.when(x["column"] > before(i)["column"], F.repeat(F.lit("|"), (x["column"] - before(i)["column"]).cast("int"))).when(before(i)["said"], F.lit(" ")).otherwise(F.lit(""))
        return F.concat(F.when(i == 0, F.repeat(F.lit("|"), (x["column"] + 1).cast("int"))).otherwise(gap), F.coalesce(x["text"], F.lit("")))

    lines = placed.groupBy(*table, "row", "columns").agg(listed.alias("_w"))
    text = F.concat(F.array_join(F.transform("_w", piece), ""), F.repeat(F.lit("|"), (F.col("columns") - F.element_at("_w", -1)["column"]).cast("int")))
    lines = lines.select(*table, "row", "columns", text.alias("line"), F.size(F.array_distinct(F.transform("_w", lambda x: x["column"]))).alias("n"))
    body = F.sort_array(F.collect_list(F.struct("row", "line")))
    # a line is its cells and a bar before, between and after them
    chars = F.sum(F.length("line") - F.col("columns") - 1)
    out = lines.groupBy(*table, "columns").agg(F.count("*").alias("rows"), F.sum("n").alias("filled"), chars.alias("chars"), body.alias("body"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("columns").cast("int")))
    text = F.array_join(F.concat(F.array(F.col("body")[0]["line"], rule), F.transform(F.slice("body", 2, F.greatest(F.size("body"), F.lit(1))), lambda x: x["line"])), "\n")
    return out.select(*table, "rows", "columns", "filled", "chars", text.alias("markdown"))


def accepted(tables: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables (tables_of) that count: two rows at least, not the whole page, and those without ruling lines plausibly filled.

    regions: region_id, ruled and the box; pages: doc_id, page, page_area.
    """
    box = regions.select("doc_id", "page", "region_id", "ruled", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("_area"))
    rows = tables.join(box.hint("merge"), ["doc_id", "page", "region_id"]).join(pages.select("doc_id", "page", "page_area").hint("merge"), ["doc_id", "page"])
    plausible: Column = (F.col("rows") >= BORDERLESS_ROWS) & (F.col("columns") >= BORDERLESS_COLUMNS) & (F.col("filled") >= F.col("rows") * F.col("columns") * BORDERLESS_FILLED) & (F.col("chars") / F.col("filled") <= BORDERLESS_CHARS)
    fits = (F.col("rows") >= LEAST_ROWS) & (F.col("_area") / F.col("page_area") <= WHOLE_PAGE)
    return rows.where(fits & (F.col("ruled") | plausible)).select(*tables.columns)
