"""Pages made from the documents' lines: a box for each line and each word, regions on some pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.plans import fixtures as fx
from lodestone.plans.queries import query
from lodestone.sources import boxes


def _blocks(spark, d):
    """Lines as blocks, forty a page; a region on two pages of three."""
    lines = fx.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    i = F.col("line_no").cast("long")
    x0, y0 = (F.col("doc_id") * 13 + i * 29) % 240, (i % 40) * 20
    blocks = lines.select("doc_id", F.floor(i / 40).alias("page"), (i % 40).alias("block_id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.length("text"), F.lit(90)) * 4).alias("x1"), (y0 + 12).alias("y1"))
    k = F.col("doc_id") + F.col("page") * 7
    pages = blocks.select("doc_id", "page").distinct().where(k % 3 != 0)
    regions = pages.select("doc_id", "page", (k % 5).alias("region_id"), ((k * 31) % 200).alias("x0"), ((k * 17) % 500).alias("y0"), ((k * 31) % 200 + 260).alias("x1"), ((k * 17) % 500 + 150).alias("y1"))
    return blocks, regions


@query("""with l as (select doc_id, t, i - 1 as i from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
b as (select doc_id, i // 40 as page, i % 40 as block_id, (doc_id * 13 + i * 29) % 240 as x0, (i % 40) * 20 as y0, (doc_id * 13 + i * 29) % 240 + least(length(t), 90) * 4 as x1, (i % 40) * 20 + 12 as y1 from l),
r as (select doc_id, page, (k * 31) % 200 as rx, (k * 17) % 500 as ry from (select distinct doc_id, page, doc_id + page * 7 as k from b) where k % 3 <> 0)
select doc_id, page, block_id from b where not exists (select 1 from r where r.doc_id = b.doc_id and r.page = b.page and x1 > x0
 and greatest(0, least(x1, rx + 260) - greatest(x0, rx)) * greatest(0, least(y1, ry + 150) - greatest(y0, ry)) >= 0.5 * (x1 - x0) * (y1 - y0))""")
def unmasked_blocks(spark, d):
    """Lines of which no table region covers half."""
    return boxes.unmasked(*_blocks(spark, d)).select("doc_id", "page", "block_id")


@query("""with l as (select l_orderkey as doc_id, l_linenumber as row, [cast(l_partkey as varchar), l_returnflag, cast(l_linenumber as varchar)] as c, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem),
g as (select doc_id, row_number() over (partition by doc_id order by row, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as r, c from l),
t as (select doc_id, count(*) as rows, 3::bigint as columns, string_agg('|' || array_to_string(c, '|') || '|' || case when r = 0 then chr(10) || '|---|---|---|' else '' end, chr(10) order by r) as markdown from g group by 1)
select doc_id, rows, columns, md5(markdown) as markdown from t where rows >= 2""")
def box_tables(spark, d):
    """Order lines as words in three columns of a ruled region each order has, with a heading outside it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = fx.read(spark, d, "lineitem").withColumn("n", F.row_number().over(w))
    line = line.select(F.col("l_orderkey").alias("doc_id"), "n", F.array(F.col("l_partkey").cast("string"), "l_returnflag", F.col("l_linenumber").cast("string")).alias("c"))
    words = line.select("doc_id", F.lit(1).alias("page"), "n", F.posexplode("c").alias("k", "text"))
    words = words.select("doc_id", "page", "text", (50 + F.col("k") * 150).alias("x0"), (100 + F.col("n") * 20).alias("y0"), (50 + F.col("k") * 150 + 8 * F.length("text")).alias("x1"), (112 + F.col("n") * 20).alias("y1"))
    docs = line.select("doc_id").distinct()
    head = docs.select("doc_id", F.lit(1).alias("page"), F.lit("Order").alias("text"), F.lit(50).alias("x0"), F.lit(20).alias("y0"), F.lit(120).alias("x1"), F.lit(40).alias("y1"))
    regions = docs.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("region_id"), F.lit(True).alias("ruled"), F.lit(40).alias("x0"), F.lit(110).alias("y0"), F.lit(600).alias("x1"), F.lit(5000).alias("y1"))
    found = boxes.tables_of(words.unionByName(head), regions)
    kept = boxes.accepted(found, regions, docs.select("doc_id", F.lit(1).alias("page"), F.lit(600.0 * 8000).alias("page_area")))
    return kept.select("doc_id", "rows", "columns", F.md5("markdown").alias("markdown"))
