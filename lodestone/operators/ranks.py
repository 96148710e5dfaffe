"""Places of rows within groups of any size: a group is shared by tasks, as no window holds it whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import lineage


def apart(key: Column, by: Column) -> Column:
    """A key of a left join as text, where nulls (which match nothing) get a text of their own each, from `by`: else all of them go to one task."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\0"), by.cast("string")))


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the place from 1 of each row in its group (all rows, if by is empty), as row_number gives it for a total order.

    Rows are dealt to ranges of (group, order) and sorted there; a row's place is its place in the range and the rows
    of its group in the ranges before, which are one row for each group and range. Null keys are one group.
    """
    keys = [F.col(c) for c in by]
    sort = [*(k.asc_nulls_first() for k in keys), *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = lineage.cut(placed.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    add = ranges.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), (before - F.col("_low") + 1).alias("_add"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.col("_range") == F.col("_of"))
    return placed.join(add, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_at") + F.col("_add")).alias(name))
