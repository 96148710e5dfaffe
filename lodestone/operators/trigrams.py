"""Substring lookup by trigram postings: names that contain a text share its rarest gram; candidates are confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram; texts that are shorter have grams of their own length.
SIZE = 3


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of `size` letters."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, column: str, size: int = SIZE) -> DataFrame:
    """gram and the row's columns, for each distinct gram."""
    return rows.withColumn("gram", F.explode(grams(F.col(column), size)))


def containing(needles: DataFrame, needle: str, rows: DataFrame, column: str) -> DataFrame:
    """Columns of both frames for each row whose `column` contains `needle`; empty and null needles match nothing.

    Each needle meets the rows by one gram, the one that the fewest rows have, so neither a nested loop nor all pairs of common grams.
    """
    out = None
    for size in range(1, SIZE + 1):
        own = needles.where(F.length(needle) >= size if size == SIZE else F.length(needle) == size)
        posts = postings(rows, column, size)
        many = posts.groupBy("gram").agg(F.count("*").alias("many"))
        asked = own.select(needle).distinct().withColumn("gram", F.explode(grams(F.col(needle), size)))
        # a gram that no row has rules its needle out
        rarest = asked.join(many, "gram", "left").groupBy(needle).agg(F.min_by("gram", F.struct(F.coalesce("many", F.lit(0)), "gram")).alias("gram"))
        found = posts.join(rarest, "gram").where(F.contains(column, needle)).drop("gram").join(own, needle)
        out = found if out is None else out.unionByName(found)
    return out
