"""Tables that change: by key without rewriting the rest, and several together or not at all.

`KeyedTable` deals a table's rows to hash buckets of its key, a folder each; a change rewrites the buckets of the keys it touches and
leaves the files of all others. `Ledger` stages the rows of several tables under a batch id, checks rules over them, and publishes one
manifest last: readers see whole batches only, a batch that comes again changes nothing, and one that failed can be tried again.
Each has one writer at a time.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import lineage


@dataclass(frozen=True)
class KeyedTable:
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Writes a new table; the bucket is a partition column, so a reader of one key reads one folder."""
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys asked for, from their buckets alone."""
        asked = keys.select(*self.keys).distinct()
        return self._rows(asked).join(asked, list(self.keys), "left_semi").drop("bucket")

    def _rows(self, keys: DataFrame) -> DataFrame:
        touched = sorted(r.bucket for r in keys.select(self._bucket().alias("bucket")).distinct().collect())  # at most `buckets`
        return keys.sparkSession.read.parquet(self.path).where(F.col("bucket").isin(touched))

    def merge(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Rows of `changed` in place of those with their keys, and rows with the keys of `gone` taken out.

        Both may hold a key once only. What is left of the touched buckets is written aside first, then takes the place of their
        files at once; a failure before that leaves the table as it was.
        """
        frames = [f for f in (changed, gone) if f is not None]
        keys = lineage.cut(functools.reduce(DataFrame.unionByName, [f.select(*self.keys) for f in frames]).distinct())
        if keys.isEmpty():
            return
        old = self._rows(keys)
        kept = old.join(keys, list(self.keys), "left_anti")
        new = kept if changed is None else kept.unionByName(changed.select(*(c for c in old.columns if c != "bucket")).withColumn("bucket", self._bucket()))
        staged = lineage.cut(new.select(*old.columns))
        spark, bare = keys.sparkSession, old.drop("bucket").schema
        emptied = [r.bucket for r in old.select("bucket").distinct().join(staged.select("bucket").distinct(), "bucket", "left_anti").collect()]
        staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in emptied:  # a partition without rows isn't written, so it is emptied by name
            spark.createDataFrame([], bare).write.mode("overwrite").parquet(f"{self.path}/bucket={bucket}")

    def upsert(self, changed: DataFrame) -> None:
        self.merge(changed=changed)

    def delete(self, keys: DataFrame) -> None:
        self.merge(gone=keys)


class RuleBroken(ValueError):
    """A batch was not published. rows: rule and how many rows break it."""

    def __init__(self, rows: list[tuple[str, int]]):
        super().__init__("; ".join(f"{rule}: {n} row(s)" for rule, n in rows))
        self.rows = rows


_MANIFEST = "batch_id string, seq long, tables array<string>"


@dataclass(frozen=True)
class Ledger:
    """keys: the key columns of each table; a later batch's row stands for earlier ones of its key."""

    path: str
    keys: dict[str, tuple[str, ...]]

    def manifests(self, spark: SparkSession) -> DataFrame:
        """batch_id, seq and tables of the published batches."""
        spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{self.path}/manifests")
        return spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests")

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        """The table's rows as published; null before its first batch."""
        published = self.manifests(spark).where(F.array_contains("tables", table)).select("batch_id", "seq").orderBy("seq").collect()
        if not published:
            return None
        rows = spark.read.option("basePath", f"{self.path}/{table}").option("mergeSchema", True).parquet(*(f"{self.path}/{table}/seq={r.seq}-{r.batch_id}" for r in published))
        w = Window.partitionBy(*self.keys[table]).orderBy(F.desc(F.regexp_extract("seq", r"^(\d+)", 1).cast("long")))
        return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1 and not _gone").drop("_nth", "_gone", "seq")

    def commit(self, spark: SparkSession, batch_id: str, changed: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, rules: dict[str, Callable[[Ledger, dict[str, DataFrame]], DataFrame]] | None = None) -> bool:
        """Publishes the rows of all tables together; whether anything was published (False: this batch already was).

        gone: keys whose rows go. rules: by name, a function of the ledger and the staged frames that gives the rows that break it.
        Nothing is visible until the manifest, one file of one row, is there; a batch that failed is staged anew.
        """
        manifests = self.manifests(spark)
        if not manifests.where(F.col("batch_id") == batch_id).isEmpty():
            return False
        seq = (manifests.agg(F.max("seq")).first()[0] or 0) + 1
        staged, tables = {}, sorted({*changed, *(gone or {})})
        for name in tables:
            parts = [changed[name].withColumn("_gone", F.lit(False))] if name in changed else []
            if gone and name in gone:
                keys = gone[name].select(*self.keys[name]).withColumn("_gone", F.lit(True))
                parts.append(keys)
            place = f"{self.path}/{name}/seq={seq}-{batch_id}"
            functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").parquet(place)
            staged[name] = spark.read.parquet(place)
        twice = {f"{name} holds a key once": (lambda _, frames, name=name: frames[name].groupBy(*self.keys[name]).count().where("count > 1")) for name in tables}
        broken = [(rule, n) for rule, check in {**twice, **(rules or {})}.items() if (n := check(self, {k: v.where("not _gone") if rule not in twice else v for k, v in staged.items()}).count())]
        if broken:
            raise RuleBroken(broken)
        spark.createDataFrame([(batch_id, seq, tables)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")
        return True


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{lineage.folder(spark)}/{name}-{uuid.uuid4().hex}"
