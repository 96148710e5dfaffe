"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by driver and executors; a local session without it sets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of an Arrow batch where a row may be long: a worker holds a few batches at once.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Python workers get batches of ARROW_ROWS at most."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
