"""Pipeline health over retrieval runs and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.operators.ranks import ranked


def in_window(created_at: Column, today: str, days: int) -> Column:
    """The last `days` days up to today; later rows count too."""
    return F.to_date(created_at) >= F.date_sub(F.lit(today).cast("date"), days - 1)


def rerank_unavailable(top_score: Column, n_scores: Column) -> Column:
    return top_score.isNull() & (F.coalesce(n_scores, F.lit(0)) > 0)


def percentiles(rows: DataFrame, value: str, percents: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Exact nearest-rank percentiles (index bround(p * (n - 1))) of each group, by counting equal values.

    Values are counted first (partial aggregation), then ranks come from a running sum over distinct values in
    two levels, so neither one group's rows nor one task's grow with the rows.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_block", F.pmod(F.floor(F.col(value) / F.lit(64)), F.lit(1 << 40)))
    blocks = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_bn"), F.min(value).alias("_first"))
    before = Window.partitionBy(*by).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_before"), F.sum("_bn").over(Window.partitionBy(*by)).alias("_all"))
    inside = Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(blocks, [*by, "_block"]).withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    picks = []
    for name, p in percents.items():
        at = stats.nearest_rank(F.col("_all"), p)
        picks.append(F.min(F.when(F.col("_upto") > at, F.col(value))).alias(name))
    return ranked.groupBy(*by).agg(*picks) if by else ranked.agg(*picks)


def daily(runs: DataFrame, answers: DataFrame, today: str, days: int) -> DataFrame:
    """One row for each day of the window, also days without rows."""
    spark = runs.sparkSession
    spine = calendar(spark, today, days)
    r = runs.where(in_window(F.col("created_at"), today, days)).withColumn("day", F.to_date("created_at"))
    a = answers.where(in_window(F.col("created_at"), today, days)).withColumn("day", F.to_date("created_at"))
    by_run = r.groupBy("day").agg(F.count("*").alias("questions"), F.count_if(F.col("grade_outcome") == "good").alias("good"))
    by_answer = a.groupBy("day").agg(F.count("*").alias("answers"), F.count_if("groundedness_pass").alias("grounded"), F.count_if("flagged").alias("flagged"))
    p50 = percentiles(r, "latency_ms", {"latency_p50_ms": 50}, ["day"])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("questions", "good", "answers", "grounded", "flagged")]
    out = spine.join(by_run, "day", "left").join(by_answer, "day", "left").join(p50, "day", "left").select("day", *zero, "latency_p50_ms")
    return out.withColumns({"good_rate": stats.rate(F.col("good"), F.col("questions")), "grounded_rate": stats.rate(F.col("grounded"), F.col("answers")), "flagged_rate": stats.rate(F.col("flagged"), F.col("answers"))})


def calendar(spark: SparkSession, today: str, days: int) -> DataFrame:
    end = F.lit(today).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))


def summary(runs: DataFrame, answers: DataFrame, today: str, days: int) -> DataFrame:
    """One row: counts and rates over the window; rates are null over nothing."""
    r = runs.where(in_window(F.col("created_at"), today, days))
    a = answers.where(in_window(F.col("created_at"), today, days))
    n = F.count("*")
    of_runs = r.agg(
        n.alias("questions"),
        stats.rate(F.count_if(F.col("grade_outcome") == "good"), n).alias("graded_good_rate"),
        stats.rate(F.count_if(F.coalesce("retry_count", F.lit(0)) > 0), n).alias("retried_rate"),
        stats.rate(F.count_if(rerank_unavailable(F.col("top_score"), F.col("n_scores"))), n).alias("rerank_unavailable_rate"),
        F.max("latency_ms").alias("latency_max_ms"),
        F.count("latency_ms").alias("latency_n"),
    )
    of_answers = a.agg(n.alias("answers"), stats.rate(F.count_if("groundedness_pass"), n).alias("grounded_rate"), stats.rate(F.count_if("flagged"), n).alias("flagged_rate"))
    p = percentiles(r, "latency_ms", {"latency_p50_ms": 50, "latency_p95_ms": 95})
    return of_runs.crossJoin(of_answers).crossJoin(p)  # three single rows


def frequency(rows: DataFrame, value: Column, label: str | None = None, order: str = "created_at") -> DataFrame:
    """value, n, and position by falling count; ties by first occurrence. A missing value counts as `label`."""
    v = value if label is None else F.when(value.isNull() | (value == ""), F.lit(label)).otherwise(value)
    counts = rows.select(v.alias("value"), F.col(order).alias("_o")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"), F.min("_o").alias("_first"))
    return ranked(counts, [], [F.desc("n"), F.asc("_first"), F.asc("value")], "position").select("value", "n", "position")


def flag_reasons(answers: DataFrame, reasons: str = "flag_reasons", order: str = "created_at") -> DataFrame:
    """Frequencies over an array column."""
    return frequency(answers.select(order, F.explode(reasons).alias("reason")), F.col("reason"), order=order)
