"""Places in groups that tasks share, against row_number; facts of red-team cases; file checks."""

import io
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import evaluation, ranks, work
from lodestone.sources import files


@pytest.fixture
def spread(spark):
    """Small tables keep their partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.mark.usefixtures("spread")
def test_ranks_equal_row_number(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, id % 7, if(id % 50 = 1, null, 1)) as g", "if(id % 11 = 0, null, id * 7919 % 1000) as v", "id", "'x' as `a.b`")
    order = [F.asc_nulls_last("v"), F.desc("id")]
    got = ranks.ranked(rows, ["g"], order, "place")
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    alone = ranks.ranked(rows, [], order, "place").select("id", "place")
    assert alone.exceptAll(rows.select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))).count() == 0 and alone.count() == 5000
    assert ranks.ranked(rows.where("id < 0"), ["g"], order, "place").count() == 0


@pytest.mark.usefixtures("spread")
def test_a_group_is_shared_by_tasks(spark):
    rows = spark.range(20000).selectExpr("1 as g", "id")
    placed = ranks.ranked(rows.repartition(8), ["g"], [F.asc("id")], "place")
    assert placed.where("place <> id + 1").count() == 0
    assert spark.read.parquet(*placed.inputFiles()).select("_range").distinct().count() > 1


def test_listing_of_null_workspaces(spark):
    t = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (5, 4)], "workspace_id int, task_id long").selectExpr("*", "cast(null as date) as due_date", "'low' as priority", "'t' as title")
    assert sorted((r.task_id, r.position, r.more) for r in work.listing(t, 2).collect()) == [(1, 1, 1), (2, 2, 1), (4, 1, 0)]


def test_expected_facts_of_cases(spark):
    schema = "id int, canaries array<string>, forbidden array<string>, shown string, proposals array<string>, poison struct<`false`:string,`true`:string>, parts array<string>, retrieved boolean, detected boolean, expected_facts array<string>"
    rows = [(1, [], [], "It is 40 days.", [], None, None, True, False, ["40", "forty one"]), (2, [], [], "x", [], None, None, True, False, None)]
    got = {r.id: [(x.fact, x.present) for x in r.score.expected_facts] for r in evaluation.red_team_case(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [("40", True), ("forty one", False)], 2: []}


def test_files_that_only_look_like_archives():
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("word/document.xml", "<x/>")
    data = whole.getvalue()
    assert files.file_problem("docx", data) is None
    assert files.file_problem("docx", b"text before " + data) == "not a DOCX file"
    assert files.file_problem("docx", data[: len(data) // 2]) == "damaged DOCX file"
