"""Each registered workspace query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.plans import document_queries, golden_queries, index_queries, layout_queries, more_queries, queries, report_queries, run_queries, table_queries, workspace_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if not isinstance(v, (list, np.ndarray)) and pd.isna(v):
            return "null"
        return round(v, 9) if isinstance(v, float) else str(v)

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, db, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    if name in queries.ORACLE:
        assert rows(got) == rows(db.execute(queries.ORACLE[name]).df())
    else:
        assert len(got.columns) == len(set(got.columns))


def test_planted_rows_are_found(spark, small):
    assert queries.QUERIES["injection_scan"](spark, small).where("reasons <> ''").count() > 0
    assert queries.QUERIES["secret_redaction"](spark, small).where("found <> ''").count() > 0


def test_members_see_no_audit(spark, small):
    from lodestone.operators import access
    from lodestone.plans import fixtures as fx

    assert access.readable("audit_log", fx.answers(spark, small), fx.members(spark, small), 11).count() == 0


def test_quotes_far_into_a_text_and_repeated(spark, tmp_path):
    from lodestone.operators import quotes as qs

    far = "x" * 210_000 + " the quoted words "
    texts = {1: far, 2: "The  Quoted words", 3: "the quoted words " * 40, 4: None, 5: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select 'q' as item_id, 'the quoted words' as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert (1, 420) in {(r.doc_id, r.chunk_index) for r in run("interval_join")}
    brute = sorted((i, *at) for i, t in texts.items() for at in qs.occurrences(t or "", "the quoted words"))
    assert len(brute) == 42 and sorted((r.doc_id, r.char_start, r.char_end) for r in run("quote_occurrences")) == brute
    found = sorted((r.doc_id, r.char_start, r.chunk_index, r.spans_boundary) for r in run("occurrence_passages"))
    expected = []
    for i, a, b in brute:
        k = range(a // 500, (b - 1) // 500 + 1)
        expected += [(i, a, j, len(k) > 1) for j in k]
    assert found == sorted(expected)


def test_sharp_s_folds_as_in_sql(spark, tmp_path):
    """A text that holds ss for a quote's sharp s, or words that begin after one: the full fold differs from the SQL's lower()."""
    t = "der Stra\u00dfe entlang"
    texts = ["DER STRASSE ENTLANG", "der Stra\u00dfe | entlang", "the, gro\u00dfund so", "gro\u00dfthe and", "\u0130der und", None, "zzzz", "der strasse entlang und the"]
    docs = spark.createDataFrame([(i, x, "de", "s", len(x or "")) for i, x in enumerate(texts * 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t if i % 2 else "so und so") for i in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"create view {n} as select * from '{tmp_path}/{n}.parquet/*.parquet'")
    for name in ("golden_passages", "golden_status", "golden_fact_problems", "incomplete_facts", "key_facts", "fact_presence"):
        got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert rows(got) == rows(con.execute(queries.ORACLE[name]).df()), name


def test_facts_in_lower_case_take_alternatives_literally(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import text

    facts = ["1\\E2", "a.c", "x|B", "|", "", "5", None]
    df = spark.createDataFrame([("1\\E2 b", facts), ("abc 15", facts), (None, facts)], "t string, f array<string>")
    got = [r[0] for r in df.select(text.facts_in_lower(F.col("t"), F.col("f"))).collect()]
    assert got == [[True, False, True, False, False, False, False], [False] * 7, [False] * 7]
