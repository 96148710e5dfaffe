"""Stored indexes: equal to a scan where exact, recall where not, and what they leave unread."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fulltext, inverted_index, lineage, retrieval, vector_index
from lodestone.plans import fixtures as fx
from lodestone.plans import index_queries, queries


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16)) * 4
    x = centres[np.arange(600) % 12] + r.normal(size=(600, 16)) * 0.3
    data = [(i, f"d{i % 5}", v.tolist()) for i, v in enumerate(x)] + [(600, "d0", [0.0] * 16), (601, "d1", None)] + [(700 + i, "d2", x[0].tolist()) for i in range(40)]
    return spark.createDataFrame(data, "chunk_id long, document_id string, vector array<double>")


@pytest.fixture(scope="module")
def asked(spark, clustered):
    q = clustered.where("chunk_id % 23 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return q.unionByName(spark.createDataFrame([(9999, None)], q.schema))


def test_exact_search_equals_the_scan_and_reads_few_cells(spark, clustered, asked, tmp_path):
    index = vector_index.build(clustered, f"{tmp_path}/v", cells=24)
    columns = ("query_id", "chunk_id", "score", "dense_rank")
    found = vector_index.search(asked, index, 7)
    assert rows(found, *columns) == rows(retrieval.dense_search(asked, clustered, 7), *columns)
    one = asked.where("query_id = 23")
    cells = index.cells(spark).toPandas()
    q = vector_index.unit(np.array([one.first().query_vector]))
    by_cell = {int(cells.cell[0]): [0]}
    plan = vector_index._visit(index.rows(spark), by_cell, [23], q, 7, "query_id long, chunk_id long, score double, dense_rank int")
    assert "PartitionFilters: [isnotnull(cell" in plan._jdf.queryExecution().toString() or "PartitionFilters: [cell" in plan._jdf.queryExecution().toString()
    files = {f.rpartition("cell=")[2].partition("/")[0] for f in index.rows(spark).where(F.col("cell").isin(list(by_cell))).inputFiles()}
    assert len(files) >= 1 and cells.n.sum() == 641


def test_search_widens_until_the_filter_leaves_enough(spark, clustered, asked, tmp_path):
    index = vector_index.build(clustered, f"{tmp_path}/v", cells=24)
    scope = spark.createDataFrame([("d3",)], "document_id string")
    got = vector_index.search(asked, index, 9, probes=1, scope=scope)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {9}
    exact = vector_index.search(asked, index, 9, scope=scope)
    columns = ("query_id", "chunk_id", "score")
    assert rows(exact, *columns) == rows(retrieval.dense_search(asked, clustered.where("document_id = 'd3'"), 9), *columns)
    assert vector_index.search(asked, index, 9, where=F.lit(False)).count() == 0


def test_empty_index(spark, clustered, asked, tmp_path):
    index = vector_index.build(clustered.where("false"), f"{tmp_path}/v")
    assert vector_index.search(asked, index, 3).count() == 0


def test_recall_of_the_probed_cells(spark):
    """On the tables of scale 0.1: at least 0.9 of the exact 20 nearest."""
    d = "/root/testdata/sf0.1"
    exact = retrieval.dense_search(queries._queries(spark, d), fx.chunks(spark, d).select("chunk_id", "vector"), 20)
    assert vector_index.recall(index_queries.indexed_search_probes(spark, d), exact) >= 0.9


def brute(texts, asked, k, allowed=None):
    lex = lambda df, c: {r[0]: r[1] for r in df.select("id", fulltext.lexemes(F.col(c))["lexeme"]).collect()}
    docs, wanted = lex(texts, "content"), lex(asked, "query_text")
    out = []
    for q, terms in wanted.items():
        scored = []
        for c, words in docs.items():
            n = sum(w in set(terms) for w in words)
            if n and (allowed is None or c in allowed):
                scored.append((-round(n / (n + 1), 9), c))
        out += [(q, c, -s, i) for i, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 256])
def test_bounded_search_equals_brute_force(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(inverted_index, "BLOCK", block)
    monkeypatch.setattr(inverted_index, "CLASSES", 8)
    monkeypatch.setattr(inverted_index, "FIRST", 2)
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["the", "running", "classes", "ponies"]
    texts = [(i, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(34)], k=int(2 ** r.uniform(0, 8))))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "the the")]
    texts += [(2000 + i, "w1 w2 w3") for i in range(100)]  # a third is one text
    docs = spark.createDataFrame(texts, "chunk_id long, content string")
    asked = spark.createDataFrame([(i, " ".join(r.choices(words, k=4))) for i in range(25)] + [(90, "the"), (91, None), (92, "unknown")], "query_id long, query_text string")
    index = inverted_index.build(docs, f"{tmp_path}/p")
    columns = ("query_id", "chunk_id", "score", "sparse_rank")
    args = docs.withColumnRenamed("chunk_id", "id"), asked.withColumnRenamed("query_id", "id")
    found = retrieval.sparse_search(asked, index, 10)
    assert rows(found, *columns) == brute(*args, 10)
    assert rows(found, *columns) == rows(retrieval.sparse_search(asked, fulltext.postings(docs), 10), *columns)
    allowed = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "chunk_id long")
    assert rows(retrieval.sparse_search(asked, index, 10, allowed), *columns) == brute(*args, 10, set(range(0, 300, 7)))
    looked, there = inverted_index.blocks_scored(asked, index, found, 10)
    assert block == 256 or looked < 0.6 * there


def test_scope_holds_for_both_legs(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"d{i % 4}", f"shared words number{i}", [1.0, float(i)]) for i in range(40)], "chunk_id long, document_id string, content string, vector array<double>")
    index = inverted_index.build(chunks, f"{tmp_path}/p")
    q = spark.createDataFrame([(1, "shared words", [1.0, 5.0])], "query_id long, query_text string, query_vector array<double>")
    documents = spark.createDataFrame([("d0", "ready"), ("d1", "ready"), ("d2", "failed"), ("d3", "ready")], "document_id string, parsed_status string")
    seen = lambda **kw: {r.document_id for r in retrieval.hybrid_search(q, chunks, index, retrieval.SUMMARIZE, **kw).collect()}
    assert seen(documents=documents) <= {"d0", "d1", "d3"}
    assert seen(documents=documents, document_ids=spark.createDataFrame([("d1",), ("d2",)], "document_id string")) == {"d1"}
    with pytest.raises(ValueError):
        retrieval.hybrid_search(q, chunks, index, document_ids=documents)


def test_index_is_built_once_a_session(spark, small):
    assert index_queries.lexemes(spark, small) is index_queries.lexemes(spark, small)
    assert lineage.folder(spark) in index_queries.vectors(spark, small).path


PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skis ski dying die generate generat generously generous communism communism arsenal arsenal ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoped hope
hopefully hope bed bed shed shed shred shred bead bead say say boy boy by by cry cri enjoying enjoy youth youth proceed proceed relational relat analogy analog fulfil fulfil"""


def test_published_stems():
    from lodestone.functions import english

    words = PUBLISHED.split()
    wrong = {w: (english.stem(w), s) for w, s in zip(words[::2], words[1::2], strict=True) if english.stem(w) != s}
    assert not wrong


def test_english_index_equals_a_scan_by_stems(spark, tmp_path):
    from lodestone.functions import english

    texts = ["The knights knocked and kept knocking", "consistent consistency", "A consoling console of consoles", None, "knock"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "knocks"), (2, "consistently consoled"), (3, "the")], "query_id long, query_text string")
    index = inverted_index.build(docs, f"{tmp_path}/p", stemmer=inverted_index.english)
    got = rows(inverted_index.search(asked, index, 5, terms=inverted_index.english_terms), "query_id", "chunk_id", "score")
    stems = lambda t: [english.stem(w) for w in t.lower().split() if w not in fulltext.STOP_WORDS]
    expected = []
    for q, text in ((1, "knocks"), (2, "consistently consoled"), (3, "the")):
        for c, t in enumerate(texts):
            if t and (n := sum(w in set(stems(text)) for w in stems(t))):
                expected.append((q, c, round(n / (n + 1), 9)))
    assert got == sorted(expected) and len(got) == 4
