import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import language, quality
from lodestone.llm import language_model as lm


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_scores_and_base(frame, words):
    texts = [None, "", " ".join(words(40)), " ".join(words(40)).upper()] + [" ".join(words(30, i % 5)) for i in range(40)]
    got = {r.doc_id: r for r in lm.scores(frame(texts)).collect()}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in enumerate(texts)}
    count = Counter(w for i, t in tokens.items() if fold(i, 7) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 7) == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    seen = [r for r in got.values() if r.n_tokens > 20 and not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_scores_without_id(frame, words):
    t = " ".join(words(40))
    got = lm.scores(frame([(None, t), (1, t), (None, "a b"), (2, None)])).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens) for r in got) == sorted((i or -1, i is not None and fold(i, 7) == 2, n) for i, n in [(None, 41), (1, 41), (None, 3), (2, 1)])


def test_scores_of_nothing(frame):
    assert lm.scores(frame([(0, "x")]).where("doc_id < 0")).count() == 0


def test_group_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    word, cell = np.repeat(np.arange(30), 4), np.tile(np.arange(4), 30)
    p = lm.predictive(word, cell, rng.integers(0, 5, 120), 30, 1)
    assert np.allclose(np.bincount(cell, p), 1, atol=1e-6)


def test_sweeps_of_a_group(monkeypatch):
    swept = []
    sweep = lm.Seating.sweep
    monkeypatch.setattr(lm.Seating, "sweep", lambda self, w, d: (swept.append(d), sweep(self, w, d)))
    lm.predictive(np.array([0, 1]), np.array([0, 0]), np.array([40, 3]), 2, 1)
    assert swept.count(lm.DISCOUNT) == 4 and swept.count(lm.PARENT_DISCOUNT) == 5
    assert len(lm.Seating(np.array([40]), np.random.default_rng(0)).rounds) == 32


def test_seating_keeps_its_counts():
    rng = np.random.default_rng(3)
    count = np.array([0, 1, 2, 7, 100, 1000])
    s = lm.Seating(count, rng)
    for _ in range(5):
        s.sweep(lambda d: np.full(len(d), 2.0), 0.5)
        sizes = np.bincount(s.dish[s.at // 2], minlength=6)
        assert (sizes == np.where(count > 1, count, 0)).all()
        tables = [len(set(s.at[s.dish == i])) for i in range(6)]
        assert tables[2:] == s.tables[2:].tolist() and s.tables[:2].tolist() == [0, 1]


def test_seating_agrees_with_all_partitions():
    """Mean tables of three customers against the sum over all five partitions."""
    d, w = 0.75, 1.3
    weight = {1: w * (1 - d) * (2 - d), 2: 3 * w * w * (1 - d), 3: w**3}
    expected = sum(t * x for t, x in weight.items()) / sum(weight.values())
    s = lm.Seating(np.full(20000, 3), np.random.default_rng(5))
    for _ in range(25):
        s.sweep(lambda dishes: np.full(len(dishes), w), d)
    assert abs(s.tables.mean() - expected) < 0.02


def test_scores_of_held_out_text_beat_the_base(frame, words):
    rng = np.random.default_rng(7)
    lines = [" ".join(words(12, i)) for i in range(20)]
    got = lm.scores(frame([" ".join(rng.choice(lines, 6)) for _ in range(200)])).where("held_out").collect()
    assert len(got) > 15 and sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


@pytest.fixture
def labelled(spark, frame, words):
    good = [" ".join(words(60, i)) + "." for i in range(120)]
    bad = [" ".join(w + "$$$" for w in words(60, 500 + i)) for i in range(60)]
    texts = good + bad + [None, "", "é" * 5000]
    docs = frame(texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180) if i % 3], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 183 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(180) if fold(i, 4) == 2]
    assert sum((got[i] >= 0.7) == (i < 120) for i in held) / len(held) > 0.9


def test_quality_sums_over_all_unlabelled_text(labelled):
    docs, labels = labelled
    own = quality.Unlabelled(quality.doc_columns(docs).where(~quality.held_out()))
    x = quality.features(pa.array([r.text for r in docs.where(~quality.held_out()).collect()], pa.string()))
    assert np.allclose(own.summed(lambda x: x), x.sum(axis=0), rtol=1e-5)
    model = quality.fit_nnpu(x[:80], x, 0.5)
    risk = lambda m: 0.5 * np.logaddexp(0, -(z := quality.standard(x[:80], m) @ m["w"] + m["b"])).mean() + max(0, np.logaddexp(0, quality.standard(x, m) @ m["w"] + m["b"]).mean() - 0.5 * np.logaddexp(0, z).mean())
    assert risk(quality.refine(model, x[:80], x, own, 0.5, ridge=0.0)) <= risk(model)


def test_rows_without_id_are_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "the of and", "en"), (2, "der die das", "de")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for f, n, r in ((quality.op5_quality, 4, 2), (language.op7_language, 3, 1)):
        assert {x.doc_id: x.held_out for x in f(spark, str(tmp_path)).collect()} == {None: False, 2: fold(2, n) == r}


def test_quality_without_labels(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels.where("doc_id < 0"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_language_on_held_out_rows(spark):
    en, de = "the of and to in that is was for with".split(), "der die und das nicht ein zu von mit ist".split()
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(en if i % 2 else de, 30)), "en" if i % 2 else "de") for i in range(300)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", None), (1003, "the of and to " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()}
    held = [i for i in range(300) if fold(i, 3) == 1]
    assert sum(got[i][0] == ("en" if i % 2 else "de") for i in held) / len(held) > 0.95
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0) and got[1003][0] == "en"
    none = language.predict(docs, language.train(docs.where("doc_id < 0"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_windows_cover_the_text():
    data = np.frombuffer(b"ABC" * 300, np.uint8)
    x, doc = language.windows(data, np.array([0, 0, 900]))
    assert doc.tolist() == [0, 1, 1, 1, 1] and (x[0] == 0).all() and bytes(x[-1]) == (b"abc" * 300)[-256:]
