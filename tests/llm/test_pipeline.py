"""The corpus pipeline stage by stage against plain Python, each stage on its own input."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from lodestone.llm import quality, tokens
from lodestone.llm.common import tokenizer_path

WORD = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def one_of_each_group(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    find = lambda i: i if low[i] == i else find(low[i])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return [(i, t) for i, t in rows if find(i) == i]


def without_repeats(rows, size=50):
    first = {}
    words = {i: re.findall(WORD, t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = []
    for i, t in rows:
        w = words[i]
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


def uncontaminated(rows, items, size=13):
    windows = set()
    for t in items:
        w = re.findall(PLAIN, lower(t))
        windows |= {tuple(w[k : k + min(size, len(w))]) for k in range(max(1, len(w) - size + 1))} if w else set()
    sizes = {len(x) for x in windows}

    def bad(t):
        w = re.findall(PLAIN, lower(t))
        hit = {j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        return len(hit) > 0 and 20 * len(hit) >= len(w)

    return [(i, t) for i, t in rows if not bad(t)]


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(4000)}"
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, item = text(60), text(20)
    docs = [(i, text(r.randrange(30, 160))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(8)] + [(110 + i, docs[i][1].replace(" w1", " W1", 1) + " more") for i in range(8)]
    docs += [(200 + i, f"{text(80)} {passage} {text(40)}") for i in range(6)] + [(300 + i, f"{text(60)} {item} {text(40)}") for i in range(14)]
    docs += [(400 + i, " ".join(f"{word()}$$$" for _ in range(60))) for i in range(30)]  # what is labelled bad
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "x " * 9000)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], columns).repartition(3)
    df.selectExpr("*", "1 as gone", "2 as key", "3 as row", "'c' as component_id", "4 as kept", "5 as regs", "6 as score").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 400), 0) for i, _ in docs if i % 2] + [(None, 1, 0), (9999, 0, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), [item]


def test_stages_equal_plain_python(spark, folder, monkeypatch):
    d, items = folder
    models = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda *a: models.append(train(*a)) or models[-1])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, pairs = docs.columns, lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    steps = {
        "quality": lambda rows: [x for x, s in zip(rows, quality.apply_model(models[-1], quality.features(pa.array([t for _, t in rows], pa.string()))), strict=True) if s >= quality.THRESHOLD],
        "near_dedup": one_of_each_group,
        "substring_dedup": without_repeats,
        "decontamination": lambda rows: uncontaminated(rows, items),
    }
    seen = [len(pairs(docs))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = pairs(docs)
        docs = corpus_pipeline.materialize(stage(spark, docs, d), name)
        assert docs.columns == columns and pairs(docs) == sorted(steps[name](before)), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
        seen.append(len(pairs(docs)))
    assert seen[0] > seen[1] > seen[2] and seen[3] > seen[4]  # every stage decided something
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path(tokens.WORD_TOKENIZER))
    sizes = defaultdict(int)
    for r in pieces:
        sizes[r.doc_id] += r.length
    assert dict(sizes) == {i: len(encode.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in pairs(docs)}


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    d, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
