import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import near_dedup as nd
from lodestone.llm import substring_dedup as sd
from lodestone.llm.common import Words


def sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts):
    s = sets(texts)
    comp = list(range(len(s)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            k = len(s[i] & s[j])
            if k and 100 * k >= 75 * (len(s[i]) + len(s[j]) - k):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i), find(i) == i) for i in range(len(s))}


def near(frame, texts):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame(texts)).collect()}


def corpus(words, copies=40, seed=3):
    """Texts with exact copies, near-copies at many distances, and copies of copies."""
    r = random.Random(seed)
    base = words(80, seed)
    out = [None, "", "  \t", "one", "one", "One", "a b c d", "A b c d", "a b c d e"]
    for _ in range(copies):
        t = list(r.choice([base, out[-1].split()]) if len(out) > 12 else base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = f"n{r.randrange(9999)}"
        out.append(" ".join(t))
    return out + [" ".join(words(60, 100 + i)) for i in range(10)] + [" ".join(base)] * 3


def test_near_duplicates_match_brute_force(frame, words):
    texts = corpus(words)
    assert near(frame, texts) == brute_components(texts)


def test_near_duplicates_of_nothing(frame, spark):
    assert nd.near_duplicates(frame([(0, "x")]).where("doc_id < 0")).count() == 0
    assert near(frame, [None, ""]) == {0: (0, 0, True), 1: (0, 1, True)}


def test_repeated_rows_share_a_component(frame, words):
    t = " ".join(words(30))
    got = [(r.doc_id, r.component_id) for r in nd.near_duplicates(frame([(5, t), (5, t), (3, t)])).collect()]
    assert sorted(got) == [(3, 3), (5, 3), (5, 3)]


def test_rows_without_id(frame, words):
    w = words(60)
    t, close, other = " ".join(w), " ".join([*w[:-1], "end"]), " ".join(words(60, 9))
    docs = frame([(4, t), (None, t), (7, t), (3, close), (None, other), (None, other), (None, other.upper()), (None, None), (None, " ")])
    got = nd.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(3, 3, True), (4, 3, False), (7, 3, False)]
    null = [r for r in got if r.doc_id is None]
    assert sorted(r.kept for r in null if r.component_id == 3) == [False] and len(null) == 6
    assert len({r.component_id for r in null if r.n_shingles and r.component_id != 3}) == 1
    kept = sorted((r.doc_id or -1, (r.text or "").lower().strip()) for r in nd.keep_one(docs).collect())
    assert kept == [(-1, ""), (-1, ""), (-1, other), (3, close)]


def test_keep_one_keeps_columns(frame, words):
    t = " ".join(words(30))
    docs = frame([t, t.upper(), "other text of five words"])
    out = nd.keep_one(docs)
    assert out.columns == docs.columns or set(out.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**62, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:340], rng.integers(0, 2**62, 60).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    r = nd.sketch([a, b])
    est = nd.joint_estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - true) < 0.12
    merged = nd.sketch([np.union1d(a, b)])
    # registers are kept modulo 256, so the greater of two is told by their difference
    assert (np.where((r[0] - r[1]).view(np.int8) > 0, r[0], r[1]) == merged[0]).all()


def brute_removal(docs, window=50):
    """Every window of every document against a table of first documents."""
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def dedup(frame, texts):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup(frame(texts)).collect()}


def passages(words, seed=5):
    r = random.Random(seed)
    shared = [words(r.randrange(45, 140), 50 + i) for i in range(6)]
    out = [None, "", "short text", " ".join(shared[0][:49]), " ".join(shared[0][:50]), " ".join(shared[0][:50])]
    for i in range(30):
        parts = [words(r.randrange(0, 60), 200 + i)]
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            a = r.randrange(0, max(1, len(p) - 50))
            parts += [p[a : a + r.randrange(40, 90)], words(r.randrange(5), 300 + i)]
        out.append(" ".join(w for p in parts for w in p))
    return [*out, "x " * 300, "x " * 200, "y z " * 120, "y z " * 130]


@pytest.mark.parametrize("limit", [60_000, 10])
def test_substring_dedup_matches_brute_force(frame, words, monkeypatch, limit):
    """By automata, and by window hashes where a lead has more words than a shard holds."""
    monkeypatch.setattr(sd, "SHARD_WORDS", limit)
    texts = passages(words)
    assert dedup(frame, texts) == brute_removal(dict(enumerate(texts)))


def test_substring_dedup_of_nothing(frame):
    assert sd.dedup(frame([(0, "x")]).where("doc_id < 0")).count() == 0


def test_equal_ids_are_one_document(frame, words):
    t = " ".join(words(70))
    got = [(r.doc_id, r.n_removed) for r in sd.dedup(frame([(4, t), (4, t), (9, t)])).collect()]
    assert sorted(got) == [(4, 0), (4, 0), (9, 70)]


def test_texts_of_one_id_are_one_document(frame, words):
    """Different texts of one doc_id keep what they share; copies and repeated rows of either go by the smaller id."""
    a, b, c = (" ".join(words(n, n)) for n in (70, 60, 49))
    rows = [(4, a), (4, f"{b} {a}"), (4, a), (9, a), (9, b), (2, b), (2, b), (7, c), (8, c), (None, a), (None, b)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in sd.dedup(frame(rows)).collect())
    assert got == sorted([(4, 70, 0), (4, 130, 60), (4, 70, 0), (9, 70, 70), (9, 60, 60), (2, 60, 0), (2, 60, 0), (7, 49, 0), (8, 49, 0), (0, 70, 0), (0, 60, 0)])
    out = sd.remove_repeats(frame(rows).selectExpr("*", "'z' as kept", "5L as text_key"))
    assert sorted((r.doc_id or 0, r.n_chars, r.kept, r.text_key) for r in out.collect() if r.doc_id in (9, 4)) == sorted([(4, len(a), "z", 5)] * 3 + [(9, 0, "z", 5)] * 2)


def test_remove_repeats_keeps_columns(frame, words):
    t = words(60)
    docs = frame([" ".join(t), "before  " + " ".join(t) + " after", "left  as it is"])
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == ("before after", 12) and got[2][0] == "left  as it is"


def test_matching_statistics():
    s = sd.SuffixAutomaton()
    s.add([1, 2, 3, 4, 2, 3])
    s.add([9, 1, 2])
    assert s.statistics([7, 2, 3, 4, 9, 1, 2, 3]).tolist() == [0, 1, 2, 3, 1, 2, 3, 3]


def test_words_as_bytes_split():
    texts = ["a  b\tc\x0bd", "", "é\xa0x \x1cq", " lead", "tail "]
    w = Words(pa.array(texts))
    assert w.count().tolist() == [len(t.encode().split()) for t in texts]
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [x for t in texts for x in t.encode().split()]


def test_keep_one_with_clashing_columns_and_repeated_rows(frame, words):
    text = " ".join(words(30))
    docs = frame([(1, text), (1, text), (2, text), (3, None), (None, text)]).selectExpr("*", "7 as gone", "8 as row", "9 as own", "1 as component_id")
    got = nd.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.gone) for r in got.collect()) == [(1, 7), (1, 7), (3, 7)]
