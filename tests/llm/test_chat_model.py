"""Baum-Welch of the chat model against sums over all paths, and what it learns."""

import itertools
import zlib

import numpy as np

from lodestone.llm import chat

LINES = ["User: hi there?", "", "lower case", "Assistant: Yes", "System: be kind", "A: ok?", "Text", "Q: why"]


def by_all_paths(seen, first, model):
    """Expected counts and likelihood of one block."""
    n = len(chat.STATES)
    start, step, by, total = np.zeros(n), np.zeros((n, n)), np.zeros((32, n)), 0.0
    begin = model.start if first else model.step.mean(axis=0)
    for path in itertools.product(range(n), repeat=len(seen)):
        p = begin[path[0]] * np.prod([model.emission[s, x] for s, x in zip(path, seen, strict=True)]) * np.prod([model.step[a, b] for a, b in itertools.pairwise(path)])
        total += p
        start[path[0]] += p * first
        for a, b in itertools.pairwise(path):
            step[a, b] += p
        for s, x in zip(path, seen, strict=True):
            by[x, s] += p
    return np.concatenate([start, step.ravel(), by.ravel()]) / total, total


def test_expected_counts_against_all_paths(monkeypatch):
    rng = np.random.default_rng(3)
    blocks = [(chat.symbols([LINES[i] for i in rng.integers(0, len(LINES), n)])[0].tobytes(), bool(rng.integers(2))) for n in (1, 2, 3, 4, 4, 5, 1, 3)]
    model = chat.renewed(chat.expected_counts(blocks, chat.PRIOR))
    for m in (chat.PRIOR, model):
        wanted = sum(by_all_paths(np.frombuffer(s, np.uint8), f, m)[0] for s, f in blocks)
        assert np.allclose(chat.expected_counts([*blocks, (b"", True)], m) / chat.COUNT, wanted, atol=1e-4)
    whole = chat.expected_counts(blocks, model)
    assert (whole == sum(chat.expected_counts([b], model) for b in blocks)).all()
    monkeypatch.setattr(chat, "CELLS", 6)
    assert (whole == chat.expected_counts(blocks, model)).all()


def test_rounds_raise_the_likelihood_and_keep_probabilities(monkeypatch):
    monkeypatch.setattr(chat, "PRIOR_WEIGHT", 1e-6)
    rng = np.random.default_rng(4)
    blocks = [(chat.symbols([LINES[i] for i in rng.integers(0, len(LINES), 4)])[0].tobytes(), True) for _ in range(12)]
    model, last = chat.PRIOR, -np.inf
    for _ in range(5):
        now = sum(np.log(by_all_paths(np.frombuffer(s, np.uint8), f, model)[1]) for s, f in blocks)
        assert now >= last - 1e-6
        last, model = now, chat.renewed(chat.expected_counts(blocks, model))
    for p in (model.start, model.step, model.mark, model.features):
        assert np.allclose(p.sum(axis=-1), 1)
    assert ((model.step > 0) <= (chat.PRIOR.step > 0)).all()


def conversations(spark, n, silent):
    """Two people taking turns; `silent` of ten turns of the assistant have no marker."""
    rows = []
    for c in range(n):
        text = []
        for t in range(12):
            person = t % 2 == 0
            mark = "User: " if person else "" if zlib.crc32(f"{c}:{t}".encode()) % 10 < silent else "Assistant: "
            text.append(mark + ("Could you say more?" if person else "It is so."))
        rows.append((c, 0, "\n".join(text), ",".join(["user", "assistant"] * 6)))
    return spark.createDataFrame(rows, "conv_id long, part long, transcript string, true_roles string")


def test_learned_roles_of_turns_without_markers(spark):
    blocks = conversations(spark, 120, silent=5)
    model = chat.fit(blocks)
    held = blocks.where(chat.held_out()).collect()
    right = lambda m: np.mean([",".join(r for r, _ in chat.parse(x.transcript, m)) == x.true_roles for x in held])
    assert len(held) > 10 and right(model) == 1.0 > right(chat.PRIOR) + 0.2
    assert 0.3 < model.mark[chat.STATES.index(("assistant", True)), 3] < 0.5  # one in two, drawn to the prior's 0.12 by its counts


def test_the_model_goes_by_training_text_alone(spark):
    blocks = conversations(spark, 40, silent=3)
    same = lambda a, b: all((getattr(a, k) == getattr(b, k)).all() for k in ("start", "step", "mark", "features"))
    model = chat.fit(blocks)
    assert same(model, chat.fit(blocks.where(~chat.held_out()).repartition(7))) and not same(model, chat.PRIOR)
    assert same(chat.fit(blocks.where("conv_id < 0")), chat.PRIOR)
    assert same(chat.fit(spark.createDataFrame([(1, 0, None), (None, 0, " \n")], "conv_id long, part long, transcript string")), chat.renewed(np.zeros(234)))
