import json

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from a list of texts (or of pairs doc_id, text), with a column whose name clashes with the operators' own."""

    def make(texts, **extra):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return df.selectExpr("*", "'x' as n", "1 as lead", "2 as key", "'y' as regs")

    return make


@pytest.fixture
def words():
    """Deterministic made-up words."""

    def make(n, seed=0):
        import random

        r = random.Random(seed)
        return [f"w{r.randrange(5000)}" for _ in range(n)]

    return make


def dump(rows):
    return sorted(json.dumps(r, default=str) for r in rows)
