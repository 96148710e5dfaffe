"""Notes as block trees (JSON): readable text, previews, rules, and search over lists of notes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest note, the deepest nesting, the length of a preview, and blocks whose parts stand on lines of their own.
MAX_BYTES, MAX_NESTING, PREVIEW = 512_000, 40, 240
LINES = frozenset({"doc", "bulletList", "orderedList", "taskList", "blockquote"})


def _tree(text: str | None):
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def tree_text(root) -> str:
    """Text of a tree, children before parents with a stack, so that nesting has no limit."""
    todo, done = [(root, False)], []
    while todo:
        node, seen = todo.pop()
        children = node.get("content") if isinstance(node, dict) else None
        children = children if isinstance(children, list) else []
        if not isinstance(node, dict):
            done.append("")
        elif node.get("type") == "text":
            done.append(str(node.get("text", "")))
        elif not seen:
            todo.append((node, True))
            todo += [(c, False) for c in reversed(children)]
        else:
            own = done[len(done) - len(children) :]
            del done[len(done) - len(children) :]
            done.append(("\n" if node.get("type") in LINES else " ").join(t for t in own if t).strip())
    return done[0]


def nesting(root) -> int:
    level, nodes = 0, [root]
    while True:
        nodes = [c for n in nodes if isinstance(n, dict) and isinstance(n.get("content"), list) for c in n["content"]]
        if not nodes:
            return level
        level += 1


def tree_problem(text: str | None) -> str | None:
    root = _tree(text)
    if not isinstance(root, dict) or root.get("type") != "doc":
        return "not a document"
    blocks = root.get("content", [])
    if not isinstance(blocks, list) or not all(isinstance(b, dict) and isinstance(b.get("type"), str) for b in blocks):
        return "a block has no type"
    if len(json.dumps(root)) > MAX_BYTES:
        return "too large"
    return "too deep" if nesting(root) > MAX_NESTING else None


@F.pandas_udf(T.StringType())
def plain_text(content: pd.Series) -> pd.Series:
    return content.map(lambda c: tree_text(_tree(c)))


@F.pandas_udf(T.StringType())
def problem(content: pd.Series) -> pd.Series:
    """Why a note is refused; null if it is fine."""
    return content.map(tree_problem)


def preview(content: Column) -> Column:
    return F.left(plain_text(content), F.lit(PREVIEW))


def search(notes: DataFrame, wanted: str) -> DataFrame:
    """Notes (title, preview) that hold the trimmed words, ignoring case; all of them for a blank search."""
    q = wanted.strip().lower()
    return notes.where(F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("preview"), F.lit(q))) if q else notes
