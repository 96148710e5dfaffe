"""Quotes found in documents and resolved to passages by interval joins."""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import LOWERED
from lodestone.operators import lineage, trigrams

# How punctuation folds, and characters that are formatting only.
PUNCTUATION = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "→": "->", "⟶": "->", "➔": "->", "…": "...",
}
FORMATTING = "​‌‍⁠﻿"
_GAP = re.compile(r"(?:<br\s*/?>|[\s|" + FORMATTING + r"])+", re.IGNORECASE)


class _Folded(dict):
    """Each character's folded form, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = PUNCTUATION.get(c) or unicodedata.normalize("NFKC", c).casefold()
        return out


@dataclass(frozen=True)
class Folding:
    """How texts fold: what counts as a gap, which of its characters are formatting only, and each other character's form."""

    gap: re.Pattern
    formatting: str
    characters: dict


FULL = Folding(_GAP, FORMATTING, _Folded())
#: Lower case and gaps of ASCII white space and |, character for character, as SQL folds: no sharp s becomes ss.
PLAIN = Folding(re.compile(r"[\t\n\f\r |]+"), "", LOWERED)


def fold(text: str, folding: Folding = FULL) -> tuple[str, list[int]]:
    """Folded text and, for each of its characters, the offset in the original. Gaps are one space, none at the ends."""
    out, at, i = [], [], 0
    while i < len(text):
        gap = folding.gap.match(text, i)
        if gap:
            visible = gap.group().strip(folding.formatting) if folding.formatting else gap.group()
            if visible and out and out[-1] != " ":
                out.append(" ")
                at.append(gap.start() + gap.group().index(visible[0]))
            i = gap.end()
            continue
        for piece in folding.characters[ord(text[i])]:
            out.append(piece)
            at.append(i)
        i += 1
    while out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def folded_text(text: str, folding: Folding = FULL) -> str:
    """The same folded text as fold() gives, without offsets: a few passes in C."""
    gap = folding.gap.match(text)
    bare = text[gap.end() :] if gap else text
    space = (lambda m: " " if m.group().strip(folding.formatting) else "") if folding.formatting else " "
    return folding.gap.sub(space, bare).translate(folding.characters).rstrip(" ")


def placed(text: str, ends: list[tuple[int, int]], folding: Folding = FULL) -> list[tuple[int, int]]:
    """Folded places (index of the last character, length) as offsets in the original text."""
    at = fold(text, folding)[1] if ends else []
    return [(at[end - size + 1], at[end] + 1) for end, size in ends]


def occurrences(text: str, quote: str) -> list[tuple[int, int]]:
    """Every place of the quote, overlapping ones too, as offsets in the original text."""
    hay, needle = folded_text(text), folded_text(quote)
    return placed(text, [(m.start() + len(needle) - 1, len(needle)) for m in re.finditer(f"(?={re.escape(needle)})", hay)] if needle else [])


#: Characters of folded quotes in one automaton: bounds what is sent to every task, and its size there.
BLOCK_CHARS = 4 << 20
_machines: dict[int, tuple] = {}


def automaton(key: int, needles: dict[str, list]):
    """Automaton over the distinct folded quotes, kept by a worker for as long as it searches the same block."""
    if key not in _machines:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for needle, ids in needles.items():
            machine.add_word(needle, (len(needle), ids))
        machine.make_automaton()
        _machines.clear()
        _machines[key] = machine
    return _machines[key]


def find_quotes(documents: DataFrame, quotes: DataFrame, folding: Folding = FULL) -> DataFrame:
    """quote_id, doc_id, char_start, char_end of every occurrence of every quote, overlapping ones too.

    Quotes are a stated set. All that fit one block of BLOCK_CHARS are sought together, in one pass over each folded document
    (Aho-Corasick), so a scan serves tens of thousands of them; nothing is shuffled. Several blocks are written one after the other,
    and what was sent for one is released before the next.
    """
    spark = documents.sparkSession
    schema = f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}, doc_id long, char_start int, char_end int"
    docs = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null")

    def scan(needles: dict[str, list]) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(needles)
        key = uuid.uuid4().int

        def run(frames):
            machine = automaton(key, sent.value)
            for pdf in frames:
                out = []
                for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                    found = [(end, *value) for end, value in machine.iter(folded_text(text, folding))]
                    for (_, _, ids), span in zip(found, placed(text, [f[:2] for f in found], folding), strict=True):
                        out += [(q, doc, *span) for q in ids]
                yield pd.DataFrame(out, columns=["quote_id", "doc_id", "char_start", "char_end"])

        return docs.mapInPandas(run, schema), sent

    needles, size, parts = {}, 0, []
    for row in quotes.select("quote_id", "quote").where("quote is not null").toLocalIterator():
        needle = folded_text(row.quote, folding)
        if needle and needle not in needles and size + len(needle) > BLOCK_CHARS and needles:
            found, sent = scan(needles)
            parts.append(lineage.cut(found))
            sent.destroy()
            needles, size = {}, 0
        if needle:
            size += 0 if needle in needles else len(needle)
            needles.setdefault(needle, []).append(row.quote_id)
    if needles:
        parts.append(scan(needles)[0])
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


#: Characters of a bin of the interval join.
BIN = 4096


def overlapping(spans: DataFrame, passages: DataFrame, width: int = BIN) -> DataFrame:
    """Spans (doc_id, char_start, char_end, ...) with each passage (doc_id, chunk_index, c_start, c_end) that they overlap.

    Both are dealt to bins of character ranges and meet by (document, bin), so one very long document is shared by many tasks; a
    pair that meets in several bins is kept in the first that they share.
    """

    def binned(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        first = F.floor(F.col(start) / width)
        return df.withColumn(name, first).withColumn("bin", F.explode(F.sequence(first, F.floor(F.greatest(F.col(start), F.col(end) - 1) / width))))

    both = binned(spans, "char_start", "char_end", "_m").join(binned(passages, "c_start", "c_end", "_c"), ["doc_id", "bin"])
    meets = (F.col("c_start") < F.col("char_end")) & (F.col("char_start") < F.col("c_end")) & (F.col("bin") == F.greatest("_m", "_c"))
    return both.where(meets).drop("bin", "_m", "_c")


def resolve(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """quote_id, doc_id, char_start, char_end, chunk_index, spans_boundary: passages that hold a match, else all that it overlaps."""
    c = chunks.select("doc_id", "chunk_index", F.col("char_start").alias("c_start"), F.col("char_end").alias("c_end"))
    both = overlapping(matches, c).withColumn("_inside", (F.col("c_start") <= F.col("char_start")) & (F.col("char_end") <= F.col("c_end")))
    w = Window.partitionBy("quote_id", "doc_id", "char_start", "char_end")
    return both.withColumn("_any", F.max("_inside").over(w)).where("_inside or not _any").select(*matches.columns, "chunk_index", (~F.col("_any")).alias("spans_boundary"))


def expected_passages(resolved: DataFrame) -> DataFrame:
    """quote_id and its distinct passages (doc_id, chunk_index)."""
    return resolved.select("quote_id", "doc_id", "chunk_index").distinct()


def find_document(names: DataFrame, documents: DataFrame) -> DataFrame:
    """name, doc_id by exact file name, else by a unique normalised name, else by a unique part of one; null if none is."""
    from lodestone.functions.text import normalise_name

    d = documents.select("doc_id", "file_name", normalise_name("file_name").alias("norm"))
    n = names.select("name", normalise_name("name").alias("wanted")).distinct()
    exact = n.join(d, F.col("name") == F.col("file_name")).groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.lit(1).alias("way"))
    unique = lambda x, way: x.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1").select("name", "doc_id", F.lit(way).alias("way"))
    same = unique(n.join(d, F.col("wanted") == F.col("norm")), 2)
    part = unique(trigrams.containing(n, "wanted", d, "norm"), 3)
    best = exact.unionByName(same).unionByName(part).groupBy("name").agg(F.min_by("doc_id", "way").alias("doc_id"))
    return n.select("name").join(best, "name", "left")
