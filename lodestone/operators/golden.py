"""Golden questions resolved against the corpus: required passage groups, distractors, fact rules and the problems of each.

questions: id, answerable, documents (array of names), expected_quote, also_acceptable, also_required, distractor_quotes (arrays of
quotes), must_include, must_not_include, facts_lost (arrays of facts). documents: doc_id, file_name, parsed_status, text. chunks:
doc_id, chunk_index, char_start, char_end. All quotes of all questions are sought in one scan of the documents, and so are all facts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import fold_fact
from lodestone.operators import lineage, quotes


def _each(questions: DataFrame, column: str, role: str) -> DataFrame:
    return questions.select("id", F.lit(role).alias("role"), F.posexplode(F.col(column)).alias("nth", "quote"))


def asked_quotes(questions: DataFrame) -> DataFrame:
    """id, role (expected, acceptable, required, distractor), nth, quote of answerable questions."""
    q = questions.where("answerable")
    one = q.select("id", F.lit("expected").alias("role"), F.lit(0).alias("nth"), F.coalesce("expected_quote", F.lit("")).alias("quote"))
    more = (("also_acceptable", "acceptable"), ("also_required", "required"), ("distractor_quotes", "distractor"))
    for column, role in more:
        one = one.unionByName(_each(q, column, role))
    return one


def named_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """id, nth, name, doc_id and parsed_status of the documents that answerable questions name; null where none matches."""
    names = questions.where("answerable").select("id", F.posexplode("documents").alias("nth", "name"))
    found = quotes.find_document(names.select("name").distinct(), documents.select("doc_id", "file_name"))
    known = found.join(documents.select("doc_id", "file_name", "parsed_status"), "doc_id", "left")
    return names.join(known.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left").drop("_name")


def located(questions: DataFrame, documents: DataFrame, chunks: DataFrame, named: DataFrame, folding: quotes.Folding = quotes.FULL) -> DataFrame:
    """id, role, nth, doc_id, chunk_index, spans_boundary: passages of each quote, in the named documents for expected and required ones, in any ready one for the others."""
    asked = asked_quotes(questions)
    ready = documents.where("parsed_status = 'ready'")
    distinct = asked.select("quote").distinct().select(F.sha2("quote", 256).alias("quote_id"), "quote")
    held = quotes.resolve(quotes.find_quotes(ready.select("doc_id", "text"), distinct, folding), chunks.join(ready.select("doc_id"), "doc_id", "left_semi"))
    # a passage that holds one match whole counts as such, whatever other matches cross it
    places = lineage.cut(held.groupBy("quote_id", "doc_id", "chunk_index").agg(F.bool_and("spans_boundary").alias("spans_boundary")))
    rows = asked.withColumn("quote_id", F.sha2("quote", 256)).join(places, "quote_id").drop("quote", "quote_id")
    limits = named.groupBy("id").agg(F.lit(True).alias("limited"))
    inside = named.select("id", "doc_id", F.lit(True).alias("inside")).distinct()
    rows = rows.join(limits, "id", "left").join(inside, ["id", "doc_id"], "left")
    everywhere = F.col("role").isin("acceptable", "distractor") | F.col("limited").isNull()
    return rows.where(everywhere | F.col("inside")).drop("limited", "inside")


def resolve(questions: DataFrame, documents: DataFrame, chunks: DataFrame, folding: quotes.Folding = quotes.FULL) -> tuple[DataFrame, DataFrame]:
    """Passages and status of the questions.

    passages: id, grp (0: the expected quote or an alternative, 1, 2, ...: each further required quote; null: a distractor that no
    group has), doc_id, chunk_index. status: id, problem (null: it can be scored), groups, passages, distractors, and how many
    alternatives and distractors were not found and how many passages hold only a part of a quote.
    """
    named = lineage.cut(named_documents(questions, documents))
    places = lineage.cut(located(questions, documents, chunks, named, folding))
    spot = ["id", "doc_id", "chunk_index"]
    group = F.when(F.col("role") == "required", F.col("nth") + 1).otherwise(0)
    groups = places.where("role <> 'distractor'").select("id", group.alias("grp"), "doc_id", "chunk_index").distinct()
    traps = places.where("role = 'distractor'").select(*spot).distinct().join(groups, spot, "left_anti")

    first_bad = F.min_by(F.when(F.col("doc_id").isNull(), F.concat(F.lit("no document matching "), "name")).otherwise(F.concat("file_name", F.lit(" is "), "parsed_status", F.lit(", not ready"))), "nth")
    names = named.where("doc_id is null or parsed_status <> 'ready'").groupBy("id").agg(first_bad.alias("bad_name"))
    asked = asked_quotes(questions).join(places.select("id", "role", "nth").distinct().withColumn("found", F.lit(True)), ["id", "role", "nth"], "left")
    lost = ~F.coalesce("found", F.lit(False))
    quote = asked.groupBy("id").agg(
        F.bool_or((F.col("role") == "expected") & lost).alias("no_expected"),
        F.min(F.when((F.col("role") == "required") & lost, F.col("nth"))).alias("no_required"),
        F.count_if((F.col("role") == "acceptable") & lost).alias("lost_alternatives"),
        F.count_if((F.col("role") == "distractor") & lost).alias("lost_distractors"),
    )
    counts = groups.groupBy("id").agg(F.count_distinct("grp").alias("groups"), F.count_distinct("doc_id", "chunk_index").alias("passages"))
    split = places.where("spans_boundary and role <> 'distractor'").groupBy("id").agg(F.count_distinct("doc_id", "chunk_index").alias("split_passages"))
    trapped = traps.groupBy("id").agg(F.count("*").alias("distractors"))
    rows = questions.select("id").join(names, "id", "left").join(quote, "id", "left").join(counts, "id", "left").join(split, "id", "left").join(trapped, "id", "left")
    problem = (
        F.when(F.col("bad_name").isNotNull(), F.col("bad_name"))
        .when(F.col("no_expected"), F.lit("expected_quote was not found"))
        .when(F.col("no_required").isNotNull(), F.concat(F.lit("also_required quote was not found: "), (F.col("no_required") + 1).cast("string")))
    )
    numbers = ["groups", "passages", "distractors", "lost_alternatives", "lost_distractors", "split_passages"]
    fine = lambda c: F.when(problem.isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    status = lineage.cut(rows.select("id", problem.alias("problem"), *(fine(c) for c in numbers)))
    ok = status.where("problem is null").select("id")
    passages = groups.unionByName(traps.withColumn("grp", F.lit(None).cast("int"))).join(ok, "id", "left_semi")
    return passages.select("id", "grp", "doc_id", "chunk_index"), status


def find_facts(documents: DataFrame, facts: DataFrame, fold: Callable[[str], str] = fold_fact) -> DataFrame:
    """fact, doc_id of each document (doc_id, text) that has one of the fact's alternatives (apart by |) as a whole run of letters and digits.

    One automaton over all folded alternatives and one pass over each document; facts are a stated set, sent in blocks.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null")

    def scan(needles: dict[str, list]) -> DataFrame:
        sent, key = spark.sparkContext.broadcast(needles), uuid.uuid4().int

        def run(frames):
            machine = quotes.automaton(key, sent.value)
            edge = lambda c: not ("0" <= c <= "9" or "a" <= c <= "z")
            for pdf in frames:
                out = set()
                for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                    hay = fold(text)
                    for end, (size, own) in machine.iter(hay):
                        if (end == size - 1 or edge(hay[end - size])) and (end + 1 == len(hay) or edge(hay[end + 1])):
                            out |= {(f, doc) for f in own}
                yield pd.DataFrame(sorted(out), columns=["fact", "doc_id"])

        return docs.mapInPandas(run, "fact string, doc_id long")

    needles, size, parts = {}, 0, []
    for row in facts.select("fact").where("fact is not null").distinct().toLocalIterator():
        for n in {fold(a) for a in row.fact.split("|")} - {""}:
            needles.setdefault(n, []).append(row.fact)
            size += len(n)
        if size > quotes.BLOCK_CHARS:
            parts.append(lineage.cut(scan(needles)))
            needles, size = {}, 0
    out = scan(needles) if needles or not parts else parts.pop()
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def fact_problems(questions: DataFrame, documents: DataFrame, fold: Callable[[str], str] = fold_fact) -> DataFrame:
    """id, rule, fact: a fact that must be included but stands in no document the question names (any ready one, if it names none)
    and isn't recorded as lost in extraction; or one that must not be included but does stand there."""
    named = named_documents(questions, documents).where("doc_id is not null").select("id", "doc_id").distinct()
    q = questions.where("answerable")
    rule = lambda column, name: q.select("id", F.lit(name).alias("rule"), F.explode(F.array_distinct(F.col(column))).alias("fact"))
    asked = rule("must_include", "must_include").unionByName(rule("must_not_include", "must_not_include"))
    held = lineage.cut(find_facts(documents, asked, fold))
    near = asked.join(named, "id").join(held, ["fact", "doc_id"], "left_semi").select("id", "rule", "fact")
    anywhere = held.join(documents.where("parsed_status = 'ready'").select("doc_id"), "doc_id", "left_semi").select("fact").distinct()
    free = asked.join(named.select("id").distinct(), "id", "left_anti").join(anywhere, "fact", "left_semi").select("id", "rule", "fact")
    present = near.unionByName(free).distinct().withColumn("present", F.lit(True))
    lost = q.select("id", F.explode("facts_lost").alias("fact"), F.lit(True).alias("lost")).distinct()
    rows = asked.join(present, ["id", "rule", "fact"], "left").join(lost, ["id", "fact"], "left")
    there: Column = F.coalesce("present", F.lit(False))
    bad = F.when(F.col("rule") == "must_include", ~there & F.col("lost").isNull()).otherwise(there)
    return rows.where(bad).select("id", "rule", "fact")
