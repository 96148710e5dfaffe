"""Records of evaluation runs, over questions, answers and passages that events stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import runs
from lodestone.plans import fixtures as fx
from lodestone.plans.queries import query

MODEL = "model-0"
ID = "event_id"


def _chunk(n):
    return F.concat(F.lit("c"), (n % 7).cast("string"))


def _questions(e):
    i, one = F.col(ID), lambda k: _chunk(F.col(ID) + k)
    return e.select(
        i.alias("id"),
        F.concat(F.lit("question "), i.cast("string")).alias("question"),
        (i % 9 != 0).alias("expect_answer"),
        F.array(one(3), one(6)).alias("expected"),
        F.when(i % 4 != 0, F.array(F.array(one(3)), F.array(one(6)))).alias("groups"),
        F.array(F.lit("c1")).alias("distractors"),
        F.when(i % 3 == 0, F.array(F.lit("lookup_fact"))).when(i % 3 == 1, F.array(F.lit("explore_documents"), F.lit("summarize_documents"))).alias("expected_tools"),
        F.array(F.lit("purchase"), F.lit("error|view")).alias("must_not_include"),
    )


def _each(e, n, name):
    """Rows of events with numbers from 1 to n (which may be 0) as a column."""
    return e.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))))


def _answers(e):
    k = F.col(ID) + F.col("nth")
    return _each(e, F.col(ID) % 3, "nth").select(
        F.col(ID).alias("id"),
        "nth",
        F.concat(F.lit("answer "), F.col("nth").cast("string")).alias("answer"),
        (k % 4 != 0).alias("answerable"),
        (k % 5 != 0).alias("grounded"),
        (k % 6 == 0).alias("flagged"),
        F.when(k % 6 == 0, F.array(F.lit("low_confidence"), F.lit("groundedness_failed"))).otherwise(F.array().cast("array<string>")).alias("flag_reasons"),
        F.round(F.col("value") / 1000, 3).alias("confidence"),
        F.concat(F.lit("model-"), (k % 3).cast("string")).alias("model"),
    )


_NUMBERS = "select event_id as id, unnest(range(1, {} + 1)) as {} from {}"


@query(f"""with p as ({_NUMBERS.format('event_id % 4', 'rank', 'events')}), r as (select id, rank, 'c' || ((id + rank * 2) % 7) as chunk_id from p),
o as ({_NUMBERS.format('event_id % 3', 'ordinal', 'events')}), c as (select id, ordinal, 'c' || ((id + ordinal * 3) % 7) as chunk_id from o),
q as (select event_id as id, ['c' || ((event_id + 3) % 7), 'c' || ((event_id + 6) % 7)] as expected from events),
ranks as (select id, min(rank) filter (where list_contains(expected, chunk_id)) as rank, count(*) as n from r join q using (id) group by id),
places as (select id, min(ordinal) filter (where list_contains(expected, chunk_id)) as place from c join q using (id) group by id)
select event_id as id, rank is not null as found, rank::double as rank, coalesce(round_even(1.0::double / rank, 4), 0) as reciprocal, coalesce(n, 0) as passages, place is not null as cited, place::double as place, event_id % 3 <> 0 as fallback,
 event_id % 5 = 0 as refused, case when event_id % 9 = 0 then event_id % 5 = 0 end as refusal_correct, event_id % 3 * 600 as excerpts from events left join ranks on ranks.id = event_id left join places on places.id = event_id""")
def full_run_records(spark, d):
    e = fx.read(spark, d, "events")
    outcomes = e.select(F.col(ID).alias("id"), F.lit("a").alias("answer"), (F.col(ID) % 5 != 0).alias("answerable"), F.concat(F.lit("model-"), (F.col(ID) % 3).cast("string")).alias("model"))
    retrieved = _each(e, F.col(ID) % 4, "rank").select(F.col(ID).alias("id"), "rank", _chunk(F.col(ID) + F.col("rank") * 2).alias("chunk_id"))
    citations = _each(e, F.col(ID) % 3, "ordinal").select(F.col(ID).alias("id"), "ordinal", _chunk(F.col(ID) + F.col("ordinal") * 3).alias("chunk_id"), F.repeat(F.lit("x"), F.lit(1000)).alias("content"))
    r = runs.full_records(_questions(e), outcomes, retrieved, citations, MODEL)
    long = lambda c: F.col(c).cast("long")
    excerpts = F.aggregate("citations", F.lit(0).cast("long"), lambda n, c: n + F.length(c["excerpt"]))
    return r.select("id", F.col("expected_chunk_retrieved").alias("found"), F.col("rank_of_expected").cast("double").alias("rank"), F.col("reciprocal_rank").alias("reciprocal"), long("retrieved_count").alias("passages"), F.col("expected_chunk_cited").alias("cited"), F.col("cited_position_of_expected").cast("double").alias("place"), F.col("answered_by_fallback_model").alias("fallback"), "refused", "refusal_correct", excerpts.alias("excerpts"))


@query(f"""with a as (select id, nth, id + nth as k from ({_NUMBERS.format('event_id % 3', 'nth', 'events')})),
q as (select event_id as id, event_type, value, 'c' || ((event_id + 3) % 7) as e1, 'c' || ((event_id + 6) % 7) as e2, event_id % 9 <> 0 as expect_answer from events),
r as (select id, nth as run, rank, 'c' || ((k + rank * 2) % 7) as chunk_id from (select *, unnest([1, 2, 3]) as rank from a)),
best as (select id, min(rank) as rank from r join q using (id) where chunk_id in (e1, e2) group by id),
seen as (select id, count(distinct chunk_id) as chunks from r group by id),
c as (select id, nth, o, 'c' || ((id + nth * o) % 7) as chunk_id from (select *, unnest([1, 2]) as o from a)),
firsts as (select id, chunk_id, row_number() over (partition by id order by min(nth * 10 + o)) as place from c group by id, chunk_id),
cited as (select id, min(place) filter (where chunk_id in (e1, e2)) as place, bool_or(chunk_id = e1)::int + bool_or(chunk_id = e2)::int as hits, bool_or(chunk_id = 'c1') as trap from firsts join q using (id) group by id),
s as (select id, count(*) as n, bool_or(k % 4 <> 0) as answered, bool_and(k % 5 <> 0) as grounded, bool_or(k % 6 = 0) as flagged, bool_or(k % 3 <> 0) as fallback, string_agg('answer ' || nth, chr(10) || chr(10) order by nth) as text, arg_min(k % 3, nth) as model,
 arg_min(['lookup_fact', 'explore_documents', 'summarize_documents'][k % 3 + 1], nth) as tool, count(*) filter (where k % 10 = 0) as errors from a group by id),
t as (select *, coalesce(tool, 'none') as chosen, not coalesce(answered, false) as refused, event_type in ('purchase', 'error', 'view') as bad from q left join s using (id))
select t.id, coalesce(text, 'about ' || event_type) as answer, case when n > 0 then round(value / 1000, 3) end as confidence, grounded, coalesce(flagged, false) as flagged, case when flagged then 'groundedness_failed,low_confidence' else '' end as reasons,
 case when n > 0 then 'model-' || model else 'planner' end as model, coalesce(n, 0)::bigint as document_tools, coalesce(errors, 0)::bigint as errors, chosen, case t.id % 3 when 0 then chosen = 'lookup_fact' when 1 then chosen in ('explore_documents', 'summarize_documents') end as routing_ok,
 best.rank::double as rank, coalesce(round_even(1.0::double / best.rank, 4), 0) as reciprocal, coalesce(chunks, 0)::bigint as passages, place::double as place, case when t.id % 4 <> 0 then 2 else 0 end::bigint as needed, case when t.id % 4 <> 0 then coalesce(hits, 0) else 0 end::bigint as groups_cited,
 t.id % 4 <> 0 and coalesce(hits, 0) = 2 as all_cited, coalesce(trap, false) as trap, case when event_type = 'purchase' then 'purchase' when bad then 'error|view' else '' end as violations, coalesce(fallback, false) as fallback, refused, case when not expect_answer then refused and not bad end as refusal_correct
from t left join best on best.id = t.id left join seen on seen.id = t.id left join cited on cited.id = t.id""")
def agent_run_records(spark, d):
    e = fx.read(spark, d, "events")
    a, n = _answers(e), F.col("nth")
    k = F.col("id") + n
    replies = e.select(F.col(ID).alias("id"), F.concat(F.lit("about "), "event_type").alias("reply"), F.array(F.lit("planner")).alias("models"))
    tool = F.element_at(F.array(*[F.lit(t) for t in runs.DOCUMENT_TOOLS]), (k % 3 + 1).cast("int"))
    steps = a.select("id", (n + 1).alias("step"), tool.alias("tool"), (k % 10 != 0).alias("ok"), F.when(k % 10 == 0, F.lit("ERROR: none")).otherwise(F.lit("done")).alias("summary"))
    steps = steps.unionByName(e.select(F.col(ID).alias("id"), F.lit(1).alias("step"), F.lit("list_tasks").alias("tool"), F.lit(True).alias("ok"), F.lit("5 tasks").alias("summary")))
    two = a.select("id", "nth", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    citations = two.select("id", "nth", "ordinal", _chunk(F.col("id") + n * F.col("ordinal")).alias("chunk_id"))
    retrieved = a.select("id", n.alias("run"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"), k.alias("k")).select("id", "run", "rank", _chunk(F.col("k") + F.col("rank") * 2).alias("chunk_id"))
    r = runs.agent_records(_questions(e).drop("question"), replies, steps, a, citations, retrieved, MODEL)
    long = lambda c: F.col(c).cast("long")
    return r.select(
        "id", "answer", "confidence", "grounded", "flagged", F.array_join("flag_reasons", ",").alias("reasons"), "model", F.size("document_tools").cast("long").alias("document_tools"), F.size("tool_errors").cast("long").alias("errors"),
        F.col("document_tool_chosen").alias("chosen"), "routing_ok", F.col("rank_of_expected").cast("double").alias("rank"), F.col("reciprocal_rank").alias("reciprocal"), long("retrieved_count").alias("passages"), F.col("cited_position_of_expected").cast("double").alias("place"),
        long("required_groups").alias("needed"), long("required_groups_cited").alias("groups_cited"), F.col("all_required_cited").alias("all_cited"), F.col("cited_distractor").alias("trap"), F.array_join("violations", ",").alias("violations"),
        F.col("answered_by_fallback_model").alias("fallback"), "refused", "refusal_correct",
    )


@query("""with p as (select event_id as id, unnest(range(1, event_id % 4 + 1)) as rank from events), r as (select id, rank, 'c' || ((id + rank * 2) % 7) as chunk_id from p),
x as (select id, min(rank) filter (where chunk_id = 'c' || ((id + 4) % 7)) as rank from r group by id)
select event_id as id, rank::double as rank, rank is not null as retrieved, event_id % 4 = 0 as rank_unknown from events left join x on x.id = event_id""")
def rescored_runs(spark, d):
    """Ranks of passages that are expected now, from the passages that the records kept."""
    e = fx.read(spark, d, "events")
    passages = _each(e, F.col(ID) % 4, "rank").select(F.col(ID).alias("id"), "rank", _chunk(F.col(ID) + F.col("rank") * 2).alias("chunk_id"))
    r = runs.repeated_rank(e.select(F.col(ID).alias("id")), passages, e.select(F.col(ID).alias("id"), _chunk(F.col(ID) + 4).alias("chunk_id")))
    return r.withColumn("rank", F.col("rank").cast("double"))
