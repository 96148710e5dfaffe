"""Registered queries of the search scope, rendering, boards, rules, lookups, notes and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import access, answers, evaluation, ingest, notes, quotes, retrieval, tools, work
from lodestone.plans import fixtures as fx
from lodestone.plans.queries import query
from lodestone.sources import files
from lodestone.streaming import flows


@query("""with d as (select distinct source as document_id from documents where source not like '%3' and source in ('src1', 'src2', 'src3', 'src5'))
select doc_id as chunk_id from documents where source in (select document_id from d)""")
def scoped_chunks(spark, d):
    """Chunks of ready documents among those asked for."""
    c = fx.chunks(spark, d)
    docs = c.select("document_id").distinct().withColumn("parsed_status", F.when(F.col("document_id").endswith("3"), F.lit("processing")).otherwise(F.lit("ready")))
    wanted = spark.createDataFrame([("src1",), ("src2",), ("src3",), ("src5",)], "document_id string")
    return retrieval.in_scope(c, docs, wanted).select("chunk_id")


@query("""with p as (select doc_id // 3 as query_id, row_number() over (partition by doc_id // 3 order by doc_id) as n, doc_id, source,
 replace(replace(replace(source || ' | part ' || (doc_id % 4) || case when doc_id % 5 <> 0 then ' | page ' || (doc_id % 5) else '' end || chr(10) || case when text = '' then '' else text end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as body,
 text = '' as blank from documents)
select query_id, md5('<workspace_documents>' || chr(10) || string_agg('<untrusted_document id="' || n || '" source="' || source || '">' || chr(10) || case when blank then rtrim(body, chr(10)) else body end || chr(10) || '</untrusted_document>', chr(10) || chr(10) order by n) || chr(10) || '</workspace_documents>') as rendered from p group by 1""")
def rendered_passages(spark, d):
    i = F.col("doc_id")
    docs = fx.read(spark, d, "documents")
    p = docs.select(F.floor(i / 3).alias("query_id"), i.alias("position"), F.col("source").alias("file_name"), F.concat(F.lit("part "), (i % 4).cast("string")).alias("section"), F.when(i % 5 != 0, i % 5).alias("page"), F.lit("text").alias("kind"), F.lit("c").alias("context"), F.coalesce("text", F.lit("")).alias("content"), F.array().cast("array<string>").alias("injection_reasons"))
    return answers.render_passages(p).select("query_id", F.md5("rendered").alias("rendered"))


@query("""select event_id as answer_id, sha256('run:' || event_id) as run_id, 'good' as grade_outcome, 1 as retry_count, 2 as citations, 'c' || (event_id % 7) as first_cited from events""")
def recorded_answers(spark, d):
    """Runs, answers, citations and audit rows of answered questions, joined again."""
    e = fx.read(spark, d, "events").select(F.col("event_id").alias("answer_id"))
    q = e.select("answer_id", F.lit(1).alias("workspace_id"), F.lit(2).alias("user_id"), F.lit("q").alias("question"), F.lit("lookup").alias("profile"), F.lit("m").alias("model"), F.lit(10).alias("latency_ms"))
    grade = F.when(F.col("attempt") == 2, F.lit("good")).otherwise(F.lit("weak"))
    a = e.select("answer_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).select("answer_id", "attempt", F.lit("q").alias("query"), grade.alias("grade"), F.lit("n").alias("note"), F.lit(0.5).alias("top_score"), F.lit("[]").alias("candidates"))
    cited = F.array(F.concat(F.lit("c"), (F.col("answer_id") % 7).cast("string")), F.lit("z"))
    p = a.select("answer_id", "attempt", F.lit(1).alias("position"), F.lit("z").alias("chunk_id"), F.lit(0.5).alias("rerank_score"), F.lit(0.03).alias("fused_score"))
    o = e.select("answer_id", F.lit("x").alias("answer"), cited.alias("cited"), F.lit(True).alias("grounded"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("flag_reasons"), F.lit(False).alias("flagged"), F.array().cast("array<string>").alias("redacted"))
    out = answers.recorded(q, a, p, o, F.lit("2024-01-01").cast("timestamp"))
    n = out["citations"].groupBy("answer_id").agg(F.count("*").alias("citations"), F.min_by("chunk_id", "ordinal").alias("first_cited"))
    runs = out["runs"].select("run_id", "grade_outcome", "retry_count")
    rows = out["answers"].join(runs, F.col("retrieval_run_id") == F.col("run_id")).join(n, "answer_id").join(out["audit"].select(F.col("target_id").alias("answer_id")), "answer_id")
    return rows.select("answer_id", "run_id", "grade_outcome", F.col("retry_count").cast("int").alias("retry_count"), F.col("citations").cast("int").alias("citations"), "first_cited")


@query("""with b as (select l_orderkey as page, l_linenumber as line, l_partkey, l_quantity * 2 as x0, l_quantity * 2 + l_suppkey % 20 as x1, l_extendedprice / 100 as y0 from lineitem),
s as (select page, count(*) as n, count(*) filter (where x0 < 46 and x1 > 54) as across, count(*) filter (where x1 <= 50) as l, count(*) filter (where x1 > 50 and x0 >= 50) as r from b group by 1),
p as (select b.*, n >= 8 and across = 0 and least(l, r) >= greatest(3.0, n * 0.25) as two from b join s using (page))
select page, line, l_partkey, row_number() over (partition by page order by case when two and x1 > 50 then 1 else 0 end, round_even(y0, 1), x0, line, l_partkey) as position from p where not two or x1 <= 50 or x0 >= 50""")
def page_reading_order(spark, d):
    li = fx.read(spark, d, "lineitem")
    b = li.select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), "l_partkey", F.lit(100.0).alias("page_width"), (F.col("l_quantity") * 2).alias("x0"), (F.col("l_quantity") * 2 + F.col("l_suppkey") % 20).alias("x1"), (F.col("l_extendedprice") / 100).alias("y0"))
    return files.reading_order(b, ["line", "l_partkey"]).select("page", "line", "l_partkey", F.col("position").cast("long").alias("position"))


@query("""with p as (select p_partkey, case when p_partkey % 3 = 0 then p_name || '.' when p_partkey % 5 = 0 then '- ' || p_name when p_partkey % 7 = 0 then '2.1 ' || p_name || '.' else p_name end as t, 8 + p_size % 8 as size, p_partkey % 2 = 0 as bold from part)
select p_partkey from p where length(trim(t)) between 1 and 130 and (regexp_matches(trim(t), '^\\s*\\d+(?:\\.\\d+)*\\.?\\s+\\S') or (not regexp_matches(trim(t), '(?i)^\\s*(?:[•▪◦·\\-*]|\\(?[a-z0-9]{1,3}[.)])\\s+') and not regexp_matches(trim(t), '[.!?;:]\\s*$')))
 and (size >= 10 * 1.12 or (bold and size >= 10 * 0.97 and length(trim(t)) <= 90))""")
def line_headings(spark, d):
    i, n = F.col("p_partkey"), F.col("p_name")
    t = F.when(i % 3 == 0, F.concat(n, F.lit("."))).when(i % 5 == 0, F.concat(F.lit("- "), n)).when(i % 7 == 0, F.concat(F.lit("2.1 "), n, F.lit("."))).otherwise(n)
    p = fx.read(spark, d, "part").select("p_partkey", t.alias("text"), (8 + F.col("p_size") % 8).cast("double").alias("size"), (i % 2 == 0).alias("bold"))
    return p.where(files.is_heading(F.lit(10.0))).select("p_partkey")


@query(f"with {fx.TASKS} select workspace_id, coalesce(sprint_id, -1) as sprint_id, count(*) filter (where status <> 'done') as open, count(*) filter (where status = 'done') as done, count(*) as total from tasks group by 1, 2")
def task_counts(spark, d):
    t = fx.tasks(spark, d).withColumn("sprint_id", F.coalesce("sprint_id", F.lit(-1).cast("long")))
    return work.counts(t, ["workspace_id", "sprint_id"])


_BOARD = f"""with {fx.TASKS}, b as (select *, task_id % 100 as position, date '2024-01-01' + cast(task_id % 50 as int) as updated_at from tasks)"""


@query(f"""{_BOARD} select task_id, row_number() over (partition by workspace_id, parent_task_id order by case when parent_task_id is null then list_position(['urgent', 'high', 'medium', 'low', 'none'], priority) end, position, task_id) as place,
 row_number() over (partition by workspace_id, parent_task_id order by case when parent_task_id is null then coalesce(strftime(due_date, '%Y-%m-%d'), '9999-12-31') end, position, task_id) as by_due,
 row_number() over (partition by workspace_id, parent_task_id order by case when parent_task_id is null then -epoch(updated_at) end, position, task_id) as by_updated from b""", long=("place", "by_due", "by_updated"))
def task_board(spark, d):
    t = fx.tasks(spark, d).select("*", (F.col("task_id") % 100).alias("position"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("task_id") % 50).cast("int")).alias("updated_at"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    by = lambda s, c: work.board(t, s).select("task_id", F.col("place").alias(c))
    return by("priority", "place").join(by("due", "by_due"), "task_id").join(by("updated", "by_updated"), "task_id")


@query(f"""with {fx.TASKS}, o as (select task_id, workspace_id, row_number() over (partition by workspace_id order by due_date nulls last, list_position(['urgent', 'high', 'medium', 'low', 'none'], priority), title, task_id) as position, count(*) over (partition by workspace_id) as n from tasks where status <> 'done')
select task_id, workspace_id, position, greatest(n - 20, 0) as more from o where position <= 20""", long=("position",))
def task_listing(spark, d):
    return work.listing(work.scope(fx.tasks(spark, d), "all", "open"), 20).select("task_id", "workspace_id", "position", "more")


@query("""select sum(case when doc_id % 4 = 0 then n_chars else 0 end)::bigint as passages, count(*) filter (where doc_id % 4 = 0) as ready, count(*) filter (where doc_id % 4 = 1) as failed, true as in_flight from documents""")
def searchable_passages(spark, d):
    i = F.col("doc_id") % 4
    status = F.when(i == 0, F.lit("ready")).when(i == 1, F.lit("failed")).otherwise(F.lit("processing"))
    return work.searchable(fx.read(spark, d, "documents").select(status.alias("parsed_status"), F.col("n_chars").alias("chunk_count")))


@query(f"""with {fx.MEMBERS}, n as (select event_id as note_id, cast(event_id % 5 as int) as workspace_id, user_id as created_by from events), m as (select * from members where user_id = 10),
i as (select workspace_id from m), a as (select workspace_id from m where auth_role = 'Admin')
select note_id, 'delete' as action from n where workspace_id in (select * from a) or (created_by = 10 and workspace_id in (select * from i)) union all select note_id, 'update' from n where workspace_id in (select * from i)
union all select note_id, 'sprint' from n where workspace_id in (select * from a) union all select note_id, 'upload' from n where workspace_id in (select * from a) and created_by = 10
union all select note_id, 'leave' from n where workspace_id in (select * from a) or (created_by = 10 and workspace_id in (select * from i))""")
def writable_rows(spark, d):
    m = fx.members(spark, d)
    n = fx.read(spark, d, "events").select(F.col("event_id").alias("note_id"), (F.col("event_id") % 5).cast("int").alias("workspace_id"), F.col("user_id").alias("created_by"), F.col("user_id").alias("uploaded_by"), "user_id")
    asked = {"delete": ("notes", "delete"), "update": ("notes", "update"), "sprint": ("sprints", "update"), "upload": ("documents", "insert"), "leave": ("workspace_members", "delete")}
    out = None
    for name, (table, action) in asked.items():
        part = access.writable(table, action, n, m, 10).select("note_id", F.lit(name).alias("action"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""select 'asia' as given, r_regionkey as workspace_id, r_name as name from region where lower(r_name) like '%asia%' union all select '2', r_regionkey, r_name from region where r_regionkey = 2""")
def found_workspaces(spark, d):
    """By a part of a name, by an id, by a part that several names have, and by one that none has."""
    w = fx.read(spark, d, "region").select(F.col("r_regionkey").alias("workspace_id"), F.col("r_name").alias("name"))
    out = None
    for given in ("asia", "2", "a", "zzz"):
        part = access.find_workspace(w, given).withColumn("given", F.lit(given))
        out = part if out is None else out.unionByName(part)
    return out


@query("""select doc_id, text[:300] as excerpt, case when doc_id % 4 = 0 then 'The workspace documents don''t cover that.' when doc_id % 4 = 1 then 'Here is what the documents say, but the groundedness check failed, so treat it with care.'
 when doc_id % 4 = 2 then 'Here is what the documents say. It is flagged for review, so treat it with care.' else 'Here is what the workspace documents say.' end as reply, substring(text, doc_id % 9 + 1, 7) as part,
 doc_id % 2 = 0 as object, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || '}') as key from documents""")
def text_pieces(spark, d):
    i = F.col("doc_id")
    return fx.read(spark, d, "documents").select(
        "doc_id",
        text.excerpt("text", 300).alias("excerpt"),
        text.answer_reply(i % 4 != 0, i % 4 != 1, i % 4 == 2).alias("reply"),
        text.code_points("text", (i % 9).cast("int"), (i % 9 + 7).cast("int")).alias("part"),
        text.is_json_object(F.when(i % 2 == 0, F.lit('{"a": 1}')).when(i % 3 == 0, F.lit("[1]")).otherwise(F.lit("x"))).alias("object"),
        text.cache_key(["n_chars", "lang"]).alias("key"),
    )


@query(f"""with {fx.RECORDS}, r as (select id, list_distinct(cited) as cited, list_filter([list_position(cited, expected[1]), list_position(cited, expected[2])], lambda x: x > 0) as p, expected from records)
select id, list_min(p)::double as rank, coalesce(round_even(1.0::double / list_min(p), 4), 0) as reciprocal, len(list_intersect(cited, expected)) > 0 as group_cited, list_contains(cited, 'c1') as trap from r""")
def run_scores(spark, d):
    r = fx.records(spark, d)
    cited = evaluation.cited_union(F.array("cited", "cited"))
    s, g = evaluation.retrieval_score(cited, F.col("expected")), evaluation.group_score(cited, F.array("expected"), F.array(F.lit("c1")))
    return r.select("id", s["rank_of_expected"].cast("double").alias("rank"), s["reciprocal_rank"].alias("reciprocal"), g["all_required_cited"].alias("group_cited"), g["cited_distractor"].alias("trap"))


@query(f"with {fx.RECORDS} select id, kind as type, refused, refused <> answerable as refusal_correct, grounded, flagged from records where not coalesce(gate, answerable)")
def behaviour_cases(spark, d):
    return evaluation.behaviour_cases(fx.records(spark, d))


@query(f"""with {fx.RECORDS}, g as (select * from records where coalesce(gate, answerable)), f as (select * from g order by id limit 15), l as (select list_sort(list(latency_ms)) as v, count(*) as n from records),
p as (select v[cast(round_even(0.5 * (n - 1), 0) as bigint) + 1] / 1000.0::double as s from l), h as (select count(*) filter (where case when citation_acceptable = false then false else cited_expected or coalesce(citation_acceptable, false) end) as hits, count(*) as n from f),
u as (select count(*) filter (where not grounded and flagged) as a, count(*) filter (where not grounded) as b from g)
select 'first questions cite the right passage' as target, hits::double as value, 12.0::double as goal, case when n = 15 and hits >= 12 then 'pass' else 'not comparable' end as verdict from h union all
select 'latency p50 in seconds', s, 8.0, case when s < 8 then 'pass' else 'fail' end from p union all select 'ungrounded answers are flagged', a, b, case when b = 0 then 'not exercised' when a >= b then 'pass' else 'fail' end from u""")
def report_targets(spark, d):
    return evaluation.report_targets(fx.records(spark, d))


@query("""with q as (select item_id as id, item_id % 5 <> 0 as answerable, 'src' || (item_id % 30) as document, case when item_id % 7 <> 0 then text end as quote from benchmark),
f as (select distinct item_id as id from benchmark b join documents d on contains(trim(regexp_replace(lower(d.text), '[\\s|]+', ' ', 'g')), trim(regexp_replace(lower(b.text), '[\\s|]+', ' ', 'g'))))
select id, 'an answerable question has a quote' as rule from q where answerable and quote is null union all select id, 'the document exists' from q where document not in (select source from documents)
union all select id, 'the quote is found' from q where answerable and quote is not null and id not in (select id from f)""")
def golden_problems(spark, d):
    i, docs = F.col("item_id"), fx.read(spark, d, "documents")
    b = fx.read(spark, d, "benchmark")
    q = b.select(i.alias("id"), F.lit("fact").alias("kind"), (i % 5 != 0).alias("answerable"), F.concat(F.lit("src"), (i % 30).cast("string")).alias("document"), F.when(i % 7 != 0, F.col("text")).alias("expected_quote"))
    found = quotes.find_quotes(docs, q.select(F.col("id").alias("quote_id"), F.col("expected_quote").alias("quote")))
    return evaluation.golden_problems(q, found, docs.select(F.col("source").alias("file_name")))


@query("""select conv_id, string_agg(text, chr(10) order by turn) as body from conversations where text <> '' group by 1""")
def note_texts(spark, d):
    """Conversations as notes: a paragraph for each turn."""
    c = fx.read(spark, d, "conversations").where("text <> ''")
    leaf = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    block = F.struct("turn", F.struct(F.lit("paragraph").alias("type"), F.array(leaf).alias("content")).alias("b"))
    tree = F.struct(F.lit("doc").alias("type"), F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("content"))
    n = c.groupBy("conv_id").agg(F.to_json(tree).alias("content"))
    return n.where(notes.problem("content").isNull()).select("conv_id", notes.plain_text("content").alias("body"))


@query()
def quota_schedule(spark, d):
    e = fx.read(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_id") % 60 + 1).alias("count"), F.col("event_id").alias("batch_id"))
    return flows.quota_schedule(e, 100, 20)


_TODAY = "1998-01-01"
_LINE = f"""'- id=' || task_id || ' | ' || title || ' | status=' || status || ' | priority=' || priority || ' | ' ||
 case when due_date is null then 'no due date' else 'due ' || strftime(due_date, '%Y-%m-%d') || ' (' || case when due_date < date '{_TODAY}' then 'OVERDUE by ' || (date '{_TODAY}' - due_date) || case when date '{_TODAY}' - due_date = 1 then ' day' else ' days' end
 when due_date = date '{_TODAY}' then 'today' else 'in ' || (due_date - date '{_TODAY}') || case when due_date - date '{_TODAY}' = 1 then ' day' else ' days' end end || ')' end
 || ' | assignee=' || coalesce(full_name || ' <' || email || '>', 'unassigned') || case when parent_task_id is not null then ' | subtask of ' || parent_task_id else '' end"""
_LINES = f"""{fx.TASKS}, lined as (select t.*, {_LINE} as line from (select tasks.*, members.full_name, members.email from tasks left join members on assignee_id = user_id) t)"""


def _requests(spark, d):
    """Every workspace's lists of each kind, asked by user 10."""
    who, state = F.array(F.lit("all"), F.lit("mine"), F.lit("unassigned")), F.array(F.lit("open"), F.lit("any"), F.lit("done"))
    w = fx.read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("workspace_id"), F.posexplode(who).alias("i", "who"))
    w = w.select("*", F.posexplode(state).alias("j", "status"))
    return w.select((F.col("workspace_id") * 100 + F.col("i") * 10 + F.col("j")).alias("request_id"), "workspace_id", F.lit(10).alias("user_id"), "who", "status", F.lit(25).alias("limit"))


@query(f"""with {_LINES}, q as (select r_regionkey * 100 + i * 10 + j as request_id, r_regionkey as workspace_id, ['all', 'mine', 'unassigned'][i + 1] as who, ['open', 'any', 'done'][j + 1] as asked from region, range(3) a(i), range(3) b(j)),
h as (select request_id, line, row_number() over (partition by request_id order by due_date nulls last, list_position(['urgent', 'high', 'medium', 'low', 'none'], priority), title, task_id) as n from q join lined using (workspace_id)
 where (who = 'all' or (who = 'mine' and assignee_id = 10) or (who = 'unassigned' and assignee_id is null)) and (asked = 'any' or (asked = 'open' and status <> 'done') or asked = status)),
g as (select request_id, count(*) as total, string_agg(line, chr(10) order by n) filter (where n <= 25) as lines from h group by 1),
w as (select q.*, total, lines, case who when 'mine' then 'assigned to you' when 'unassigned' then 'unassigned' else 'in the workspace' end as whose from q left join g using (request_id))
select request_id, case when total is null then 'No ' || asked || ' tasks ' || whose || '.' else total || ' ' || asked || ' task(s) ' || whose || ', soonest due first:' || chr(10) || lines || case when total > 25 then chr(10) || '(' || (total - 25) || ' more not shown)' else '' end end as reply from w""")
def tool_task_lists(spark, d):
    return tools.list_tasks(_requests(spark, d), tools.with_assignee(fx.tasks(spark, d), fx.members(spark, d)), F.lit(_TODAY).cast("date"))


@query(f"""with {_LINES}, s as (select parent_task_id as asked, count(*) as n, count(*) filter (where status = 'done') as done, string_agg('  ' || line, chr(10) order by task_id) as lines from lined where parent_task_id is not null group by 1)
select task_id as request_id, md5(line || chr(10) || 'Description: (none)' || coalesce(chr(10) || 'Subtasks (' || done || '/' || n || ' done):' || chr(10) || lines, '')) as reply from lined left join s on task_id = asked""")
def tool_task_details(spark, d):
    """The detail of every task."""
    t = tools.with_assignee(fx.tasks(spark, d), fx.members(spark, d)).withColumn("description", F.lit(""))
    asked = t.select(F.col("task_id").alias("request_id"), "workspace_id", "task_id")
    return tools.get_task(asked, t, F.lit(_TODAY).cast("date")).select("request_id", F.md5("reply").alias("reply"))


@query(f"""with {fx.MEMBERS} select workspace_id as request_id, md5(string_agg('- ' || full_name || ' <' || email || '> ' || auth_role || ' | team role: ' || case when user_id % 3 = 0 then 'Engineer' else 'not set' end || case when user_id = 10 then ' (this is the person asking)' else '' end, chr(10) order by user_id)) as reply from members group by 1""")
def tool_members(spark, d):
    m = fx.members(spark, d).withColumn("team_role", F.when(F.col("user_id") % 3 == 0, F.lit(" Engineer ")))
    asked = m.select("workspace_id").distinct().select(F.col("workspace_id").alias("request_id"), "workspace_id", F.lit(10).alias("user_id"))
    return tools.list_members(asked, m).select("request_id", F.md5("reply").alias("reply"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""with r as (select event_id as request_id, event_id // 8 as turn_id, case when event_id % 6 = 0 then {_quoted(tools.NOT_QUOTED)} end as early,
 case when event_id % 17 = 0 then 'REFUSED: due_date ''soon'' is not YYYY-MM-DD.' when event_id % 19 = 0 then 'REFUSED: no@where is not a member of this workspace. Use list_members.' when event_id % 23 = 0 then 'REFUSED: no parent task -1 in this workspace.' end as late from events),
b as (select *, coalesce(sum(case when early is null and late is null then 1 else 0 end) over (partition by turn_id order by request_id rows between unbounded preceding and 1 preceding), 0) as n from r)
select request_id, coalesce(early, case when n >= 5 then {_quoted(tools.TOO_MANY)} end, late, 'Proposed task ' || sha256('action:' || request_id) || ': ''Check ' || request_id || '''. It is NOT created yet: it waits in the Tasks page for an Admin to approve or reject.') as reply from b""")
def tool_proposals(spark, d):
    i = F.col("event_id")
    flag = lambda n, yes, no=None: F.when(i % n == 0, F.lit(yes)).otherwise(F.lit(no))
    r = fx.read(spark, d, "events").select(
        i.alias("request_id"), F.lit(1).alias("workspace_id"), "user_id", F.floor(i / 8).alias("turn_id"), F.lit("Could you add a task for this?").alias("message"), F.lit(False).alias("tainted"),
        F.concat(F.lit(" Check "), i.cast("string")).alias("title"), F.lit("").alias("description"), F.lit("none").alias("priority"), flag(17, "soon", "2024-01-05").alias("due_date"), flag(19, "no@where").alias("assignee_email"),
        flag(23, -1).cast("long").alias("parent_task_id"), F.lit("asked for").alias("reasoning"), flag(6, "a task", "add a task").alias("quote"),
    )
    return tools.propose(r, fx.members(spark, d), fx.tasks(spark, d), F.lit("2024-01-01").cast("timestamp"))["replies"]


@query(f"""select doc_id, case when doc_id % 13 = 0 then 'too large' when blank and doc_id % 2 = 1 then {_quoted(ingest.SCANNED)} when blank then {_quoted(ingest.NO_TEXT)} when doc_id % 17 = 0 then {_quoted(ingest.EMBEDDING["daily"])} end as parse_error,
 case when doc_id % 13 = 0 or blank or doc_id % 17 = 0 then 'failed' else 'ready' end as parsed_status, doc_id % 13 <> 0 and not blank as chunks from (select doc_id, coalesce(trim(text), '') = '' as blank from documents)""")
def ingest_states(spark, d):
    """States of all documents after the ingest job, and whether passages of them are kept."""
    i = F.col("doc_id")
    part = F.struct(F.lit("paragraph").alias("kind"), F.col("text"), F.lit(0).alias("level"), F.lit(1).alias("page"))
    problem = F.when(i % 13 == 0, F.lit("too large")).alias("problem")
    docs = fx.read(spark, d, "documents").select("doc_id", F.lit(1).alias("workspace_id"), "source", F.array(part).alias("elements"), problem, (i % 2).alias("pages_without_text"))
    failed = docs.where(i % 17 == 0).select("doc_id", F.lit("daily").alias("kind"))
    states = ingest.ingest(docs, F.lit("2024-01-01").cast("timestamp"), failed)["documents"]
    return states.select("doc_id", "parse_error", "parsed_status", (F.col("chunk_count") > 0).alias("chunks"))
