"""Further registered queries: labels, rules, nested reads, transitions, evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import stats, text
from lodestone.operators import access, answers, evaluation, quotes, work
from lodestone.plans import fixtures as fx
from lodestone.plans.queries import query
from lodestone.sources import files
from lodestone.streaming import flows

NOW = "2024-02-01 00:00:00"


@query("""select event_id, 'ord ' || event_id as a, case event_id % 4 when 0 then 'Queued' when 1 then 'Embedding ' || (event_id % 7) || '/5' else 'Reading file' end as stage,
 case event_id % 3 when 0 then 'Confidence fell below the review threshold.' when 1 then 'other reason' else 'The answer cited no passage, so it cannot be traced.' end as reason, case when event_id % 2 = 0 then 1.5 * (event_id % 10) end as retry,
 event_id % 2 = 0 as quota, case when event_id % 5 <> 0 then strftime(date '2024-01-01' + cast(event_id % 28 as int), '%Y-%m-%d') end as due from events""")
def label_functions(spark, d):
    i = F.col("event_id")
    status = F.when(i % 4 == 0, F.lit("pending")).otherwise(F.lit("processing"))
    stage = F.when(i % 4 == 1, F.lit("embedding")).otherwise(F.lit("parsing"))
    reason = F.when(i % 3 == 0, F.lit("low_confidence")).when(i % 3 == 1, F.lit("other_reason")).otherwise(F.lit("no_citations"))
    message = F.when(i % 2 == 0, F.concat(F.lit("429: Please retry in "), F.format_string("%.1f", 1.5 * (i % 10)), F.lit("s"))).otherwise(F.lit("quota"))
    day = F.when(i % 5 == 0, F.lit("2024-1-01")).otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 28).cast("int")), "yyyy-MM-dd"))
    return fx.read(spark, d, "events").select(
        "event_id",
        text.normalise_name(F.concat(F.lit("Ord__-"), i.cast("string"))).alias("a"),
        text.stage_label(status, stage, i % 7, F.lit(5)).alias("stage"),
        text.flag_reason_text(reason).alias("reason"),
        text.retry_after(message).alias("retry"),
        text.is_quota_error(message).alias("quota"),
        F.date_format(text.due_date(day), "yyyy-MM-dd").alias("due"),
    )


@query("""select c_custkey, 'report_' || c_custkey || '.pdf' as name, case c_custkey % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'pdf' end as kind, 'model-' || (c_custkey % 5) as model from customer""")
def file_names(spark, d):
    i = F.col("c_custkey")
    name = F.concat(F.lit("C:\\up/report??!"), i.cast("string"), F.lit(".pdf. "))
    shown = F.when(i % 4 == 0, F.lit("a.PDF")).when(i % 4 == 1, F.lit("b.docx")).otherwise(F.lit("noext"))
    mime = F.when(i % 4 == 2, F.lit("application/pdf")).otherwise(F.lit("text/plain"))
    return fx.read(spark, d, "customer").select("c_custkey", text.safe_filename(name).alias("name"), files.detect_type(shown, mime).alias("kind"), text.model_label(F.concat(F.lit("org/model-"), (i % 5).cast("string"), F.lit("-20240101-v1:0"))).alias("model"))


@query("""select event_id, case event_id % 4 when 0 then (value + value * 2) / 2 when 1 then value + 1024 when 2 then value * 2 - 1024 else 7.0 end as position from events""")
def list_positions(spark, d):
    i, v = F.col("event_id") % 4, F.col("value")
    before, after = F.when(i.isin(0, 1), v), F.when(i.isin(0, 2), v * 2)
    return fx.read(spark, d, "events").select("event_id", stats.position_between(before, after, F.lit(7.0)).alias("position"))


@query("""select event_id, case event_id % 3 when 0 then 1 when 1 then 2 else 3 end as n, case event_id % 3 when 0 then 'none' when 1 then 'x [' || event_id % 900 || '] y' else 'x [1]. y [2] z[4444]' end as text from events""")
def answer_segments(spark, d):
    i = F.col("event_id")
    a = F.when(i % 3 == 0, F.lit("none")).when(i % 3 == 1, F.concat(F.lit("x ["), (i % 900).cast("string"), F.lit("] y"))).otherwise(F.lit("x [1]. y [2] z[4444]"))
    e = fx.read(spark, d, "events").withColumn("a", a)
    s = e.withColumn("s", answers.segments(F.col("a")))
    return s.select("event_id", (F.size(F.filter("s", lambda x: x["marker"].isNull()))).alias("n"), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))


@query("""select doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+([A-Z0-9])', '\\1\x01\\2', 'g'), '\x01'), lambda x: x <> '')) as n from documents""")
def sentence_counts(spark, d):
    docs = fx.read(spark, d, "documents")
    return docs.select("doc_id", F.size(F.filter(text.sentences("text"), lambda x: x != "")).cast("long").alias("n"))


@query(f"with {fx.TASKS} select task_id from tasks where sprint_id is null and status <> 'done'")
def backlog(spark, d):
    return work.sprint_scope(work.scope(fx.tasks(spark, d), "all", "open"), "backlog").select("task_id")


@query(f"with {fx.TASKS} select task_id, title from tasks where assignee_id = 15")
def my_tasks(spark, d):
    return work.scope(fx.tasks(spark, d), "mine", "any", 15).select("task_id", "title")


@query(f"with {fx.TASKS} select task_id, case when sprint_id in (2, 5) then null else sprint_id end::double as sprint_id from tasks")
def deleted_sprints(spark, d):
    gone = spark.createDataFrame([(2,), (5,)], "sprint_id long")
    return work.delete_sprint(fx.tasks(spark, d), gone).select("task_id", F.col("sprint_id").cast("double").alias("sprint_id"))


@query(f"""with {fx.TASKS} select task_id, case when task_id % 2 = 0 and status <> 'done' then '{NOW}' when task_id % 2 <> 0 then 'open' else 'kept' end as completed from tasks""")
def status_touch(spark, d):
    t = fx.tasks(spark, d)
    new = F.when(F.col("task_id") % 2 == 0, F.lit("done")).otherwise(F.lit("todo"))
    kept = F.when(F.col("status") == "done", F.lit("2020-01-01").cast("timestamp"))
    at = work.touch(F.col("status"), new, kept, F.lit(NOW).cast("timestamp"))
    shown = F.when(at.isNull(), F.lit("open")).when(at == F.lit("2020-01-01").cast("timestamp"), F.lit("kept")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return t.select("task_id", shown.alias("completed"))


@query(f"with {fx.MEMBERS} select workspace_id, user_id % 100 as slot, count(*) as n from members where auth_role = 'Admin' group by 1, 2 having count(*) > 1")
def unique_rules(spark, d):
    found = access.duplicates(fx.members(spark, d), [F.col("workspace_id"), F.col("user_id") % 100], F.col("auth_role") == "Admin")
    return found.select(F.col("k0").alias("workspace_id"), F.col("k1").alias("slot"), "n")


@query(f"with {fx.MEMBERS}, m as (select user_id % 50 as workspace_id, auth_role from members) select workspace_id from m group by 1 having count(*) filter (where auth_role = 'Admin') = 0")
def workspaces_without_admin(spark, d):
    m = fx.members(spark, d).select((F.col("user_id") % 50).alias("workspace_id"), "auth_role")
    return access.workspaces_without_admin(m)


@query(f"with {fx.MEMBERS}, {fx.ANSWERS} select answer_id * 10 as citation_id from answers where workspace_id in (select workspace_id from members where user_id = 3)")
def visible_citations(spark, d):
    a = fx.answers(spark, d)
    c = a.select((F.col("answer_id") * 10).alias("citation_id"), "answer_id")
    return access.readable_children(c, a.select("answer_id", "workspace_id"), "answer_id", fx.members(spark, d), 3).select("citation_id")


@query(f"with {fx.MEMBERS} select o_orderkey from orders where o_orderkey % 5 in (select workspace_id from members where user_id = 4)")
def visible_objects(spark, d):
    o = fx.read(spark, d, "orders").select("o_orderkey", F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit("/doc/"), F.col("o_orderkey").cast("string")).alias("name"))
    return access.readable_objects(o, fx.members(spark, d), 4).select("o_orderkey")


@query("""select l_orderkey as answer_id, string_agg(cast(l_partkey as varchar) || ':' || p_brand, ',' order by l_linenumber, l_partkey, p_brand) as cited from lineitem join part on p_partkey = l_partkey group by 1""")
def answers_with_citations(spark, d):
    """Answers with nested citations in the order of their ordinals (orders, line items and parts stand in)."""
    line, part = fx.read(spark, d, "lineitem"), fx.read(spark, d, "part")
    c = line.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("chunk_id"))
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"))
    docs = part.select(F.col("p_brand").alias("document_id"), F.col("p_brand").alias("file_name")).distinct()
    out = work.answer_with_citations(c.select("answer_id").distinct(), c, chunks, docs)
    return out.select("answer_id", F.array_join(F.transform("citations", lambda x: F.concat(x["chunk_id"].cast("string"), F.lit(":"), x["file_name"])), ",").alias("cited"))


@query("""with d as (select distinct source as f, trim(regexp_replace(lower(source), '[\\s_\\-]+', ' ', 'g')) as norm from documents),
n as (select distinct unnest([f, upper(f), substr(f, 2), substr(f, 3), f || '9', f || '-x', 'no']) as name from d), w as (select name, trim(regexp_replace(lower(name), '[\\s_\\-]+', ' ', 'g')) as wanted from n),
e as (select name, min(f) as f from n join d on f = name group by 1), s as (select name, min(f) as f from w join d on norm = wanted group by 1 having count(*) = 1), p as (select name, min(f) as f from w join d on contains(norm, wanted) group by 1 having count(*) = 1)
select name, coalesce(e.f, s.f, p.f) as doc_id from n left join e using (name) left join s using (name) left join p using (name)""")
def document_names(spark, d):
    """Sources as file names, asked for exactly, in capitals, by a part that one or several have, and wrongly."""
    docs = fx.read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("source").alias("file_name")).distinct()
    f = F.col("file_name")
    asked = F.array(f, F.upper(f), F.substr(f, F.lit(2)), F.substr(f, F.lit(3)), F.concat(f, F.lit("9")), F.concat(f, F.lit("-x")), F.lit("no"))
    return quotes.find_document(docs.select(F.explode(asked).alias("name")).distinct(), docs)


@query("""select 'k' || (event_id % 3) as type_label, 't' || (event_id % 4) as tool, count(*) as n from events group by 1, 2""")
def tools_by_type(spark, d):
    i = F.col("event_id")
    r = fx.read(spark, d, "events").select(F.concat(F.lit("k"), (i % 3).cast("string")).alias("type_label"), F.array(F.concat(F.lit("t"), (i % 4).cast("string"))).alias("tools"))
    return evaluation.tools_by_type(r)


@query(f"""with {fx.RECORDS}, g as (select len(list_intersect(cited, expected)) > 0 as a, list_contains(cited, 'c1') as b from records) select sum(a::int + b::int)::bigint as groups_cited, 2 * count(*) as groups, count(*) filter (where a and b) as all_cited, count(*) as n from g""")
def required_groups(spark, d):
    r = fx.records(spark, d).select("cited", F.array(F.col("expected"), F.array(F.lit("c1"))).alias("groups"))
    return evaluation.required_groups(r)


@query(f"""with {fx.RECORDS}, g as (select * from records where coalesce(gate, answerable)), m as (select count(*) filter (where not rank_unknown and rank <= 5)::double / count(*) filter (where not rank_unknown) as r, max(latency_ms) / 1000.0 as s from g)
select 'recall_at_5' as target, round(r, 4) as value, 0.9::double as goal, case when round_even(r, 4) >= 0.9 then 'pass' else 'fail' end as verdict from m union all select 'latency_s', s, 8.0, case when s <= 8 then 'pass' else 'fail' end from m""")
def target_verdicts(spark, d):
    r = fx.records(spark, d)
    row = evaluation.retrieval_metrics(r).crossJoin(r.where(evaluation.is_gate()).agg((F.max("latency_ms") / 1000).alias("s")))  # single rows
    out = evaluation.targets({"recall_at_5": (F.col("recall_at_5_rate"), F.lit(0.9), "min"), "latency_s": (F.col("s"), F.lit(8.0), "max")}, row)
    return out.withColumn("value", F.round("value", 4))


@query(f"""with {fx.MEMBERS}, {fx.ANSWERS}, {fx.REVIEWS} select answer_id, 'corrected' as decision from answers where answer_id % 4 = 1 and answer_id not in (select review_target_id from reviews) and workspace_id in (select workspace_id from members where user_id = 30 and auth_role = 'Admin')""")
def new_reviews(spark, d):
    a = fx.answers(spark, d)
    decisions = a.where("answer_id % 4 = 1").select("answer_id", F.lit("corrected").alias("decision"), F.lit(None).cast("string").alias("notes"), F.lit("fix").alias("correction"))
    out = work.review(a, fx.reviews(spark, d), decisions, 30, fx.members(spark, d), F.lit(NOW).cast("timestamp"))
    return out["reviews"].select(F.col("review_target_id").alias("answer_id"), "decision")


@query(f"""with {fx.MEMBERS} select (user_id + 1) % 5 as workspace_id, user_id, 'Member' as auth_role from members where user_id % 6 = 0 and not exists (select 1 from members m where m.user_id = members.user_id and m.workspace_id = (members.user_id + 1) % 5)""")
def accepted_invites(spark, d):
    m = fx.members(spark, d)
    i = m.where("user_id % 6 = 0").select(((F.col("user_id") + 1) % 5).cast("int").alias("workspace_id"), F.upper("email").alias("email"), F.lit("Member").alias("auth_role"), F.lit(None).cast("timestamp").alias("accepted_at"))
    out = work.accept_invites(m.select("user_id", "email"), i, m.select("workspace_id", "user_id"), F.lit(NOW).cast("timestamp"))
    return out["members"].select(F.col("workspace_id").cast("long").alias("workspace_id"), "user_id", "auth_role")


@query("select 'Team' as name, 5 as owner_id, 'Admin' as auth_role, 'workspace.created' as action")
def created_workspace(spark, d):
    out = work.create_workspace(" Team ", 5, spark, F.lit(NOW).cast("timestamp"))
    both = out["workspaces"].join(out["members"].select("workspace_id", "auth_role"), "workspace_id").join(out["audit"].select("workspace_id", "action"), "workspace_id")
    return both.select("name", "owner_id", "auth_role", "action")


@query(f"with {fx.MEMBERS} select user_id, email from members where lower(trim(' Customer.000000007@Example.COM ')) = email")
def member_by_email(spark, d):
    wanted = F.lower(F.trim(F.lit(" Customer.000000007@Example.COM ")))
    return fx.members(spark, d).where(F.lower(F.trim("email")) == wanted).limit(1).select("user_id", "email")


@query("""select sha256(text) as content_hash, count(*) as n from documents group by 1""")
def content_hashes(spark, d):
    f = fx.read(spark, d, "documents").select(F.col("text").cast("binary").alias("content"))
    new = flows.new_content(f).select("content_hash")
    n = f.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("n"))
    return new.join(n, "content_hash")
