"""Tables that change by key, and batches published together, over the workspace tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import tables
from lodestone.plans import fixtures as fx
from lodestone.plans.queries import query


@query(f"""with {fx.MEMBERS} select user_id, workspace_id, case when user_id % 7 = 0 then 'new.' || email else email end as email from members where user_id % 11 <> 0
 union all select user_id + 10000000, workspace_id, email from members where user_id % 50 = 0""")
def merged_members(spark, d):
    """Members as a table of 16 buckets: some addresses change, some people leave, some join."""
    m = fx.members(spark, d).select("user_id", "workspace_id", "email")
    t = tables.KeyedTable(tables.fresh(spark, "members"), ("user_id",), 16)
    t.create(m)
    changed = m.where("user_id % 7 = 0 and user_id % 11 <> 0").withColumn("email", F.concat(F.lit("new."), "email"))
    joined = m.where("user_id % 50 = 0").withColumn("user_id", F.col("user_id") + 10_000_000)
    t.merge(changed.unionByName(joined), m.where("user_id % 11 = 0").select("user_id"))
    return t.read(spark)


@query(f"with {fx.TASKS} select task_id, case when task_id % 13 = 0 then 'done' else status end as status, case when task_id % 13 = 0 then 1 else 0 end::bigint as audits from tasks where task_id % 17 <> 0 or task_id % 13 = 0")
def committed_tasks(spark, d):
    """Tasks and their audit rows change in batches: one closes and deletes tasks, comes twice, and one breaks a rule and leaves no trace."""
    t = fx.tasks(spark, d).select("task_id", "status")
    ledger = tables.Ledger(tables.fresh(spark, "ledger"), {"tasks": ("task_id",), "audit": ("task_id", "action")})
    done = t.where("task_id % 13 = 0").withColumn("status", F.lit("done"))
    audit = done.select("task_id", F.lit("task.done").alias("action"))
    known = {"audit rows have tasks": lambda book, staged: staged["audit"].join(book.read(spark, "tasks"), "task_id", "left_anti")}
    ledger.commit(spark, "load", {"tasks": t})
    for _ in range(2):
        ledger.commit(spark, "close", {"tasks": done, "audit": audit}, {"tasks": t.where("task_id % 17 = 0 and task_id % 13 <> 0")}, known)
    try:
        ledger.commit(spark, "broken", {"tasks": t.withColumn("status", F.lit("lost")), "audit": audit.withColumn("task_id", -F.col("task_id"))}, rules=known)
    except tables.RuleBroken:
        pass  # what the rule is for
    audits = ledger.read(spark, "audit").groupBy("task_id").agg(F.count("*").alias("n"))
    return ledger.read(spark, "tasks").join(audits, "task_id", "left").select("task_id", "status", F.coalesce("n", F.lit(0)).cast("long").alias("audits"))
