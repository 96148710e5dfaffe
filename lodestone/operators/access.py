"""Row-level access: what a principal may read or write, and integrity rules as violation queries.

members: workspace_id, user_id, auth_role ('Admin' or 'Member'). A secured frame is a semi join with the
principal's memberships, so the rule holds whatever is asked afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tables that only an Admin of the workspace may read.
ADMIN_ONLY = ("workspace_invites", "retrieval_runs", "audit_log", "admin_reviews")
# Columns of a task that a Member may change.
MEMBER_EDITABLE = ("status", "position")


def memberships(members: DataFrame, user_id, admin: bool = False) -> DataFrame:
    own = members.where(F.col("user_id") == F.lit(user_id))
    return (own.where("auth_role = 'Admin'") if admin else own).select("workspace_id").distinct()


def readable(table: str, rows: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """Rows of a workspace table that the user may read."""
    return rows.join(memberships(members, user_id, table in ADMIN_ONLY), "workspace_id", "left_semi")


def readable_users(users: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """Oneself and everyone who shares a workspace."""
    shared = members.join(memberships(members, user_id), "workspace_id", "left_semi").select("user_id").distinct()
    me = shared.sparkSession.createDataFrame([(user_id,)], shared.schema)
    return users.join(shared.unionByName(me).distinct(), "user_id", "left_semi")


def readable_children(children: DataFrame, parents: DataFrame, key: str, members: DataFrame, user_id) -> DataFrame:
    """Rows (citations) visible exactly where their parent (answer) is."""
    return children.join(readable("", parents, members, user_id).select(key), key, "left_semi")


def readable_objects(objects: DataFrame, members: DataFrame, user_id, admin: bool = False) -> DataFrame:
    """Stored objects whose path's first folder is one of the user's workspaces."""
    own = memberships(members, user_id, admin).select(F.col("workspace_id").cast("string").alias("_folder"))
    return objects.withColumn("_folder", F.split("name", "/")[0]).join(own, "_folder", "left_semi").drop("_folder")


def member_update_violations(old: DataFrame, new: DataFrame, editors: DataFrame, key: str) -> DataFrame:
    """Updates by Members that change more than MEMBER_EDITABLE: compared null-safely as one row value."""
    fixed = [c for c in old.columns if c != key and c not in MEMBER_EDITABLE and c in new.columns]
    both = old.alias("o").join(new.alias("n"), key).join(editors, key)
    changed = ~F.struct(*[F.col(f"o.{c}") for c in fixed]).eqNullSafe(F.struct(*[F.col(f"n.{c}") for c in fixed]))
    return both.where((F.col("auth_role") == "Member") & changed).select(key)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for each row and rule that doesn't hold; an unknown result passes, as a CHECK does."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, keys: list[Column], where: Column | None = None) -> DataFrame:
    """Key values that a (partial) unique rule forbids."""
    rows = rows if where is None else rows.where(where)
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    return rows.select(*named).where(reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(keys))])).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Children whose (non-null) reference has no parent."""
    known = children.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))
    return known.join(parents.select(*on).distinct(), on, "left_anti")


def workspaces_without_admin(members: DataFrame) -> DataFrame:
    return members.groupBy("workspace_id").agg(F.count_if(F.col("auth_role") == "Admin").alias("admins")).where("admins = 0").select("workspace_id")


# Who may write a table's rows: any member, or an Admin of the workspace; and what a row's own user may do beside.
WRITERS = {"workspaces": "Admin", "workspace_members": "Admin", "workspace_invites": "Admin", "documents": "Admin", "sprints": "Admin", "notes": "Member", "tasks": "Member"}
OWN = {"workspace_members": ("delete", "user_id"), "notes": ("delete", "created_by")}


def writable(table: str, action: str, rows: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """Rows that the user may insert, update or delete.

    A document's uploader must be the user; anyone may leave a workspace; a note is deleted by its creator or an Admin.
    """
    own = OWN.get(table)
    strict = WRITERS[table] == "Admin" or (table == "notes" and action == "delete")
    allowed = rows.join(memberships(members, user_id, strict), "workspace_id", "left_semi")
    if table == "documents" and action == "insert":
        return allowed.where(F.col("uploaded_by") == F.lit(user_id))
    if own and own[0] == action:
        mine = rows.where(F.col(own[1]) == F.lit(user_id)).join(memberships(members, user_id), "workspace_id", "left_semi")
        return allowed.where(~F.coalesce(F.col(own[1]) == F.lit(user_id), F.lit(False))).unionByName(mine)
    return allowed


def find_workspace(workspaces: DataFrame, given: str) -> DataFrame:
    """workspace_id, name by id, else by a part of the name that only one has; no row if none or several do."""
    exact = workspaces.where(F.col("workspace_id").cast("string") == given)
    part = workspaces.where(F.contains(F.lower("name"), F.lit(given.lower())))
    single = part.groupBy().agg(F.count("*").alias("n"), F.first("workspace_id").alias("workspace_id"), F.first("name").alias("name")).where("n = 1").select("workspace_id", "name")
    both = exact.select("workspace_id", "name", F.lit(1).alias("way")).unionByName(single.withColumn("way", F.lit(2)))
    return both.groupBy().agg(F.min_by(F.struct("workspace_id", "name"), "way").alias("w")).where("w is not null").select("w.*")
