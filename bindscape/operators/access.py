"""Access queries over user and workspace tables (the read side of the
reference's account service)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_member(members: str, user_id) -> F.Column:
    return F.exists(F.col(members), lambda m: m["user_id"] == user_id)


def visible_workspaces(workspaces: DataFrame, user_id: int) -> DataFrame:
    """C9 (one user): workspaces where the user is a member or that are public."""
    return (workspaces.filter(is_member("members", F.lit(user_id)) | F.col("is_public"))
                      .withColumn("member_count", F.size("members")))


def visible_workspaces_all(workspaces: DataFrame, users: DataFrame, user_key: str = "id") -> DataFrame:
    """C9 (every user): ``(user_id, workspace_id)`` pairs where the user is a
    member, plus the public workspaces (returned once, flagged, instead of
    being repeated for every user). Members are exploded and semi-joined to
    the user table, so no user x workspace product is built."""
    mem = (workspaces.select(F.col("id").alias("workspace_id"), F.explode("members").alias("m"),
                             "is_public")
                     .select(F.col("m.user_id").alias("user_id"), "workspace_id", "is_public"))
    mem = mem.join(users.select(F.col(user_key).alias("user_id")), "user_id", "left_semi")
    member_rows = mem.select("user_id", "workspace_id", F.lit("member").alias("access")).distinct()
    public_rows = workspaces.filter("is_public").select(
        F.lit(None).cast("long").alias("user_id"), F.col("id").alias("workspace_id"),
        F.lit("public").alias("access"))
    return member_rows.unionByName(public_rows)


def search_workspaces(workspaces: DataFrame, query: str, user_id: int, limit: int = 20) -> DataFrame:
    """Visible workspaces whose name or description contains ``query``
    (case-insensitive), first ``limit`` in id order."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.coalesce(F.lower("description").contains(q), F.lit(False))
    return visible_workspaces(workspaces, user_id).filter(hit).orderBy("id").limit(int(limit))


def user_stats(users: DataFrame, role: str = "role", active: str = "is_active") -> DataFrame:
    """Total, active and inactive users and the role distribution. The
    per-role table (one row per role) is folded into one row without a join."""
    per = users.groupBy(role).agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.col(active).cast("long")).alias("a"))
    return per.agg(
        F.sum("n").alias("total_users"), F.sum("a").alias("active_users"),
        (F.sum("n") - F.sum("a")).alias("inactive_users"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(role), F.col("n"))))).alias("role_distribution"))
