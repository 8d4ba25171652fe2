"""Duplicate accounts: groups, survivors and the merge of what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.access import rank, role_of


def duplicate_emails(users: DataFrame) -> DataFrame:
    """(email, n): lower-cased addresses, neither null nor empty, of more than one user."""
    named = users.where("email IS NOT NULL AND email <> ''")
    return named.groupBy(F.lower("email").alias("email")).agg(F.count("id").alias("n")).where("n > 1")


def duplicate_emails_raw(users: DataFrame) -> DataFrame:
    """(email, n): as written, null being a group."""
    return users.groupBy("email").agg(F.count("*").alias("n")).where("n > 1")


def survivors(users: DataFrame, newest: bool = True) -> DataFrame:
    """(id, survivor) for the users of duplicate groups: the newest (or oldest) by created, id survives.

    The survivor is an aggregate, not a window: a hot address is combined before it is shuffled.
    """
    named = users.where("email IS NOT NULL AND email <> ''").withColumn("_key", F.lower("email"))
    at = F.struct("created", "id")
    kept = named.groupBy("_key").agg((F.max(at) if newest else F.min(at)).alias("_kept"), F.count("*").alias("_n")).where("_n > 1")
    return named.join(kept, "_key").select("id", F.col("_kept.id").alias("survivor"))


def merge_accesses(accesses: DataFrame, moved: DataFrame) -> DataFrame:
    """(resource_id, user_id, id, role): accesses after their users are replaced by the survivors; of several for one
    user and resource one stays, with the highest role: the survivor's own if there is one, else the earliest of the
    stale users' in the order of `created`, `user`. Accesses of users that aren't merged stay as they are.
    """
    joined = accesses.join(moved, accesses["user_id"] == moved["id_user"])
    grouped = joined.groupBy("resource_id", F.col("survivor").alias("user_id")).agg(F.max(rank(F.col("role"))).alias("_rank"), F.min(F.struct((F.col("id_user") != F.col("survivor")).alias("stale"), "created", "id_user", "id")).alias("_first"))
    merged = grouped.select("resource_id", "user_id", F.col("_first.id").alias("id"), role_of(F.col("_rank")).alias("role"))
    others = accesses.join(moved, accesses["user_id"] == moved["id_user"], "left_anti").select("resource_id", "user_id", "id", "role")
    return merged.unionByName(others)


def reassign(rows: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """`rows` with `column` replaced by its survivor where there is one."""
    to = moved.select(F.col("id_user").alias("_from"), F.col("survivor").alias("_to"))
    return rows.join(to, rows[column] == to["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def without_stale(users: DataFrame, moved: DataFrame) -> DataFrame:
    """Users that stay, survivors with their address lower-cased."""
    stale = moved.where("id_user <> survivor").select(F.col("id_user").alias("_id"))
    kept = moved.where("id_user = survivor").select(F.col("survivor").alias("_kept"))
    left = users.join(stale, users["id"] == stale["_id"], "left_anti")
    return left.join(kept, left["id"] == kept["_kept"], "left").withColumn("email", F.when(F.col("_kept").isNotNull(), F.lower("email")).otherwise(F.col("email"))).drop("_kept")


def mergeable(users: DataFrame, moved: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`moved` of the groups that can be merged, (email, n) of those that can't): a group with a user in `broken` (id) stays as it was, all of it."""
    bad = moved.join(broken.select(F.col("id").alias("_id")).distinct(), F.col("id_user") == F.col("_id")).select(F.col("survivor").alias("_bad")).distinct()
    whole = moved.join(bad, F.col("survivor") == F.col("_bad"), "left_anti")
    failed = moved.join(bad, F.col("survivor") == F.col("_bad")).join(users.select(F.col("id").alias("_u"), F.lower("email").alias("email")), F.col("id_user") == F.col("_u"))
    return whole, failed.groupBy("email").agg(F.count("*").alias("n"))


def merged_tables(users: DataFrame, accesses: DataFrame, files: DataFrame, moved: DataFrame) -> dict[str, DataFrame]:
    """All tables that a merge changes."""
    return {"users": without_stale(users, moved), "accesses": merge_accesses(accesses, moved), "files": reassign(files, moved, "creator_id")}


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's first row."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
