"""Roles and row-level access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles from the least to the most.
ROLES = ("member", "administrator", "owner")
MANAGERS = ("administrator", "owner")


def rank(role: Column) -> Column:
    """1 to 3; null for no or an unknown role."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(ROLES, 1):
        out = F.when(role == name, k).otherwise(out)
    return out


def role_of(rank_: Column) -> Column:
    return F.get(F.array(*map(F.lit, ROLES)), rank_ - 1)


def best_role(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role): the highest role of each."""
    return accesses.groupBy(*keys).agg(role_of(F.max(rank(F.col("role")))).alias("role"))


def mine(rows: DataFrame, accesses: DataFrame, row_id: str, viewer: Column) -> DataFrame:
    """Rows that the viewer has an access to, each once: a semi join, so several accesses don't repeat a row."""
    own = accesses.where(viewer).select(F.col("resource_id").alias("_id"))
    return rows.join(own, rows[row_id] == own["_id"], "left_semi")


def managed(accesses: DataFrame, viewer: Column) -> DataFrame:
    """All accesses of the resources where the viewer is administrator or owner; both conditions hold of one access."""
    own = accesses.where(viewer & F.col("role").isin(*MANAGERS)).select(F.col("resource_id").alias("_id"))
    return accesses.join(own, accesses["resource_id"] == own["_id"], "left_semi")


def by_access(rows: DataFrame, accesses: DataFrame, row_id: str, user: int, teams: list[str]) -> DataFrame:
    """A row for each access of the user or one of the teams: a row with two such accesses comes twice."""
    own = accesses.where((F.col("user_id") == user) | F.col("team").isin(*teams)).select(F.col("resource_id").alias("_id"), F.col("id").alias("access_id"))
    return rows.join(own, rows[row_id] == own["_id"]).drop("_id")


def can_access_room(level: Column, authenticated: Column, role: Column) -> Column:
    """Public rooms, trusted ones for those logged in, and rooms where the viewer has any role."""
    return (level == "public") | ((level == "trusted") & authenticated) | role.isNotNull()


def skips_lobby(level: Column, authenticated: Column, role: Column) -> Column:
    """As can_access_room, but a role only counts in restricted rooms."""
    return (level == "public") | ((level == "trusted") & authenticated) | ((level == "restricted") & role.isNotNull())


def may(method: Column, role: Column) -> Column:
    """Deletion takes an owner, writing an administrator or owner, reading any role."""
    return F.when(method == "DELETE", F.coalesce(role == "owner", F.lit(False))).when(method.isin("PUT", "PATCH"), F.coalesce(role.isin(*MANAGERS), F.lit(False))).otherwise(role.isNotNull())


def recording_abilities(role: Column, final: Column) -> Column:
    manager = F.coalesce(role.isin(*MANAGERS), F.lit(False))
    return F.struct((manager & final).alias("destroy"), manager.alias("retrieve"), (manager & ~final).alias("stop"), F.lit(False).alias("update"))


def file_abilities(is_creator: Column, deleted: Column, hard_deleted: Column) -> Column:
    """Everything is the creator's; deletion ends updates and media, a hard one ends the rest."""
    own = F.coalesce(is_creator, F.lit(False))
    return F.struct((own & ~hard_deleted).alias("destroy"), (own & deleted & ~hard_deleted).alias("hard_delete"), (own & ~deleted).alias("media"), (own & ~hard_deleted).alias("retrieve"), (own & ~deleted).alias("update"))


def access_abilities(role: Column, viewer: Column, owners: Column) -> Column:
    """An owner's access can only go while another owner is left; `set_role_to` is sorted."""
    manager, owner = F.coalesce(viewer.isin(*MANAGERS), F.lit(False)), F.coalesce(viewer == "owner", F.lit(False))
    is_owner = role == "owner"
    change = F.when(is_owner, owner & (owners > 1)).otherwise(manager)
    roles = F.array_compact(F.array(F.when(change & (role != "administrator"), F.lit("administrator")), F.when(change & (role != "member"), F.lit("member")), F.when(change & owner & ~is_owner, F.lit("owner"))))
    return F.struct(change.alias("destroy"), F.array_sort(roles).alias("set_role_to"))
