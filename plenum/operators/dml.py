"""Batch changes as new snapshots: Spark has no row transactions, so a change is a table that replaces another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.sources.folders import kept

#: Classes of recording statuses.
STATUS = {
    "final": ("stopped", "saved", "aborted", "failed_to_start", "failed_to_stop", "notification_succeeded", "external_process_successful", "external_process_failed"),
    "unsuccessful": ("aborted", "failed_to_start", "failed_to_stop"),
    "savable": ("active", "stopped"),
    "saved": ("saved", "notification_succeeded", "external_process_successful", "external_process_failed"),
}
DIGITS = 10


def bulk_update(rows: DataFrame, column: str, eligible: tuple[str, ...], new: str) -> DataFrame:
    """`rows` with `column` set to `new` where it is eligible, and `changed`."""
    hit = F.coalesce(F.col(column).isin(*eligible), F.lit(False))
    return rows.withColumn("changed", hit).withColumn(column, F.when(F.col("changed"), F.lit(new)).otherwise(F.col(column)))


def compare_and_set(calls: DataFrame, rows: DataFrame, state: str, expected: str, order: list[str]) -> DataFrame:
    """`calls` (with `id`) with `won`: the first call for a row that is in the expected state. Later ones find it changed."""
    now = rows.select(F.col("id").alias("_id"), F.col(state).alias("_state"))
    first = calls.groupBy("id").agg(F.min(F.struct(*order)).alias("_first"))
    both = calls.join(now, calls["id"] == now["_id"]).join(first, "id")
    return both.withColumn("won", (F.col("_state") == expected) & (F.struct(*order) == F.col("_first"))).drop("_id", "_state", "_first")


def get_or_create(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, outcome): created, updated where the value differs, or kept."""
    left = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_had"))
    both = left.join(new.select(*keys, F.col(value).alias("_new")), keys, "full")
    outcome = F.when(F.col("_had").isNull(), "created").when(F.col("_new") != F.col("_old"), "updated").otherwise("kept")
    return both.select(*keys, F.coalesce("_new", "_old").alias(value), outcome.alias("outcome"))


def deletions(files: DataFrame, now: int, grace: int) -> DataFrame:
    """(id, can_soft_delete, reject_reason): why a file can't be deleted for good; null if it can."""
    reason = F.when(F.col("hard_deleted_hour").isNotNull(), "already hard deleted").when(F.col("deleted_hour").isNull(), "not deleted").when(F.lit(now) - F.col("deleted_hour") < grace, "too recent")
    return files.select("id", F.col("deleted_hour").isNull().alias("can_soft_delete"), reason.alias("reject_reason"))


def to_purge(files: DataFrame, now: Column, hours: int) -> DataFrame:
    """Files that are hard deleted, or were deleted `hours` ago or more."""
    return files.where(F.col("hard_deleted_hour").isNotNull() | (F.col("deleted_hour") <= now - hours))


def stale_uploads(files: DataFrame, now: Column, hours: int) -> DataFrame:
    """Pending files made more than `hours` ago that aren't hard deleted."""
    if hours < 0:
        raise ValueError("hours must not be negative")
    return files.where((F.col("upload_state") == "pending") & (F.col("created_hour") < now - hours) & F.col("hard_deleted_hour").isNull())


def index_join(index: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their values, dangling ids to prune from the index)."""
    members = index.distinct()
    return members.join(values, "id"), members.join(values.select("id"), "id", "left_anti")


def backfill_codes(rows: DataFrame, key: str, code: str, seed: int = 0) -> DataFrame:
    """`rows` with a code of DIGITS digits for each that had none: unique, and none that is taken.

    Rows draw from a hash; draws that are taken or drawn twice are drawn again by those who lost, until none are left.
    """
    size = 10**DIGITS
    have = rows.where(F.col(code).isNotNull()).select(key, F.lpad(code, DIGITS, "0").alias(code))
    want = kept(rows.where(F.col(code).isNull()).select(key))
    if rows.count() > size // 2:
        raise ValueError(f"codes of {DIGITS} digits are too scarce")
    attempt = 0
    while not want.isEmpty():  # half of the codes are free at least, so each attempt leaves half of those who ask or fewer
        drawn = want.withColumn(code, F.lpad(F.pmod(F.xxhash64(key, F.lit(seed + attempt)), F.lit(size)).cast("string"), DIGITS, "0"))
        free = drawn.join(have.select(code), code, "left_anti")
        won = kept(free.groupBy(code).agg(F.min(key).alias(key)).select(key, code))
        have = kept(have.unionByName(won))
        want = kept(want.join(won.select(key), key, "left_anti"))
        attempt += 1
    return have
