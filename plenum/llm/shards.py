"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, and the shards take turns: each claims the
first slot of its permutation that is still free. All shards so get the same number of slots (give or take one), and
a change of the shard list moves few slots besides those of the shards that came or went. A row is placed by one
hash, modulo the table size, and one broadcast lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lookup table is broadcast; this bounds its rows (about 1 MB).
MAX_SLOTS = 1 << 17
N_SHARDS, TABLE_SIZE = 64, 6421


def _hash60(x: str) -> int:
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)


def hash60(col: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a long; the same on any engine that has MD5."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


def fill(shards: list[str], table_size: int) -> list[int]:
    """The table: slot -> index in `shards`. Work and memory are bounded by MAX_SLOTS, whatever the data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not len(shards) <= table_size <= MAX_SLOTS or table_size < 3 or any(table_size % k == 0 for k in range(2, int(table_size**0.5) + 1)):
        raise ValueError(f"table_size must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_hash60(f"offset:{s}") % table_size for s in shards]
    skip = [_hash60(f"skip:{s}") % (table_size - 1) + 1 for s in shards]
    table = [-1] * table_size
    for turn in range(table_size):
        s = turn % len(shards)
        while table[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % table_size
        table[at[s]] = s
    return table


def lookup_table(spark: SparkSession, shards: list[str], table_size: int) -> DataFrame:
    rows = [(slot, shards[s]) for slot, s in enumerate(fill(shards, table_size))]
    return spark.createDataFrame(rows, "slot long, shard string")


def shard_rows(df: DataFrame, keys: list[str], shards: list[str], table_size: int = TABLE_SIZE, spread_by: list[str] | None = None) -> DataFrame:
    """`df` with the columns `slot` and `shard`; every input row comes out once.

    Rows with equal `keys` meet in one shard. With `spread_by`, a key that holds more than an even shard's rows is
    dealt over as many sub-keys as it fills shards (a single row stays where it is), by a hash of the columns `spread_by`. At most one key per
    shard can be that large, so the list of hot keys is bounded by the number of shards.

    Nulls are keys like any other (null and '' differ); equal rows go to the same shard; an empty table stays
    empty. Columns of `df` that are called `slot` or `shard` are replaced (they may be keys); others pass, whatever
    their names (two leading underscores are reserved).
    """
    part = lambda c: F.when(F.col(f"`{c}`").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")))
    written = lambda columns: F.concat_ws("\x1f", *map(part, columns))
    rows = df.withColumn("__key", written(keys))
    if spread_by:
        n = rows.count()
        hot = rows.groupBy("__key").agg(F.count("*").alias("__rows")).where((F.col("__rows") > 1) & (F.col("__rows") * len(shards) > n))
        deal = F.pmod(hash60(written(spread_by)), F.ceil(F.col("__rows") * len(shards) / F.lit(max(n, 1))))
        rows = rows.join(F.broadcast(hot), "__key", "left").withColumn("__key", F.when(F.col("__rows").isNull(), F.col("__key")).otherwise(F.concat_ws("\x1f", "__key", deal.cast("string"))))
    rows = rows.withColumn("__slot", F.pmod(hash60(F.col("__key")), F.lit(table_size)))
    placed = rows.join(F.broadcast(lookup_table(df.sparkSession, shards, table_size).toDF("__slot", "__shard")), "__slot")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")], F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard, keyed by doc_id; an id that holds more than a shard's rows is dealt out by the other short columns.

    A null id is a key like any other. Texts are not read, however long. Repeated rows stay rows; an empty table stays empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return shard_rows(docs, ["doc_id"], shard_names(N_SHARDS), TABLE_SIZE, ["source", "lang", "n_chars"]).select("doc_id", "slot", "shard")

