"""Ordering and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.sources.folders import shared_folder

MOST = 100


def ordering(asked: str, allowed: tuple[str, ...], default: str, tie: str = "id") -> list[Column]:
    """Sort keys from a comma-separated list; a minus turns a key round, unknown names are ignored, none left means the default."""
    named = [x for x in asked.split(",") if x.lstrip("-") in allowed] or [default]
    return [F.col(x.lstrip("-")).desc() if x[0] == "-" else F.col(x).asc() for x in named] + [F.col(tie).asc()]


def top(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows with their `place`, from 1. Every task keeps n rows, so only those are brought together."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def places(rows: DataFrame, order: list) -> DataFrame:
    """All rows in their order, with their `place`, from 1; `order` has to tell any two rows apart.

    Ranges of rows are sorted and numbered each in a task of its own, and the sizes of the ranges before it are added.
    The ranges are written to the shared folder, as their bounds come from a sample that must not be drawn twice.
    """
    shared_folder(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(starts), "_range").withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside").orderBy("place")


def page(rows: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """Page `number` (from 1) of at most MOST rows, with `total`: how many rows there are."""
    size = min(size, MOST)
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def top_and_more(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """(key, first, more): each key's first k values, joined by commas, and how many there are besides."""
    by = Window.partitionBy(key).orderBy(order)
    first = rows.select(key, order, F.row_number().over(by).alias("_n")).where(F.col("_n") <= k).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.cast("string")), ",").alias("first"))
    counts = rows.groupBy(key).agg(F.greatest(F.count("*") - k, F.lit(0).cast("long")).alias("more"))
    return first.join(counts, key)
