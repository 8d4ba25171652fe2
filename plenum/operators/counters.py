"""Counters and queues: differences, rates, ring buffers, running text, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.ordered import Ordered


def delta(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """`rows` with `delta`: `value` less that of the row before; 0 for a key's first row."""
    return rows.withColumn("delta", F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0)))


def rate(rows: DataFrame, keys: list[str], order: list[str], n_bytes: str, ms: str) -> DataFrame:
    """`rows` with `kbps`: bits by millisecond since the row before; 0 at first, when no time passed, or when the counter fell."""
    seq = Window.partitionBy(*keys).orderBy(*order)
    size, time = F.col(n_bytes) - F.lag(n_bytes).over(seq), F.col(ms) - F.lag(ms).over(seq)
    return rows.withColumn("kbps", F.when(time > 0, F.greatest(F.lit(0.0), size * 8 / time)).otherwise(0.0))


def latest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Each key's last n rows."""
    seq = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(seq)).where(F.col("_n") <= n).drop("_n")


def pre_roll(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """`rows` with `pre_roll`: the values of the last n rows, this one included."""
    return rows.withColumn("pre_roll", F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)))


def running_text(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """`rows` with `running`: all texts so far, joined. Grows with the square of a key's rows, as its output does."""
    return rows.withColumn("running", F.array_join(F.collect_list(text).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), ""))


def queue(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` with `position`, from 1, however many rows a key has."""
    return Ordered(rows, keys, order).running("position", F.lit(1)).done()


def report_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the rates, the largest jitter and the last round-trip time of each key's samples."""
    return rows.groupBy(*keys).agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.max("jitter").alias("jitter"), F.max_by("rtt", "seq").alias("rtt"))
