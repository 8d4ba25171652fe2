"""Runs of consecutive rows: islands, upserts that keep their place, accumulators that reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.ordered import Ordered


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """`rows` with `island`: numbered from 1, one more wherever `value` differs from that of the row before (null equals null)."""
    before = Ordered(rows, keys, order).beside("_was", F.struct(F.col(value).alias("v")))
    same = F.col("_was").isNotNull() & F.col(value).eqNullSafe(F.col("_was.v"))
    return before.running("island", (~same).cast("int")).done().drop("_was")


def speaker_text(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, text): a transcript of (speaker, text) rows. Empty texts don't break a run; a run opens with its speaker, save a first one without."""
    spoken = islands(segments.where("text IS NOT NULL AND text <> ''"), keys, order, "speaker")
    seq = Window.partitionBy(*keys, "island").orderBy(*order)
    first = F.row_number().over(seq) == 1
    opening = F.concat(F.lit("\n\n **"), F.coalesce("speaker", F.lit("None")), F.lit("**: "), "text")
    part = F.when(first & ~((F.col("island") == 1) & F.col("speaker").isNull()), opening).otherwise(F.concat(F.lit(" "), "text"))
    return spoken.withColumn("_part", part).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_part"))), lambda s: s["_part"]), "").alias("text"))


def caption_rows(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, row_id, participant, text, last_received): consecutive segments of a participant as one row, named by its first segment."""
    runs = islands(segments, keys, order, "participant")
    item = F.array_sort(F.collect_list(F.struct(*order, F.col("id").alias("_id"), F.trim("text").alias("_text"))))
    grouped = runs.groupBy(*keys, "island", "participant").agg(item.alias("_items"), F.max("last_received").alias("last_received"))
    text = F.array_join(F.filter(F.transform("_items", lambda s: s["_text"]), lambda t: t != ""), " ")
    return grouped.select(*keys, F.get("_items", F.lit(0))["_id"].alias("row_id"), "participant", text.alias("text"), "last_received")


def upsert(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per key the latest row, and `place`: where the key was first seen."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_row"), F.min(seq).alias("place")).select(*keys, "_row.*", "place")


def silence(samples: DataFrame, keys: list[str], order: list[str], track: str, silent: Column, delta: str, limit: int = 10_000) -> DataFrame:
    """(keys, status, tripped_at): silent time adds up and starts again with each change of track; the first audible
    sample ends the check (`passed`), `limit` milliseconds before it trip it (`silent`), else it is `pending`."""
    seq = Window.partitionBy(*keys).orderBy(*order)
    heard = F.max((~silent).cast("int")).over(seq.rowsBetween(Window.unboundedPreceding, 0))
    before = islands(samples.withColumn("_heard", heard), keys, order, track)
    run = Window.partitionBy(*keys, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = before.withColumn("_sum", F.sum(F.when(F.col("_heard") == 0, F.col(delta)).otherwise(0)).over(run))
    tripped = F.min(F.when((F.col("_heard") == 0) & (F.col("_sum") >= limit), F.col(order[0])))
    found = summed.groupBy(*keys).agg(tripped.alias("tripped_at"), F.max("_heard").alias("_passed"))
    status = F.when(F.col("tripped_at").isNotNull(), "silent").when(F.col("_passed") == 1, "passed").otherwise("pending")
    return found.select(*keys, status.alias("status"), "tripped_at")
