"""Readers and writers besides tables: JSON documents, transcripts, bulk inserts, result pages, key-value snapshots, JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEETING = "events array<struct<participant_id:string,type:string,timestamp:string,data:string>>, participants array<struct<participantId:string,name:string>>"
PROBE = "packets array<struct<pts_time:double,duration_time:double>>, streams array<struct<codec_type:string,codec_name:string>>"
WEBHOOK = "event string, room_name string, egress_id string, egress_room_name string, egress_status string, participant_identity string, ts timestamp"
BATCH = 20_000


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read in `parts` ranges of a numeric key."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def meeting_documents(spark: SparkSession, path: str) -> DataFrame:
    """One meeting document a file: its events and participants, and the file's name."""
    return spark.read.schema(MEETING).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def meeting_events(documents: DataFrame) -> DataFrame:
    """(file, pos, participant_id, type, at, data): the events in the order of the file."""
    each = documents.select("file", F.posexplode("events").alias("pos", "e"))
    return each.select("file", "pos", "e.participant_id", "e.type", F.try_to_timestamp("e.timestamp").alias("at"), "e.data")


def write_meeting_documents(events: DataFrame, key: str, path: str) -> None:
    """A document for each key with its events by time; a last name wins for each participant."""
    item = F.struct("timestamp", "participant_id", "type", "data")
    people = events.groupBy(key, "participant_id").agg(F.max_by("name", "timestamp").alias("name")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("participant_id").alias("participantId"), "name"))).alias("participants"))
    events.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("events")).join(people, key).write.mode("overwrite").json(path)


def write_transcripts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("job_id").json(path)


def write_summaries(rows: DataFrame, path: str) -> None:
    rows.select("job_id", F.col("summary").alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)


def bulk_insert(rows: DataFrame, path: str, batch: int = BATCH) -> None:
    rows.write.mode("append").option("maxRecordsPerFile", batch).parquet(path)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """(file, duration, has_audio, has_video, has_bad_stream, audio_codec) of media probe documents."""
    doc = spark.read.schema(PROBE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    ends = F.transform(F.filter("packets", lambda p: p["pts_time"].isNotNull()), lambda p: p["pts_time"] + F.coalesce(p["duration_time"], F.lit(0.0)))
    has = lambda kind: F.exists("streams", lambda s: F.coalesce(s["codec_type"] == kind, F.lit(False)))
    return doc.select("file", F.array_max(ends).alias("duration"), has("audio").alias("has_audio"), has("video").alias("has_video"), F.exists("streams", lambda s: s["codec_type"].isNull()).alias("has_bad_stream"), F.get(F.filter("streams", lambda s: s["codec_type"] == "audio"), F.lit(0))["codec_name"].alias("audio_codec"))


def webhooks(spark: SparkSession, path: str) -> DataFrame:
    """A stream of webhook events, a JSON line each."""
    return spark.readStream.schema(WEBHOOK).json(path)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of transcript deltas."""
    return spark.readStream.schema("session string, seq long, delta string, ts timestamp").json(path)


def analytics(events: DataFrame, path: str) -> None:
    """Append product events; anonymous ones are dropped."""
    events.where("distinct_id IS NOT NULL").write.mode("append").json(path)


def snapshot(log: DataFrame, key: str, order: str, deleted: Column, until: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """The live rows of a key-value log: each key's last write, unless it is a deletion or has expired."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("v")).select(key, "v.*").where(~deleted)
    return last if until is None else last.where(until > as_of)


def many(live: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The asked keys, with nulls where nothing is stored."""
    return keys.join(live, key, "left")


def result_page(rows: DataFrame, order: list, number: int, size: int, path: str) -> DataFrame:
    """(document): one JSON document of a page of at most 100 rows: count, next, previous, results."""
    from plenum.operators.paging import page

    got = page(rows, order, number, size)
    link = lambda n: F.lit(f"{path}?page={n}")
    packed = got.agg(F.max("total").alias("count"), F.collect_list(F.struct(*rows.columns)).alias("results"))  # one page
    more = F.col("count") > number * size
    return packed.select(F.to_json(F.struct("count", F.when(more, link(number + 1)).alias("next"), (link(number - 1) if number > 1 else F.lit(None).cast("string")).alias("previous"), "results")).alias("document"))
