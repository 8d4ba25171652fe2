"""Sinks that are read back, and streams over the event table that run until all of it is used (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.plans.analogues import entity, with_views
from plenum.plans.registry import query
from plenum.sources import stores
from plenum.sources.folders import fresh_folder
from plenum.sources.tables import table
from plenum.streaming import delivery, rooms

c = F.col


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream, with event time as a timestamp. A pattern, as a stream's plain path has to be a folder."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("at", c("ts").cast("timestamp"))


def _drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of its input and reads what it wrote. In update and complete mode a batch replaces the one before."""
    at = fresh_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("a4_bulk_insert", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def a4(spark, d):
    at = fresh_folder(spark, "bulk")
    stores.bulk_insert(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), at)
    return spark.read.parquet(at)


def _written_meetings(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document for each day, written and read again."""
    rows = entity(spark, d, "meeting").select(c("day").cast("string").alias("day"), c("participant").cast("string").alias("participant_id"), "type", F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit(None).cast("string").alias("data"), F.concat(F.lit("P"), c("participant").cast("string")).alias("name"))
    at = fresh_folder(spark, "meetings")
    stores.write_meeting_documents(rows, "day", at)
    return spark.read.schema(f"day string, {stores.MEETING}").json(at)


@query("a5_meeting_documents", with_views("meeting", "SELECT day::VARCHAR AS day, count(*) AS n, count(*) FILTER (type = 'chat_received') AS chats, count(DISTINCT participant) AS people FROM meeting GROUP BY day"))
def a5(spark, d):
    each = _written_meetings(spark, d).select("day", F.size("participants").cast("long").alias("people"), F.explode("events").alias("e"))
    return each.groupBy("day", "people").agg(F.count("*").alias("n"), F.count_if(c("e.type") == "chat_received").alias("chats")).select("day", "n", "chats", "people")


@query("a6_meeting_sink", with_views("meeting", "SELECT day::VARCHAR AS day, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last FROM meeting GROUP BY day"))
def a6(spark, d):
    """The sink sorts a document's events by time, so its first and last events are the earliest and the latest."""
    return _written_meetings(spark, d).select("day", F.element_at("events", 1)["timestamp"].alias("first"), F.element_at("events", -1)["timestamp"].alias("last"))


@query("a7_transcript_sink", "SELECT role AS job_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def a7(spark, d):
    at = fresh_folder(spark, "transcripts")
    stores.write_transcripts(table(spark, d, "conversations").select(c("role").alias("job_id"), "text"), at)
    return spark.read.schema("text string, job_id string").json(at).groupBy("job_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a8_media_probe", with_views("meeting", "SELECT participant, max(ms + CASE WHEN event_id % 3 > 0 THEN event_id ELSE 0 END)::DOUBLE AS duration, bool_or(type = 'speech_start') AS has_audio FROM meeting GROUP BY participant"))
def a8(spark, d):
    """Probe documents of packets and streams, one for each participant."""
    m = entity(spark, d, "meeting")
    packet = F.struct(c("ms").cast("double").alias("pts_time"), F.when(c("event_id") % 3 > 0, c("event_id").cast("double")).alias("duration_time"))
    kind = F.struct(F.when(c("type") == "speech_start", "audio").otherwise("data").alias("codec_type"), c("type").alias("codec_name"))
    at = fresh_folder(spark, "probes")
    m.groupBy("participant").agg(F.collect_list(packet).alias("packets"), F.collect_set(kind).alias("streams")).write.json(at)
    doc = spark.read.schema(f"participant long, {stores.PROBE}").json(at)
    ends = F.transform("packets", lambda p: p["pts_time"] + F.coalesce(p["duration_time"], F.lit(0.0)))
    return doc.select("participant", F.array_max(ends).alias("duration"), F.exists("streams", lambda s: s["codec_type"] == "audio").alias("has_audio"))


@query("a9_webhook_stream", "SELECT event_id, 'on_' || event_type AS handler FROM events WHERE event_type IN ('view', 'click') AND NOT starts_with('room' || user_id, 'room1')")
def a9(spark, d):
    rows = _stream(spark, d).select("event_id", c("event_type").alias("event"), F.concat(F.lit("room"), c("user_id").cast("string")).alias("room_name"), F.lit(None).cast("string").alias("egress_room_name"))
    return _drained(spark, rooms.route(rows, test_prefix="room1", known=("view", "click")).select("event_id", "handler"), "webhooks")


@query("a9_webhook_json_stream", "SELECT event_id, 'room' || user_id AS room, 'on_' || event_type AS handler FROM events WHERE event_type IN ('view', 'click') AND NOT starts_with('room' || user_id, 'room1')")
def a9_json(spark, d):
    """Webhooks as they come: JSON lines in a folder. A room is named by the event or, for every other one, by its recorder."""
    named = F.concat(F.lit("room"), c("user_id").cast("string"))
    at = fresh_folder(spark, "hooks")
    table(spark, d, "events").select(c("event_type").alias("event"), F.when(c("event_id") % 2 == 0, named).alias("room_name"), c("event_id").cast("string").alias("egress_id"), named.alias("egress_room_name"), F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts")).write.json(at)
    routed = rooms.route(stores.webhooks(spark, at), test_prefix="room1", known=("view", "click"))
    return _drained(spark, routed.select(c("egress_id").cast("long").alias("event_id"), "room", "handler"), "routed")


@query("a10_callback_stream", with_views("recordings", "SELECT e.event_id::VARCHAR AS job_id, r.id AS recording_id FROM events e JOIN recordings r ON r.id = e.event_id"))
def a10_stream(spark, d):
    known = entity(spark, d, "recordings").select("id", c("id").cast("string").alias("external_process_id"))
    return _drained(spark, rooms.callbacks(spark, _stream(spark, d).select(c("event_id").cast("string").alias("job_id")), known), "callbacks")


@query("a11_event_log_stream", "SELECT event_id, user_id, event_type FROM events")
def a11(spark, d):
    at = fresh_folder(spark, "log")
    rooms.collect_log(_stream(spark, d).select("event_id", "user_id", "event_type"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").json(f"{at}/out")


@query("a12_text_stream", "SELECT user_id, count(*) AS deltas, sum(length(props))::BIGINT AS chars FROM events GROUP BY user_id")
def a12(spark, d):
    return _drained(spark, _stream(spark, d).groupBy("user_id").agg(F.count("*").alias("deltas"), F.sum(F.length("props")).alias("chars")), "deltas", "complete")


@query("a12_text_stream_json", "SELECT 's' || user_id AS session, count(*) AS deltas, sum(length(props))::BIGINT AS chars, max(event_id) AS last_seq FROM events GROUP BY user_id")
def a12_json(spark, d):
    at = fresh_folder(spark, "deltas")
    table(spark, d, "events").select(F.concat(F.lit("s"), c("user_id").cast("string")).alias("session"), c("event_id").alias("seq"), c("props").alias("delta"), F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts")).write.json(at)
    return _drained(spark, stores.text_stream(spark, at).groupBy("session").agg(F.count("*").alias("deltas"), F.sum(F.length("delta")).alias("chars"), F.max("seq").alias("last_seq")), "texts", "complete")


@query("a13_each_batch_sink", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def a13(spark, d):
    """Each micro-batch is written to a folder of its own number, so a batch that is sent again replaces itself."""
    at = fresh_folder(spark, "sent")
    rooms.post_each_batch(_stream(spark, d).where("event_type = 'purchase'").select("event_id", "value"), lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "value")


@query("a13_webhook_delivery", "SELECT event_id::VARCHAR AS key, CASE WHEN event_id % 6 > 3 THEN 'dead' ELSE 'delivered' END AS status, least(event_id % 6 + 1, 4)::INTEGER AS attempts, CASE WHEN event_id % 6 > 3 THEN 'try 4' END AS error FROM events WHERE event_type = 'purchase'")
def a13_delivery(spark, d):
    """What came of each webhook: delivered at some try, or a dead letter after three more than the first."""

    def send(key: str, body: str, attempt: int) -> None:  # an endpoint that answers no sooner than at a try of its own for each key
        if attempt <= int(key) % 6:
            raise delivery.RequestError(f"try {attempt}")

    at = fresh_folder(spark, "delivered")
    rows = _stream(spark, d).where("event_type = 'purchase'").select(c("event_id").cast("string").alias("key"), F.to_json(F.struct("event_id", "value")).alias("body"))
    delivery.deliver(rows, f"{at}/out", f"{at}/state", send, pause=0.0).awaitTermination()
    return delivery.delivered(spark, f"{at}/out").select("key", "status", "attempts", "error")


@query("i11_once_stream", "SELECT DISTINCT event_id FROM events")
def i11_stream(spark, d):
    return _drained(spark, rooms.once(_stream(spark, d).select("event_id", "at"), "event_id", "at").select("event_id"), "once")


@query("i15_window_stream", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def i15_stream(spark, d):
    counted = rooms.per_window(_stream(spark, d), "at", "event_type")
    return _drained(spark, counted, "windows", "complete").select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("i16_session_stream", """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM r GROUP BY user_id, run""")
def i16_stream(spark, d):
    found = rooms.sessions(_stream(spark, d), "at", "user_id")
    return _drained(spark, found, "sessions", "complete").select("user_id", F.unix_micros("start").alias("start"), "n")
