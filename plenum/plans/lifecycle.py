"""Sources, key-value snapshots and stateful histories over the meeting events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import lifecycle
from plenum.plans.analogues import entity, with_views
from plenum.plans.registry import query
from plenum.sources import stores
from plenum.sources.tables import table

c = F.col
_AT = "epoch_us(ts) // 1000000"
_NOW = 1_710_000_000


def _secs():
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


query("a1_table_scan", "SELECT * FROM nation")(lambda s, d: table(s, d, "nation"))
query("a2_base_filtered_scan", with_views("files", "SELECT id, type FROM files WHERE hard_deleted_hour IS NULL"))(lambda s, d: entity(s, d, "files").where("hard_deleted_hour IS NULL").select("id", "type"))
query("a3_cursor_scan", with_views("files", "SELECT id FROM files WHERE upload_state = 'pending'"))(lambda s, d: entity(s, d, "files").where("upload_state = 'pending'").select("id"))
query("a14_analytics_events", "SELECT event_id, user_id AS distinct_id, event_type FROM events WHERE user_id % 4 > 0")(lambda s, d: table(s, d, "events").select("event_id", F.when(c("user_id") % 4 > 0, c("user_id")).alias("distinct_id"), "event_type").where("distinct_id IS NOT NULL"))


@query("a10_callback_join", with_views("recordings", "SELECT e.event_id, r.id AS recording_id FROM events e JOIN recordings r ON r.id = e.event_id * 3"))
def a10(spark, d):
    jobs = entity(spark, d, "recordings").select(c("id").alias("job"), c("id").alias("recording_id"))
    return table(spark, d, "events").select("event_id", (c("event_id") * 3).alias("job")).join(jobs, "job").select("event_id", "recording_id")


@query("a15_key_value_snapshot", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def a15(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return stores.snapshot(log, "user_id", "event_id", c("event_type") == "error").select("user_id", "value")


@query("a16_result_page", with_views("rooms", """, p AS (SELECT id, name FROM rooms ORDER BY name, id LIMIT 5 OFFSET 5)
SELECT '{"count":' || (SELECT count(*) FROM rooms) || ',"next":"/rooms?page=3","previous":"/rooms?page=1","results":[' || string_agg('{"id":' || id || ',"name":"' || name || '"}', ',' ORDER BY name, id) || ']}' AS document FROM p"""))
def a16(spark, d):
    return stores.result_page(entity(spark, d, "rooms").select("id", "name"), ["name", "id"], 2, 5, "/rooms")


_EVENT = "CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'stop' WHEN 'signup' THEN 'saved' WHEN 'purchase' THEN 'notified' ELSE 'external_ok' END"


@query("i1_event_router", with_views("meeting", "SELECT event_id, 'on_' || type AS handler FROM meeting WHERE type IN ('speech_start', 'chat_received') AND NOT starts_with('room' || participant, 'room1')"))
def i1(spark, d):
    from plenum.streaming.rooms import route

    rows = entity(spark, d, "meeting").select("event_id", c("type").alias("event"), F.concat(F.lit("room"), c("participant").cast("string")).alias("room_name"), F.lit(None).cast("string").alias("egress_room_name"))
    return route(rows, test_prefix="room1", known=("speech_start", "chat_received")).select("event_id", "handler")


_TRANSITIONS = ", ".join(f"('{a}', '{b}', '{to}')" for (a, b), to in lifecycle.TRANSITIONS.items())


@query("i2_recording_states", f"""WITH RECURSIVE t AS (SELECT * FROM (VALUES {_TRANSITIONS}) v(was, event, becomes)),
reached AS (SELECT DISTINCT event, becomes FROM t),
r AS (SELECT event_id // 10 AS recording, {_EVENT} AS event, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) AS n FROM events),
walk AS (SELECT DISTINCT recording, 0::BIGINT AS n, 'initiated' AS status, 0 AS illegal FROM r
  UNION ALL SELECT r.recording, r.n, coalesce(t.becomes, w.status), w.illegal + CASE WHEN t.becomes IS NULL AND q.event IS NULL THEN 1 ELSE 0 END
  FROM walk w JOIN r ON r.recording = w.recording AND r.n = w.n + 1 LEFT JOIN t ON t.was = w.status AND t.event = r.event LEFT JOIN reached q ON q.event = r.event AND q.becomes = w.status)
SELECT recording, arg_max(status, n) AS status, arg_max(illegal, n)::INTEGER AS illegal FROM walk GROUP BY recording""")
def i2(spark, d):
    rows = table(spark, d, "events").select(F.floor(c("event_id") / 10).alias("recording"), "event_id", F.expr(_EVENT).alias("event"))
    return lifecycle.run_states(rows, "recording", ["event_id"], "event")


@query("i3_egress_status", "SELECT event_id, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'saving' WHEN 'error' THEN 'aborted' END AS status FROM events")
def i3(spark, d):
    egress = F.when(c("event_type") == "view", "EGRESS_ACTIVE").when(c("event_type") == "click", "EGRESS_ENDING").when(c("event_type") == "error", "EGRESS_ABORTED").otherwise("EGRESS_OTHER")
    known = F.create_map(*[F.lit(x) for kv in lifecycle.EGRESS.items() for x in kv])
    return table(spark, d, "events").select("event_id", F.try_element_at(known, egress).alias("status"))


@query("i4_lobby_states", f"""WITH RECURSIVE r AS (SELECT user_id % 50 AS room, user_id, CASE WHEN event_type IN ('view', 'signup') THEN 'request' WHEN event_type = 'click' THEN 'accept' ELSE 'deny' END AS action,
  event_id * 2 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (SELECT DISTINCT room, user_id, 0::BIGINT AS n, 'unknown' AS status, 0::BIGINT AS until FROM r
  UNION ALL SELECT room, user_id, n, becomes, CASE WHEN becomes = live AND NOT (action = 'request' AND becomes = 'waiting') THEN until
    ELSE moment + CASE becomes WHEN 'accepted' THEN {lifecycle.ACCEPTED} WHEN 'denied' THEN {lifecycle.DENIED} ELSE {lifecycle.WAITING} END END
  FROM (SELECT *, CASE WHEN action = 'request' AND live IN ('unknown', 'waiting') THEN 'waiting' WHEN action = 'accept' AND live = 'waiting' THEN 'accepted' WHEN action = 'deny' AND live = 'waiting' THEN 'denied' ELSE live END AS becomes
    FROM (SELECT r.*, w.until, CASE WHEN w.until > r.moment THEN w.status ELSE 'unknown' END AS live FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)))
SELECT room, user_id, CASE WHEN arg_max(until, n) > 2000 THEN arg_max(status, n) ELSE 'unknown' END AS status FROM walk GROUP BY room, user_id""")
def i4(spark, d):
    kind = F.when(c("event_type").isin("view", "signup"), "request").when(c("event_type") == "click", "accept").otherwise("deny")
    rows = table(spark, d, "events").select((c("user_id") % 50).alias("room"), "user_id", "event_id", kind.alias("action"), (c("event_id") * 2).alias("at"))
    return lifecycle.lobby(rows, ["room", "user_id"], ["event_id"], "action", "at", F.lit(2000))


def _presence_rows(spark, d):
    kind = F.when(c("event_type") == "error", "left").when((c("event_type") == "purchase") & (c("event_id") % 40 == 0), "room_end").otherwise("seen")
    return table(spark, d, "events").select((c("user_id") % 50).alias("room"), c("user_id").alias("who"), kind.alias("kind"), (c("event_id") * 30).alias("at"))


_I5 = """WITH e AS (SELECT user_id % 50 AS room, user_id AS who, CASE WHEN event_type = 'error' THEN 'left' WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'room_end' ELSE 'seen' END AS kind, event_id * 30 AS moment FROM events),
r AS (SELECT room, max(moment) AS ended FROM e WHERE kind = 'room_end' GROUP BY 1)
SELECT e.room, who FROM e LEFT JOIN r USING (room) WHERE kind <> 'room_end' GROUP BY e.room, who, ended
HAVING max(moment) FILTER (kind = 'seen') > greatest(coalesce(max(moment) FILTER (kind = 'left'), -1), coalesce(ended, -1)) AND max(moment) FILTER (kind = 'seen') + 3600 > 30000"""


@query("i5_presence", _I5)
def i5(spark, d):
    return lifecycle.present(_presence_rows(spark, d), "room", "who", "kind", "at", F.lit(30_000))


@query("i6_room_end_eviction", """WITH e AS (SELECT user_id % 50 AS room, user_id AS who, CASE WHEN event_type = 'error' THEN 'left' WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'room_end' ELSE 'seen' END AS kind, event_id * 30 AS moment FROM events)
SELECT room, count(DISTINCT who) FILTER (moment < ended) AS evicted FROM e JOIN (SELECT room, max(moment) AS ended FROM e WHERE kind = 'room_end' GROUP BY 1) USING (room) GROUP BY room""")
def i6(spark, d):
    rows = _presence_rows(spark, d)
    ended = rows.where("kind = 'room_end'").groupBy("room").agg(F.max("at").alias("ended"))
    return rows.join(ended, "room").groupBy("room").agg(F.countDistinct(F.when(c("at") < c("ended"), c("who"))).alias("evicted"))


@query("i7_single_use_token", "SELECT event_id, CASE WHEN n = 1 THEN 'issued' WHEN n = 2 AND moment - first < 500 THEN 'consumed' WHEN n = 2 THEN 'expired' ELSE 'replay' END AS outcome FROM (SELECT event_id, event_id * 3 AS moment, row_number() OVER w AS n, first_value(event_id * 3) OVER w AS first FROM events WINDOW w AS (PARTITION BY event_id % 301 ORDER BY event_id))")
def i7(spark, d):
    rows = table(spark, d, "events").select((c("event_id") % 301).alias("token"), "event_id", (c("event_id") * 3).alias("at"))
    return lifecycle.single_use(rows, "token", ["event_id"], "at", 500).select("event_id", "outcome")


@query("i8_read_and_clear", "SELECT event_id, coalesce(was AND moment - before < 600, false) AS hit FROM (SELECT event_id, event_type = 'view' AS w, event_id * 10 AS moment, lag(event_type = 'view') OVER k AS was, lag(event_id * 10) OVER k AS before FROM events WINDOW k AS (PARTITION BY user_id ORDER BY event_id)) WHERE NOT w")
def i8(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", (c("event_id") * 10).alias("at"))
    return lifecycle.read_and_clear(rows, "user_id", ["event_id"], c("event_type") == "view", "at", 600).select("event_id", "hit")


@query("i9_utterances", with_views("meeting", """,
m AS (SELECT participant, event_id, type, row_number() OVER w AS n, sum(CASE WHEN type = 'speech_start' THEN 1 ELSE 0 END) OVER w AS utterance,
  last_value(CASE WHEN type = 'speech_start' THEN true WHEN type = 'speech_end' THEN false END IGNORE NULLS) OVER w AS live FROM meeting WINDOW w AS (PARTITION BY participant ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT participant, utterance, min(n) AS a, max(n) AS b FROM m WHERE utterance > 0 AND (live OR type = 'speech_end') GROUP BY ALL)
SELECT participant, s.utterance::BIGINT AS utterance, string_agg(event_id::VARCHAR, ' ' ORDER BY n) AS text FROM s JOIN m USING (participant)
WHERE n BETWEEN greatest(a - 5, 1) AND b AND type NOT IN ('speech_start', 'speech_end') GROUP BY participant, s.utterance"""))
def i9(spark, d):
    return lifecycle.utterances(entity(spark, d, "meeting").withColumn("text", c("event_id").cast("string")), "participant", ["ts", "event_id"], "type", "text", 5)


@query("i10_last_name", "SELECT user_id, arg_max(event_type, event_id) AS name, count(*) AS n FROM events GROUP BY user_id")
def i10(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("name"), F.count("*").alias("n"))


@query("i11_singleton_admission", with_views("meeting", "SELECT event_id, row_number() OVER (PARTITION BY day, participant ORDER BY event_id) = 1 AS admitted FROM meeting WHERE type = 'participant_connected'"))
def i11(spark, d):
    joins = entity(spark, d, "meeting").where("type = 'participant_connected'")
    first = joins.groupBy("day", "participant").agg(F.min("event_id").alias("first"))
    return joins.join(first, ["day", "participant"]).select("event_id", (c("event_id") == c("first")).alias("admitted"))


query("i12_in_flight_dedupe", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")(lambda s, d: table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")))


@query("i13_task_counters", "SELECT user_id, count(*) FILTER (event_type = 'error') AS retries, min(event_id) FILTER (event_type = 'signup') AS created_at, max(event_id) FILTER (event_type = 'purchase') AS captured_at, bool_or(event_type = 'purchase') AS done FROM events GROUP BY user_id")
def i13(spark, d):
    kind = F.when(c("event_type") == "error", "retry").when(c("event_type") == "signup", "create").when(c("event_type") == "purchase", "capture").otherwise("other")
    return lifecycle.task_counters(table(spark, d, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "kind", "event_id")


query("i14_delayed_action", f"SELECT event_id, {_AT} + 70 AS due_at FROM events WHERE {_AT} + 70 <= {_NOW}")(lambda s, d: table(s, d, "events").select("event_id", (_secs() + 70).alias("due_at")).where(c("due_at") <= _NOW))
query("i15_polling_ticks", f"SELECT {_AT} // 4 AS tick, count(*) AS n FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy(F.floor(_secs() / 4).alias("tick")).agg(F.count("*").alias("n")))
query("i16_connect_session", with_views("meeting", "SELECT participant, min(event_id) FILTER (type = 'participant_connected') AS first_connect, count(*) FILTER (type = 'participant_connected') AS connects FROM meeting GROUP BY participant"))(lambda s, d: entity(s, d, "meeting").groupBy("participant").agg(F.min(F.when(c("type") == "participant_connected", c("event_id"))).alias("first_connect"), F.count_if(c("type") == "participant_connected").alias("connects")))
query("i17_fixed_lifetime", "SELECT event_id FROM events WHERE event_id * 10 + 3000 > 5000")(lambda s, d: table(s, d, "events").where((c("event_id") * 10 + 3000) > 5000).select("event_id"))
query("i18_backoff", "SELECT event_id, least(0.5 * pow(2.0, event_id % 9), 30.0)::DOUBLE AS wait FROM events")(lambda s, d: table(s, d, "events").select("event_id", lifecycle.backoff(c("event_id") % 9 + 1, 0.5, 30.0).alias("wait")))
query("i19_recording_view", with_views("recordings", "SELECT id, status = 'initiated' OR (status = 'active' AND id % 2 > 0) AS starting, status = 'active' AND id % 2 = 0 AS started, status = 'stopped' AS saving, status IN ('initiated', 'active', 'stopped') AS active, mode FROM recordings"))(lambda s, d: entity(s, d, "recordings").select("id", lifecycle.recording_view(c("status"), c("mode"), c("id") % 2 == 0).alias("v")).select("id", "v.*"))
