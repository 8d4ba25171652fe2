"""Speech intervals, speaker matching and runs of rows over the meeting events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import counters, intervals, islands, ratelimit
from plenum.plans.analogues import entity, recursive, with_views
from plenum.plans.registry import query
from plenum.sources.folders import kept
from plenum.sources.tables import table

DAY_MS = 86_400_000


def speech(spark, d):
    events = entity(spark, d, "meeting")
    return intervals.pair_events(events, ["day", "participant"], ["ts", "event_id"], F.col("type") == "speech_start", F.col("type") == "speech_end", "ms", F.lit(DAY_MS).cast("long")).withColumn("day", F.col("day").cast("string"))


def presence(spark, d):
    """Connected times, paired like speech, as a second set of intervals."""
    events = entity(spark, d, "meeting")
    return intervals.pair_events(events, ["day", "participant"], ["ts", "event_id"], F.col("type") == "participant_connected", F.col("type") == "participant_disconnected", "ms", F.lit(DAY_MS).cast("long")).withColumn("day", F.col("day").cast("string"))


def _pairs(name: str, start: str, end: str) -> str:
    return f""",
{name}_seq AS (SELECT day::VARCHAR AS day, participant, type, ms, lag(type) OVER w AS was, lag(ms) OVER w AS was_ms, lead(1) OVER w IS NULL AS last
  FROM meeting WHERE type IN ('{start}', '{end}') WINDOW w AS (PARTITION BY day, participant ORDER BY ts, event_id)),
{name} AS (SELECT day, participant, CASE WHEN type = '{end}' THEN was_ms ELSE ms END AS start, CASE WHEN type = '{end}' THEN ms ELSE {DAY_MS} END AS "end", type = '{end}' AS closed
  FROM {name}_seq WHERE ((type = '{end}' AND was = '{start}') OR (type = '{start}' AND last)) AND CASE WHEN type = '{end}' THEN ms ELSE {DAY_MS} END > CASE WHEN type = '{end}' THEN was_ms ELSE ms END)"""


def _merged(name: str, source: str) -> str:
    return f""",
{name} AS (SELECT day, participant, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY day, participant ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY day, participant ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS fresh FROM {source}))
  GROUP BY day, participant, island)"""


_SPEECH = _pairs("speech", "speech_start", "speech_end")
_PRESENT = _pairs("present", "participant_connected", "participant_disconnected")


@query("f14_event_pairing", with_views("meeting", _SPEECH + ' SELECT day, participant, start, "end", closed FROM speech'))
def f14(spark, d):
    return speech(spark, d)


@query("f13_interval_merge", with_views("meeting", _SPEECH + _merged("merged", "speech") + ' SELECT day, participant, start, "end" FROM merged'))
def f13(spark, d):
    return intervals.merge(speech(spark, d), ["day", "participant"])


@query("f13_interval_merge_by_day", with_views("meeting", _SPEECH + _merged("merged", "(SELECT day, 0 AS participant, start, \"end\" FROM speech)") + ' SELECT day, start, "end" FROM merged'))
def f13_day(spark, d):
    """When anyone speaks: a day's intervals, however many, merged over all people."""
    return intervals.merge(speech(spark, d), ["day"], large=True)


_TOTAL = _SPEECH + _merged("merged", "speech") + ', total AS (SELECT day, participant, sum("end" - start)::BIGINT AS total FROM merged GROUP BY ALL)'


@query("f14_speech_time", with_views("meeting", _TOTAL + " SELECT * FROM total"))
def speech_time(spark, d):
    return intervals.total(intervals.merge(speech(spark, d), ["day", "participant"]), ["day", "participant"])


@query("d18_interval_total", with_views("meeting", _SPEECH + ' SELECT day, sum("end" - start)::BIGINT AS total FROM speech GROUP BY day'))
def d18(spark, d):
    return intervals.total(speech(spark, d), ["day"])


_OVERLAP = _TOTAL + _PRESENT + _merged("attended", "present") + """,
lap AS (SELECT s.day, s.participant AS speaker, p.participant AS attendee, sum(least(s."end", p."end") - greatest(s.start, p.start))::BIGINT AS overlap
  FROM merged s JOIN attended p ON s.day = p.day AND s.start < p."end" AND p.start < s."end" GROUP BY ALL)"""


def _sides(spark, d):
    """Who speaks when, and who is there."""
    said = intervals.merge(speech(spark, d), ["day", "participant"]).withColumnRenamed("participant", "speaker")
    there = intervals.merge(presence(spark, d), ["day", "participant"]).withColumnRenamed("participant", "attendee")
    return kept(said), kept(there)


@query("e11_interval_overlap_join", with_views("meeting", _OVERLAP + " SELECT * FROM lap"))
def e11(spark, d):
    return intervals.overlap(*_sides(spark, d), ["day"], "speaker", "attendee", DAY_MS)


@query("e12_best_match", with_views("meeting", _OVERLAP + """
SELECT day, speaker, attendee, score FROM (SELECT o.day, speaker, attendee, overlap / total AS score, row_number() OVER (PARTITION BY o.day, speaker ORDER BY overlap / total DESC, attendee) AS n
FROM lap o JOIN total t ON o.day = t.day AND o.speaker = t.participant) WHERE n = 1 AND score >= 0.5"""))
def e12(spark, d):
    return intervals.best_matches(*_sides(spark, d), ["day"], "speaker", "attendee", ["attendee"], DAY_MS)


@query("f16_time_slices", with_views("meeting", _SPEECH + _merged("merged", "speech") + """,
bounds AS (SELECT day, moment, lead(moment) OVER (PARTITION BY day ORDER BY moment) AS next FROM (SELECT day, start AS moment FROM merged UNION SELECT day, "end" FROM merged))
SELECT b.day, moment AS start, next AS "end", count(DISTINCT m.participant) AS n_active, coalesce(string_agg(DISTINCT m.participant::VARCHAR, ',' ORDER BY m.participant::VARCHAR), '') AS active
FROM bounds b LEFT JOIN merged m ON m.day = b.day AND m.start <= moment AND m."end" >= next WHERE next IS NOT NULL GROUP BY b.day, moment, next"""))
def f16(spark, d):
    return intervals.slice_texts(speech(spark, d).withColumn("participant", F.col("participant").cast("string")), ["day"], "participant")


_WORDS = """
, words AS (SELECT conv_id, turn, list_transform(range(len(w)), lambda i: {'s': i * 0.5, 'e': i * 0.5 + CASE WHEN length(w[i + 1]) > 7 THEN 1.5 ELSE 0.25 END}) AS w
  FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)),
each AS (SELECT conv_id, turn, unnest(range(len(w))) AS i, w FROM words),
runs AS (SELECT conv_id, turn, i, w[i + 1].s AS s, w[i + 1].e AS e, coalesce(sum(CASE WHEN w[i + 1].e - w[i + 1].s > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM each)
SELECT conv_id, turn, CASE WHEN run = 0 THEN 0.0 ELSE arg_min(s, i) END::DOUBLE AS start, least(arg_max(e, i), arg_max(s, i) + 1.0)::DOUBLE AS "end" FROM runs GROUP BY conv_id, turn, run
HAVING least(arg_max(e, i), arg_max(s, i) + 1.0) > CASE WHEN run = 0 THEN 0.0 ELSE arg_min(s, i) END"""


@query("f15_word_runs", "WITH one AS (SELECT 1)" + _WORDS)
def f15(spark, d):
    w = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (i * 0.5).cast("double").alias("start"), (i * 0.5 + F.when(F.length(w) > 7, 1.5).otherwise(0.25)).cast("double").alias("end")))
    segments = table(spark, d, "conversations").select("conv_id", "turn", F.lit(0.0).alias("start"), F.lit(1000.0).alias("end"), w.alias("words"))
    return intervals.word_runs(segments, ["conv_id", "turn"])


@query("f10_islands", with_views("meeting", """
SELECT participant, island::BIGINT AS island, min(type) AS type, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY participant ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN type = lag(type) OVER (PARTITION BY participant ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM meeting)) GROUP BY participant, island"""))
def f10(spark, d):
    runs = islands.islands(entity(spark, d, "meeting"), ["participant"], ["ts", "event_id"], "type")
    return runs.groupBy("participant", "island").agg(F.min("type").alias("type"), F.count("*").alias("n"))


@query("f10_speaker_text", """
SELECT conv_id, string_agg(CASE WHEN fresh THEN chr(10) || chr(10) || ' **' || role || '**: ' || text ELSE ' ' || text END, '' ORDER BY turn) AS text
FROM (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS fresh FROM conversations WHERE text <> '') GROUP BY conv_id""")
def f10_text(spark, d):
    return islands.speaker_text(table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text"), ["conv_id"], ["turn"])


@query("f11_caption_rows", with_views("meeting", """
SELECT day::VARCHAR AS day, min(event_id) AS row_id, min(participant) AS participant, max(ms) AS last_received FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY day ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN participant = lag(participant) OVER (PARTITION BY day ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM meeting)) GROUP BY day, island"""))
def f11(spark, d):
    rows = entity(spark, d, "meeting").select(F.col("day").cast("string").alias("day"), "event_id", F.col("event_id").alias("id"), "participant", F.col("type").alias("text"), F.col("ms").alias("last_received"))
    return islands.caption_rows(rows, ["day"], ["event_id"]).drop("text")


@query("f12_upsert_in_place", with_views("meeting", """
SELECT participant, type, max(event_id) AS event_id, arg_max(ms, event_id) AS ms, min(event_id) AS place FROM meeting GROUP BY participant, type"""))
def f12(spark, d):
    rows = entity(spark, d, "meeting").select("participant", "type", "event_id", "ms")
    return islands.upsert(rows.withColumn("seq", F.col("event_id")), ["participant", "type"], "seq").drop("seq")


@query("f17_label_suffix", """
SELECT c_custkey, name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN ' (' || c_custkey || ')' ELSE '' END AS label FROM (SELECT c_custkey, c_mktsegment || ' ' || (c_custkey % 400) AS name FROM customer)""")
def f17(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 400).cast("string")).alias("name"))
    shared = rows.groupBy("name").agg((F.count("*") > 1).alias("shared"))  # counts first, so a name many share isn't gathered
    return rows.join(shared, "name").select("c_custkey", F.concat("name", F.when(F.col("shared"), F.concat(F.lit(" ("), F.col("c_custkey").cast("string"), F.lit(")"))).otherwise("")).alias("label"))


@query("f18_silence_check", with_views("meeting", """,
s AS (SELECT participant, event_id, ts, value < 60 AS silent, day, 2000 AS delta FROM meeting),
h AS (SELECT *, max(CASE WHEN silent THEN 0 ELSE 1 END) OVER w AS heard, CASE WHEN day = lag(day) OVER w2 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY participant ORDER BY event_id ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY participant ORDER BY event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY participant ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM h),
a AS (SELECT *, sum(CASE WHEN heard = 0 THEN delta ELSE 0 END) OVER (PARTITION BY participant, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM i)
SELECT participant, CASE WHEN min(event_id) FILTER (heard = 0 AND total >= 4000) IS NOT NULL THEN 'silent' WHEN max(heard) = 1 THEN 'passed' ELSE 'pending' END AS status,
  min(event_id) FILTER (heard = 0 AND total >= 4000) AS tripped_at FROM a GROUP BY participant"""))
def f18(spark, d):
    rows = entity(spark, d, "meeting").select("participant", "event_id", F.col("day").cast("string").alias("track"), (F.col("value") < 60).alias("silent"), F.lit(2000).alias("delta"))
    return islands.silence(rows, ["participant"], ["event_id"], "track", F.col("silent"), "delta", 4000)


_SEQ = "(PARTITION BY participant ORDER BY ts, event_id)"


@query("f5_lag_delta", with_views("meeting", f"SELECT event_id, round(coalesce(value - lag(value) OVER {_SEQ}, 0), 6) AS delta FROM meeting"))
def f5(spark, d):
    return counters.delta(entity(spark, d, "meeting"), ["participant"], ["ts", "event_id"], "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("f6_counter_rate", with_views("meeting", f"""
SELECT event_id, floor(CASE WHEN dt > 0 THEN greatest(0, dv * 8 / dt) ELSE 0 END * 1000000000 + 0.5)::BIGINT AS nano_kbps FROM (
SELECT event_id, coalesce(value - lag(value) OVER {_SEQ}, 0) AS dv, coalesce((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER {_SEQ}, 0) AS dt FROM meeting)"""))
def f6(spark, d):
    rows = entity(spark, d, "meeting").withColumn("at", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return counters.rate(rows, ["participant"], ["ts", "event_id"], "value", "at").select("event_id", F.floor(F.col("kbps") * 1_000_000_000 + 0.5).alias("nano_kbps"))


@query("f7_ring_buffer", with_views("meeting", "SELECT participant, event_id FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY ts DESC, event_id DESC) AS n FROM meeting) WHERE n <= 60"))
def f7(spark, d):
    return counters.latest(entity(spark, d, "meeting"), ["participant"], ["ts", "event_id"], 60).select("participant", "event_id")


@query("f8_pre_roll", with_views("meeting", """
SELECT event_id, chunks FROM (SELECT event_id, type, array_to_string(list(event_id::VARCHAR) OVER (PARTITION BY participant ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS chunks FROM meeting) WHERE type = 'speech_start'"""))
def f8(spark, d):
    rows = counters.pre_roll(entity(spark, d, "meeting"), ["participant"], ["ts", "event_id"], "event_id", 5)
    return rows.where("type = 'speech_start'").select("event_id", F.array_join(F.transform("pre_roll", lambda x: x.cast("string")), ",").alias("chunks"))


@query("f9_running_text", "SELECT conv_id, turn, string_agg(role, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS interim FROM conversations")
def f9(spark, d):
    return counters.running_text(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", F.col("running").alias("interim"))


@query("f4_queue_position", with_views("meeting", "SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY ts, participant, event_id) AS position FROM meeting WHERE type = 'chat_received'"))
def f4(spark, d):
    return counters.queue(entity(spark, d, "meeting").where("type = 'chat_received'"), ["day"], ["ts", "participant", "event_id"]).select("event_id", F.col("position").cast("long").alias("position"))


_CALLS = "r AS (SELECT participant, event_id, epoch_us(ts) // 1000 AS moment, row_number() OVER (PARTITION BY participant ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM meeting)"


@query("f19_sliding_rate_limit", recursive("meeting", f""", {_CALLS},
walk AS (SELECT participant, event_id, n, [moment] AS held, true AS accepted FROM r WHERE n = 1
  UNION ALL SELECT participant, event_id, n, CASE WHEN len(live) < 3 THEN list_append(live, moment) ELSE live END, len(live) < 3
  FROM (SELECT r.*, list_filter(w.held, lambda x: x > r.moment - 86400000) AS live FROM walk w JOIN r ON r.participant = w.participant AND r.n = w.n + 1))
SELECT participant, event_id, accepted FROM walk"""))
def f19(spark, d):
    rows = entity(spark, d, "meeting").select("participant", "event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"))
    return ratelimit.sliding(rows, "participant", "at", "event_id", most=3, window=86_400_000)


@query("f20_anchored_rate_limit", recursive("meeting", f""", {_CALLS},
walk AS (SELECT participant, event_id, n, moment AS opened, 1 AS calls FROM r WHERE n = 1
  UNION ALL SELECT r.participant, r.event_id, r.n, CASE WHEN r.moment - w.opened >= 86400000 THEN r.moment ELSE w.opened END, CASE WHEN r.moment - w.opened >= 86400000 THEN 1 ELSE w.calls + 1 END
  FROM walk w JOIN r ON r.participant = w.participant AND r.n = w.n + 1)
SELECT participant, event_id, calls <= 2 AS accepted FROM walk"""))
def f20(spark, d):
    rows = entity(spark, d, "meeting").select("participant", "event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"))
    return ratelimit.anchored(rows, "participant", "at", "event_id", most=2, window=86_400_000)
