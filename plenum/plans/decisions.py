"""Decisions that hang on what came before: admissions and departures, rates by scope, replays, the first of equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import intervals, lifecycle, ratelimit
from plenum.plans.analogues import entity, recursive, with_views
from plenum.plans.registry import query
from plenum.plans.speech import _OVERLAP, DAY_MS, _sides, presence
from plenum.sources import stores
from plenum.sources.tables import table

c = F.col


@query("e12_best_match_first_closed", with_views("meeting", _OVERLAP + """,
first AS (SELECT day, participant AS attendee, min("end") FILTER (closed) AS heard FROM present GROUP BY ALL)
SELECT day, speaker, attendee, score FROM (SELECT o.day, speaker, o.attendee, overlap / total AS score, row_number() OVER (PARTITION BY o.day, speaker ORDER BY overlap / total DESC, heard NULLS LAST, o.attendee) AS n
FROM lap o JOIN total t ON o.day = t.day AND o.speaker = t.participant JOIN first f ON f.day = o.day AND f.attendee = o.attendee) WHERE n = 1 AND score >= 0.5"""))
def e12_first(spark, d):
    """Of equal shares the attendee whose interval was closed first wins; those whose intervals nothing closed come last."""
    said, there = _sides(spark, d)
    heard = F.coalesce(F.min(F.when(c("closed"), c("end"))), F.lit((1 << 63) - 1))
    first = presence(spark, d).groupBy("day", c("participant").alias("attendee")).agg(heard.alias("heard"))
    return intervals.best_matches(said, there.join(first, ["day", "attendee"]), ["day"], "speaker", "attendee", ["heard", "attendee"], DAY_MS)


_RATES, _WEEK = {"request_entry": 5, "creation_callback": 4, "roomkit_join": 3, "connection_test": 2}, 7 * 86_400_000
_SCOPE = "CASE event_type WHEN 'view' THEN 'request_entry' WHEN 'click' THEN 'creation_callback' WHEN 'signup' THEN 'roomkit_join' WHEN 'purchase' THEN 'connection_test' ELSE 'other' END"


@query("f19_rate_limit_scopes", f"""WITH RECURSIVE e AS (SELECT {_SCOPE} AS scope, CASE WHEN event_id % 7 > 0 THEN user_id % 50 END AS who, event_id, epoch_us(ts) // 1000 AS moment FROM events),
rates AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {n})" for k, n in _RATES.items())}) v(scope, rate)),
r AS (SELECT e.*, rate, row_number() OVER (PARTITION BY scope, who ORDER BY moment, event_id) AS n FROM e JOIN rates USING (scope) WHERE who IS NOT NULL),
walk AS (SELECT scope, who, event_id, n, [moment] AS held, true AS accepted FROM r WHERE n = 1
  UNION ALL SELECT scope, who, event_id, n, CASE WHEN len(live) < rate THEN list_append(live, moment) ELSE live END, len(live) < rate
  FROM (SELECT r.*, list_filter(w.held, lambda x: x > r.moment - {_WEEK}) AS live FROM walk w JOIN r ON r.scope = w.scope AND r.who = w.who AND r.n = w.n + 1))
SELECT scope, who, event_id, accepted FROM walk UNION ALL SELECT scope, who, event_id, true FROM e WHERE who IS NULL OR scope = 'other'""")
def f19_scopes(spark, d):
    rows = table(spark, d, "events").select(F.expr(_SCOPE).alias("scope"), F.when(c("event_id") % 7 > 0, c("user_id") % 50).alias("who"), "event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"))
    return ratelimit.by_scope(rows, "scope", "who", "at", "event_id", _RATES, _WEEK)


@query("i7_replay_revokes", "SELECT event_id % 301 AS token, count(*) > 2 AS revoked FROM events GROUP BY 1")
def i7_revoked(spark, d):
    rows = table(spark, d, "events").select((c("event_id") % 301).alias("token"), "event_id", (c("event_id") * 3).alias("at"))
    return lifecycle.revoked_sessions(lifecycle.single_use(rows, "token", ["event_id"], "at", 500), "token")


@query("i11_admission_with_departures", recursive("meeting", """,
r AS (SELECT day, participant, event_id, type = 'participant_connected' AS joins, row_number() OVER (PARTITION BY day, participant ORDER BY event_id) AS n FROM meeting WHERE type IN ('participant_connected', 'participant_disconnected')),
walk AS (SELECT day, participant, event_id, n, joins, joins AS present, joins AS admitted FROM r WHERE n = 1
  UNION ALL SELECT r.day, r.participant, r.event_id, r.n, r.joins, r.joins, r.joins AND NOT w.present FROM walk w JOIN r ON r.day = w.day AND r.participant = w.participant AND r.n = w.n + 1)
SELECT event_id, admitted FROM walk WHERE joins"""))
def i11_departures(spark, d):
    meeting = entity(spark, d, "meeting")
    return lifecycle.admissions(meeting, ["day", "participant"], ["event_id"], c("type") == "participant_connected", c("type") == "participant_disconnected").select("event_id", "admitted")


@query("i12_in_flight_sessions", """WITH RECURSIVE r AS (SELECT user_id, event_id, event_type = 'view' AS starts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'purchase', 'error')),
walk AS (SELECT user_id, event_id, n, starts, starts AS running, starts AS started FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, r.starts, r.starts, r.starts AND NOT w.running FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT event_id, started FROM walk WHERE starts""")
def i12_sessions(spark, d):
    """A session starts at a view, unless one of the user runs; a purchase or an error ends it."""
    events = table(spark, d, "events")
    return lifecycle.admissions(events, ["user_id"], ["event_id"], c("event_type") == "view", c("event_type").isin("purchase", "error")).select("event_id", c("admitted").alias("started"))


@query("a15_multi_get", "SELECT c_custkey AS user_id, value FROM customer LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error') ON user_id = c_custkey")
def a15_many(spark, d):
    """Every customer's stored value, null where nothing is stored."""
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    live = stores.snapshot(log, "user_id", "event_id", c("event_type") == "error").select("user_id", "value")
    return stores.many(live, table(spark, d, "customer").select(c("c_custkey").alias("user_id")), "user_id")
