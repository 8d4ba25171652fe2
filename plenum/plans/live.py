"""State machines over the event table: walked in batch, and as streams whose final states are those of the walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import lifecycle, machines
from plenum.plans import decisions, lifecycle as snapshots, speech  # noqa: F401  their SQL twins are used here
from plenum.plans.analogues import entity
from plenum.plans.registry import ORACLE_SQL, query
from plenum.plans.streams import _drained, _stream
from plenum.sources.tables import table
from plenum.streaming import machines as live

c = F.col
_US = machines.SECOND


def _run(spark, rows: DataFrame, name: str) -> DataFrame:
    with live.rocksdb(spark):
        return _drained(spark, rows, name)


def _timed(rows: DataFrame, moment) -> DataFrame:
    """`rows` with `moment` in microseconds, and a second later the event time `at`: a stream takes nothing of the epoch's first millisecond."""
    return rows.withColumn("moment", moment).withColumn("at", F.timestamp_micros(c("moment") + _US))


@query("i2_recording_stream", ORACLE_SQL["i2_recording_states"])
def i2_stream(spark, d):
    rows = _timed(_stream(spark, d).select(F.floor(c("event_id") / 10).alias("recording"), "event_id", F.expr(snapshots._EVENT).alias("event")), c("event_id") * _US)
    seen = _run(spark, live.run(rows, ["recording"], ["event_id"], machines.Recording("event", "moment"), "at"), "recordings")
    return seen.groupBy("recording").agg(F.max_by(F.struct("status", "illegal"), "n").alias("s")).select("recording", "s.status", "s.illegal")


@query("i2_recording_walk", ORACLE_SQL["i2_recording_states"])
def i2_walk(spark, d):
    """The same in batch: a recording's events are walked in sorted batches, and no history is gathered."""
    rows = table(spark, d, "events").select(F.floor(c("event_id") / 10).alias("recording"), "event_id", F.expr(snapshots._EVENT).alias("event"))
    return machines.walk(rows, ["recording"], ["event_id"], machines.Recording("event", "event_id")).select("recording", "status", "illegal")


def _lobby(spark, d, action, room: int, moment) -> DataFrame:
    rows = _stream(spark, d).select((c("user_id") % room).cast("string").alias("room"), c("user_id").cast("string").alias("who"), "event_id", action.alias("action"))
    return _run(spark, live.lobby(_timed(rows, moment), ["event_id"]), "lobby")


@query("i4_lobby_stream", ORACLE_SQL["i4_lobby_states"])
def i4_stream(spark, d):
    """Each participant's entry as of 2,000 seconds, from the last of the stream's rows."""
    kind = F.when(c("event_type").isin("view", "signup"), "request").when(c("event_type") == "click", "accept").otherwise("deny")
    seen = _lobby(spark, d, kind, 50, c("event_id") * (2 * _US))
    last = seen.groupBy("room", "who").agg(F.max_by(F.struct("status", "until"), "id").alias("s"))
    return last.select(c("room").cast("long").alias("room"), c("who").cast("long").alias("user_id"), F.when(c("s.until") > 2000 * _US, c("s.status")).otherwise("unknown").alias("status"))


@query("i4_lobby_index_stream", f"""WITH RECURSIVE e AS (SELECT user_id % 10 AS room, user_id, event_id, event_id * 200000 AS moment,
  CASE WHEN event_type IN ('view', 'signup') THEN 'request' WHEN event_type = 'click' THEN 'accept' WHEN event_type = 'purchase' THEN 'deny' ELSE 'list' END AS action FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e WHERE action <> 'list'),
walk AS (SELECT DISTINCT room, user_id, 0::BIGINT AS n, -1::BIGINT AS moment, 'unknown' AS status, 0::BIGINT AS until FROM r
  UNION ALL SELECT room, user_id, n, moment, becomes, CASE WHEN becomes = live AND NOT (action = 'request' AND becomes = 'waiting') THEN until
    ELSE moment + {_US}::BIGINT * CASE becomes WHEN 'accepted' THEN {lifecycle.ACCEPTED} WHEN 'denied' THEN {lifecycle.DENIED} ELSE {lifecycle.WAITING} END END
  FROM (SELECT *, CASE WHEN action = 'request' AND live IN ('unknown', 'waiting') THEN 'waiting' WHEN action = 'accept' AND live = 'waiting' THEN 'accepted' WHEN action = 'deny' AND live = 'waiting' THEN 'denied' ELSE live END AS becomes
    FROM (SELECT r.*, w.until, CASE WHEN w.until > r.moment THEN w.status ELSE 'unknown' END AS live FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1))),
span AS (SELECT *, lead(moment) OVER (PARTITION BY user_id ORDER BY n) AS next FROM walk)
SELECT event_id, coalesce(string_agg(s.user_id::VARCHAR, ',' ORDER BY s.user_id::VARCHAR) FILTER (s.status = 'waiting'), '') AS waiting, count(s.user_id) AS members
FROM e LEFT JOIN span s ON s.room = e.room AND s.moment <= e.moment AND (s.next IS NULL OR s.next > e.moment) AND s.until > e.moment WHERE action = 'list' GROUP BY event_id""")
def i4_index(spark, d):
    """What each reading of a room's index finds: who waits, and how many members have an entry left."""
    kind = F.when(c("event_type").isin("view", "signup"), "request").when(c("event_type") == "click", "accept").when(c("event_type") == "purchase", "deny").otherwise("list")
    return _lobby(spark, d, kind, 10, c("event_id") * 200_000).where("status = 'listed'").select(c("id").alias("event_id"), "waiting", "members")


_LIFE, _BUCKET = 3600 * _US, 60 * _US


@query("i5_presence_stream", f"""WITH e AS (SELECT 'room' || user_id % 50 AS room, user_id::VARCHAR AS who, epoch_us(ts) AS moment, event_id,
  CASE WHEN event_type = 'error' THEN 'left' WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'room_end' ELSE 'seen' END AS kind FROM events),
own AS (SELECT room, who, moment, event_id, kind FROM e WHERE kind <> 'room_end'
  UNION ALL SELECT p.room, p.who, e.moment, e.event_id, 'left' FROM e JOIN (SELECT DISTINCT room, who FROM e WHERE kind <> 'room_end') p ON p.room = e.room WHERE kind = 'room_end'),
seq AS (SELECT *, lag(kind) OVER w AS was, lag(moment) OVER w AS was_at, lead(moment) OVER w AS next_at FROM own WINDOW w AS (PARTITION BY room, who ORDER BY moment, event_id)),
mark AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS at FROM events)
SELECT room, who, status, moment / 1e6 AS at FROM (SELECT room, who, 'in' AS status, moment FROM seq WHERE kind = 'seen' AND NOT coalesce(was = 'seen' AND moment < was_at + {_LIFE}, false)
UNION ALL SELECT room, who, 'out', moment FROM seq WHERE kind = 'left' AND was = 'seen' AND moment < was_at + {_LIFE}
UNION ALL SELECT room, who, 'expired', moment + {_LIFE} FROM seq, mark WHERE kind = 'seen' AND (next_at >= moment + {_LIFE} OR next_at IS NULL AND ((moment + {_LIFE}) // {_BUCKET} + 1) * {_BUCKET} <= mark.at))""")
def i5_stream(spark, d):
    """Who comes, goes and is no more seen. Those whose minute hasn't passed by the last watermark are still in."""
    kind = F.when(c("event_type") == "error", "left").when((c("event_type") == "purchase") & (c("event_id") % 40 == 0), "room_end").otherwise("seen")
    rows = _stream(spark, d).select(F.concat(F.lit("room"), (c("user_id") % 50).cast("string")).alias("room"), c("user_id").cast("string").alias("who"), kind.alias("kind"), "event_id", F.unix_micros("at").alias("moment"), "at")
    return _run(spark, live.presence(rows, ["moment", "event_id"]), "moves").select("room", "who", "status", (c("moment") / 1e6).alias("at"))


_SESSION_EVENTS = "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'init' ELSE 'poll' END WHEN 'signup' THEN 'authenticate' WHEN 'purchase' THEN 'poll' ELSE 'consume' END"
_SESSIONS = f"""WITH RECURSIVE r AS (SELECT user_id % 100 AS session, event_id, event_id * {_US} AS moment, {_SESSION_EVENTS} AS kind, row_number() OVER (PARTITION BY user_id % 100 ORDER BY event_id) AS n FROM events),
walk AS (SELECT DISTINCT session, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'none' AS token, 0::BIGINT AS token_until, 'none' AS state, 0::BIGINT AS state_until, NULL::VARCHAR AS outcome FROM r
  UNION ALL SELECT session, n, event_id,
    CASE kind WHEN 'init' THEN 'pending' WHEN 'consume' THEN CASE t WHEN 'pending' THEN 'consumed' ELSE t END ELSE t END,
    CASE WHEN kind = 'init' THEN moment + {machines.TRANSIT * _US} WHEN kind = 'consume' AND t = 'pending' THEN moment + {machines.SESSION * _US} ELSE token_until END,
    CASE kind WHEN 'init' THEN 'pending' WHEN 'consume' THEN CASE t WHEN 'consumed' THEN 'none' ELSE s END WHEN 'authenticate' THEN CASE WHEN s = 'pending' AND t = 'consumed' THEN 'authenticated' ELSE 'none' END
      ELSE CASE s WHEN 'authenticated' THEN 'none' ELSE s END END,
    CASE WHEN kind = 'init' THEN moment + {machines.SESSION * _US} ELSE state_until END,
    CASE kind WHEN 'init' THEN 'made' WHEN 'consume' THEN CASE t WHEN 'none' THEN 'unknown' WHEN 'pending' THEN 'consumed' ELSE 'replay' END
      WHEN 'authenticate' THEN CASE WHEN s = 'none' THEN 'not_found' WHEN s = 'pending' AND t = 'consumed' THEN 'authenticated' ELSE 'suspicious' END ELSE CASE s WHEN 'none' THEN 'not_found' ELSE s END END
  FROM (SELECT r.*, w.token_until, w.state_until, CASE WHEN w.token_until > r.moment THEN w.token ELSE 'none' END AS t, CASE WHEN w.state_until > r.moment THEN w.state ELSE 'none' END AS s
    FROM walk w JOIN r ON r.session = w.session AND r.n = w.n + 1))
SELECT session, event_id AS id, outcome FROM walk WHERE n > 0"""


@query("i7_sessions", _SESSIONS)
def i7_sessions(spark, d):
    """What comes of each call: a token that is used twice evicts its session, so that later calls don't find it."""
    rows = table(spark, d, "events").select((c("user_id") % 100).alias("session"), "event_id", F.expr(_SESSION_EVENTS).alias("kind"), (c("event_id") * _US).alias("moment"))
    return machines.walk(rows, ["session"], ["event_id"], machines.Session("kind", "event_id", "moment"))


@query("i7_session_stream", _SESSIONS)
def i7_stream(spark, d):
    rows = _timed(_stream(spark, d).select((c("user_id") % 100).alias("session"), "event_id", F.expr(_SESSION_EVENTS).alias("kind")), c("event_id") * _US)
    return _run(spark, live.run(rows, ["session"], ["event_id"], machines.Session("kind", "event_id", "moment"), "at"), "sessions")


def _calls(spark, d) -> DataFrame:
    rows = _stream(spark, d).select(c("user_id").alias("participant"), "event_id", "at")
    return rows.withColumn("moment", F.unix_millis("at"))


@query("f19_rate_limit_stream", ORACLE_SQL["f19_sliding_rate_limit"])
def f19_stream(spark, d):
    limit = machines.Sliding("event_id", "moment", 3, 86_400_000)
    limit.due = lambda state: None  # these times are milliseconds; the log is trimmed by the next call
    return _run(spark, live.run(_calls(spark, d), ["participant"], ["moment", "event_id"], limit, "at"), "sliding").select("participant", c("id").alias("event_id"), "accepted")


@query("f20_rate_limit_stream", ORACLE_SQL["f20_anchored_rate_limit"])
def f20_stream(spark, d):
    limit = machines.Anchored("event_id", "moment", 2, 86_400_000)
    limit.due = lambda state: None
    return _run(spark, live.run(_calls(spark, d), ["participant"], ["moment", "event_id"], limit, "at"), "anchored").select("participant", c("id").alias("event_id"), "accepted")


def _due(spark, d, wait: int, name: str) -> DataFrame:
    rows = _stream(spark, d).select("user_id", "event_id", F.unix_micros("at").alias("moment"), "at")
    return _run(spark, live.run(rows, ["user_id"], ["moment", "event_id"], machines.Delayed("event_id", "moment", wait), "at"), name).select(c("id").alias("event_id"), "due_at")


def _due_sql(wait: int) -> str:
    return f"SELECT event_id, epoch_us(ts) + {wait} AS due_at FROM events, (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS mark FROM events) WHERE epoch_us(ts) + {wait} <= mark"


@query("i14_delayed_stream", _due_sql(70 * _US))
def i14_stream(spark, d):
    """Actions that fire 70 seconds after their event, as the watermark passes."""
    return _due(spark, d, 70 * _US, "delayed")


@query("i17_lifetime_stream", _due_sql(3000 * _US))
def i17_stream(spark, d):
    """Rows that end 3,000 seconds after they were made."""
    return _due(spark, d, 3000 * _US, "lifetimes")


_KIND18 = "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'send' WHEN event_type = 'purchase' THEN 'ack' ELSE 'lost' END"
_REPLAY = f"""WITH RECURSIVE r AS (SELECT user_id, event_id, event_id * 100000 AS moment, {_KIND18} AS kind, event_id % 40 AS upto, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 1::BIGINT AS after, []::BIGINT[] AS waiting, 0 AS attempts, 0::BIGINT AS open_at, []::STRUCT(number BIGINT, again BOOLEAN, sent_at BIGINT)[] AS sent FROM r
  UNION ALL SELECT user_id, n, event_id, CASE kind WHEN 'send' THEN after + 1 ELSE after END,
    CASE WHEN kind = 'send' THEN list_append(waiting, after) WHEN kind = 'ack' AND o = 0 AND upto < after THEN list_filter(waiting, lambda x: x > upto) ELSE waiting END,
    CASE WHEN kind = 'ack' AND o = 0 AND upto > 0 AND upto < after THEN 0 WHEN kind = 'lost' AND o = 0 THEN attempts + 1 ELSE attempts END,
    CASE WHEN kind = 'lost' AND o = 0 THEN moment + least(500000 * (1::BIGINT << attempts), 30000000) ELSE o END,
    list_concat(CASE WHEN open_at > 0 AND o = 0 THEN list_transform(waiting, lambda x: {{'number': x, 'again': true, 'sent_at': open_at}}) ELSE [] END, CASE WHEN kind = 'send' AND o = 0 THEN [{{'number': after, 'again': false, 'sent_at': moment}}] ELSE [] END)
  FROM (SELECT r.*, w.after, w.waiting, w.attempts, w.open_at, CASE WHEN w.open_at > 0 AND r.moment >= w.open_at THEN 0 ELSE w.open_at END AS o FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1))
SELECT user_id, event_id AS id, s.number AS number, s.again AS again, s.sent_at AS sent_at FROM (SELECT user_id, event_id, unnest(sent) AS s FROM walk)"""


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "event_id", F.expr(_KIND18).alias("kind"), (c("event_id") % 40).alias("upto"))


_BUFFER = machines.Unacknowledged("kind", "event_id", "upto", "moment", 500_000, 30_000_000)


@query("i18_replay", _REPLAY)
def i18_replay(spark, d):
    """Every sending of a chunk: the first, and those after each reconnect until it is acknowledged."""
    rows = _chunks(table(spark, d, "events")).withColumn("moment", c("event_id") * 100_000)
    return machines.walk(rows, ["user_id"], ["event_id"], _BUFFER)


@query("i18_replay_stream", _REPLAY)
def i18_stream(spark, d):
    return _run(spark, live.run(_timed(_chunks(_stream(spark, d)), c("event_id") * 100_000), ["user_id"], ["event_id"], _BUFFER, "at"), "replayed")
