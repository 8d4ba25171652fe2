"""Keyed event histories as state: the batch twins of the streaming operators.

A history is folded in order; the state is a few scalars. Recordings, whose histories are short by nature, are folded
as an aggregate over a key's sorted events; lobby entries are walked in sorted batches, and hot logs go through windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which status an event leads to from which.
TRANSITIONS = {
    ("initiated", "started"): "active", ("initiated", "start_failed"): "failed_to_start", ("active", "stop"): "stopped", ("active", "aborted"): "aborted", ("active", "stop_failed"): "failed_to_stop",
    ("active", "saved"): "saved", ("stopped", "saved"): "saved", ("saved", "notified"): "notification_succeeded", ("notification_succeeded", "external_ok"): "external_process_successful",
    ("notification_succeeded", "external_failed"): "external_process_failed", ("saved", "external_ok"): "external_process_successful", ("saved", "external_failed"): "external_process_failed",
}
#: What a recorder's status means for a room.
EGRESS = {"EGRESS_ACTIVE": "started", "EGRESS_ENDING": "saving", "EGRESS_ABORTED": "aborted"}
#: Seconds that a lobby status lives.
WAITING, ACCEPTED, DENIED, PRESENT = 6, 21_600, 5, 3_600
HANDLED = ("room_started", "room_finished", "participant_left", "egress_updated", "egress_ended")


def _history(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("history"))


def run_states(events: DataFrame, key: str, order: list[str], event: str, first: str = "initiated") -> DataFrame:
    """(key, status, illegal): where a history of events ends; events that don't fit the status change nothing and are counted,
    save those that repeat what has been reached."""
    table = F.create_map(*[F.lit(x) for (s, e), to in TRANSITIONS.items() for x in (f"{s}|{e}", to)])
    reaches = F.create_map(*[F.lit(x) for e in sorted({e for _, e in TRANSITIONS}) for x in (e, ",".join(sorted({to for (_, e2), to in TRANSITIONS.items() if e2 == e})))])

    def step(acc: Column, h: Column) -> Column:
        to = F.try_element_at(table, F.concat_ws("|", acc["status"], h[event]))
        again = F.coalesce(F.find_in_set(acc["status"], F.try_element_at(reaches, h[event])) > 0, F.lit(False))
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), (acc["illegal"] + F.when(to.isNull() & ~again, 1).otherwise(0)).alias("illegal"))

    zero = F.struct(F.lit(first).alias("status"), F.lit(0).alias("illegal"))
    return _history(events, key, order, [event]).select(key, F.aggregate("history", zero, step).alias("s")).select(key, "s.status", "s.illegal")


def lobby(events: DataFrame, keys: list[str], order: list[str], action: str, at: str, as_of: Column) -> DataFrame:
    """(keys, status): what a participant's lobby entry is at `as_of` (seconds).

    request: a new or expired entry waits, a waiting one is refreshed; accept and deny act on an entry that waits. An
    entry that outlives its time is unknown. Partitions by key, sorts within partitions and streams: no key has to fit in memory.
    """
    kinds = dict(events.dtypes)
    lives = {"accepted": ACCEPTED, "denied": DENIED}

    def step(status: str, until: int | None, asked: str | None, now: int | None) -> tuple[str, int | None]:
        live = status if until is not None and now is not None and until > now else "unknown"
        new = live
        if asked == "request" and live in ("unknown", "waiting"):
            new = "waiting"
        elif asked in ("accept", "deny") and live == "waiting":
            new = "accepted" if asked == "accept" else "denied"
        if new == live and not (asked == "request" and new == "waiting"):
            return new, until
        return new, None if now is None else int(now + lives.get(new, WAITING))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, status, until = None, "unknown", 0
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(k) for k in keys], ("status", pa.string()), ("until", pa.int64())])
            out = []
            for *k, asked, now in zip(*[batch.column(name).to_pylist() for name in (*keys, action, at)], strict=True):
                if k != key:
                    if key is not None:
                        out.append((*key, status, until))
                    key, status, until = k, "unknown", 0
                status, until = step(status, until, asked, now)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, status, until), strict=True))], schema)

    ties = [x for x in (action, at) if x not in order]
    dealt = events.select(*dict.fromkeys([*keys, *order, action, at])).repartition(*keys).sortWithinPartitions(*keys, *order, *ties)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", status string, until long"
    return dealt.mapInArrow(walk, out).select(*keys, F.when(F.col("until") > as_of, F.col("status")).otherwise("unknown").alias("status"))


def present(events: DataFrame, room: str, who: str, kind: str, at: str, as_of: Column, life: int = PRESENT) -> DataFrame:
    """(room, who) seen within `life` before `as_of` and not gone since; the end of a room clears all of it. No history is gathered: two maxima suffice."""
    ended = events.where(F.col(kind) == "room_end").groupBy(room).agg(F.max(at).alias("_ended"))
    each = events.where(F.col(kind) != "room_end").groupBy(room, who).agg(F.max(F.when(F.col(kind) == "seen", F.col(at))).alias("_seen"), F.max(F.when(F.col(kind) == "left", F.col(at))).alias("_left"))
    gone = F.greatest(F.coalesce("_left", F.lit(-1)), F.coalesce("_ended", F.lit(-1)))
    return each.join(ended, room, "left").where((F.col("_seen") > gone) & (F.col("_seen") + life > as_of)).select(room, who)


def single_use(events: DataFrame, key: str, order: list[str], at: str, life: int) -> DataFrame:
    """(key, order..., outcome): the first use of a token within `life` of its issue is consumed; later ones are replays, and evict the session."""
    seq = Window.partitionBy(key).orderBy(*order)
    issued = F.first(at).over(seq)
    n = F.row_number().over(seq)
    outcome = F.when(n == 1, "issued").when((n == 2) & (F.col(at) - issued < life), "consumed").when(n == 2, "expired").otherwise("replay")
    return events.withColumn("outcome", outcome)


def revoked_sessions(uses: DataFrame, session: str) -> DataFrame:
    """(session, revoked) of the outcomes of `single_use`: a replay of one of its tokens revokes a session."""
    return uses.groupBy(session).agg(F.bool_or(F.col("outcome") == "replay").alias("revoked"))


def admissions(events: DataFrame, keys: list[str], order: list[str], joins: Column, leaves: Column) -> DataFrame:
    """The joins with `admitted`: a join is turned away while its key is in, and admitted again once it has left. Other events don't matter."""
    seq = Window.partitionBy(*keys).orderBy(*order)
    own = events.withColumn("_join", F.coalesce(joins, F.lit(False))).where(F.col("_join") | F.coalesce(leaves, F.lit(False)))
    return own.withColumn("admitted", ~F.coalesce(F.lag("_join").over(seq), F.lit(False))).where("_join").drop("_join")


def read_and_clear(events: DataFrame, key: str, order: list[str], is_write: Column, at: str, life: int) -> DataFrame:
    """Reads with `hit`: the first read after a write, within `life` of it, gets the state; others find nothing."""
    seq = Window.partitionBy(key).orderBy(*order)
    before = events.withColumn("_write", is_write).select("*", F.lag("_write").over(seq).alias("_was"), F.lag(at).over(seq).alias("_at"))
    return before.where(~F.col("_write")).withColumn("hit", F.coalesce(F.col("_was") & (F.col(at) - F.col("_at") < life), F.lit(False))).drop("_write", "_was", "_at")


def task_counters(events: DataFrame, task: str, kind: str, at: str) -> DataFrame:
    """(task, retries, created_at, captured_at, done)."""
    return events.groupBy(task).agg(F.count_if(F.col(kind) == "retry").alias("retries"), F.min(F.when(F.col(kind) == "create", F.col(at))).alias("created_at"), F.max(F.when(F.col(kind) == "capture", F.col(at))).alias("captured_at"), F.bool_or(F.col(kind) == "capture").alias("done"))


def backoff(attempt: Column, base: float, most: float) -> Column:
    """Seconds to wait before the n-th attempt: doubled each time, up to a limit."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def recording_view(status: Column, mode: Column, live: Column) -> Column:
    """struct of what a client shows: starting, started, saving, active; started without the live flag still counts as starting."""
    started = status == "active"
    return F.struct(((status == "initiated") | (started & ~live)).alias("starting"), (started & live).alias("started"), status.isin("stopped").alias("saving"), status.isin("initiated", "active", "stopped").alias("active"), mode.alias("mode"))


def utterances(rows: DataFrame, key: str, order: list[str], kind: str, text: str, pre_roll: int) -> DataFrame:
    """(key, utterance, text): the texts from each start to its end, and the last `pre_roll` before the start."""
    seq = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_n", F.row_number().over(seq)).withColumn("_s", F.when(F.col(kind) == "speech_start", 1).otherwise(0)).withColumn("_e", F.when(F.col(kind) == "speech_end", 1).otherwise(0))
    run = marked.withColumn("utterance", F.sum("_s").over(seq)).withColumn("_open", F.last(F.when(F.col("_s") == 1, F.lit(True)).when(F.col("_e") == 1, F.lit(False)), True).over(seq))
    inside = run.where(F.coalesce("_open", F.lit(False)) | (F.col("_e") == 1)).where("utterance > 0")
    spans = inside.groupBy(key, "utterance").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    reach = spans.withColumn("_n", F.explode(F.sequence(F.greatest(F.col("_a") - pre_roll, F.lit(1)), F.col("_b"))))
    chosen = marked.join(reach, [key, "_n"]).where((F.col("_s") == 0) & (F.col("_e") == 0))
    return chosen.groupBy(key, "utterance").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda x: x[text]), " ").alias("text"))
