"""Room events as streams: routing, de-duplication, windows, and state with time-to-live.

Event time is explicit: every operator that keeps state takes a watermark, which the source of these semantics does
not have; for input in order the results are those of the batch twins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plenum.operators.lifecycle import HANDLED, PRESENT


def route(events: DataFrame, kind: str = "event", room: str = "room_name", other: str = "egress_room_name", test_prefix: str = "test-", known: tuple[str, ...] = HANDLED) -> DataFrame:
    """Events of known types, with their room and a handler's name; those of test rooms are dropped."""
    named = events.withColumn("room", F.coalesce(room, other))
    return named.where(F.col(kind).isin(*known) & ~F.coalesce(F.startswith("room", F.lit(test_prefix)), F.lit(False))).withColumn("handler", F.concat(F.lit("on_"), kind))


def once(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key's first event; a key is remembered as long as late events may come."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def per_window(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type and tumbling window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", kind, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: runs of events with less than `gap` between."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def presence(events: DataFrame, life: int = PRESENT, late: str = "10 minutes") -> DataFrame:
    """(room, who, status, at): who comes into and goes out of a room. For rooms of a few hundred people, where the
    state store isn't RocksDB: each event looks at all of a room's people. `plenum.streaming.machines.presence` doesn't.

    `events` has room, who, kind (seen, left, room_end) and ts. The state of a room is a map of its people, so one
    event can clear it. Entries end `life` seconds after they were last seen, by event time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        people = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []

        def drop(who: str, at: float, status: str) -> None:
            people.pop(who)
            out.append((key[0], who, status, at))

        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() / 1000
            for who in [w for w, until in people.items() if until <= now]:
                drop(who, people[who], "expired")
        else:
            rows = pd.concat(batches).sort_values("ts", kind="stable")
            for who, kind, at in zip(rows["who"], rows["kind"], rows["ts"].map(lambda t: t.timestamp()), strict=True):
                for gone in [w for w, until in people.items() if until <= at]:
                    drop(gone, people[gone], "expired")
                if kind == "seen":
                    if who not in people:
                        out.append((key[0], who, "in", at))
                    people[who] = at + life
                elif kind == "left" and who in people:
                    drop(who, at, "out")
                elif kind == "room_end":
                    for w in list(people):
                        drop(w, at, "out")
        if people:
            state.update((list(people), list(people.values())))
            state.setTimeoutTimestamp(max(int(min(people.values()) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["room", "who", "status", "at"])

    return events.withWatermark("ts", late).groupBy("room").applyInPandasWithState(update, "room string, who string, status string, at double", "who array<string>, until array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def collect_log(events: DataFrame, path: str, checkpoint: str):
    """Append an event log to JSON files, once each."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def callbacks(spark: SparkSession, stream: DataFrame, recordings: DataFrame) -> DataFrame:
    """Job callbacks with their recordings; callbacks of unknown jobs are dropped."""
    known = recordings.select(F.col("external_process_id").alias("job_id"), F.col("id").alias("recording_id"))
    return stream.join(known, "job_id")


def post_each_batch(stream: DataFrame, send, checkpoint: str):
    """Hand every micro-batch to `send(rows, batch_id)` on the driver's side of a sink that must be idempotent: a batch may be sent again."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
