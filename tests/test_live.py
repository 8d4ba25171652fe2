"""Streams of several micro-batches give what the batch walk gives, and state ends by event time."""

import pandas as pd
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import machines
from plenum.streaming import machines as live

S = machines.SECOND


@pytest.fixture
def feed(spark, tmp_path):
    """Each list of rows as a file of its own, read one in a micro-batch; and all of them as a table."""

    def make(schema, *batches):
        d = tmp_path / "in"
        d.mkdir()
        for k, rows in enumerate(batches):
            (d / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
            os.utime(d / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by their age
        at = F.timestamp_micros(F.col("moment") + S)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d)).withColumn("at", at), spark.read.schema(schema).json(str(d))

    return make


def drain(spark, stream, tmp_path):
    with live.rocksdb(spark):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def chunks(rows, n):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


MACHINES = {
    "session": lambda: machines.Session("kind", "id", "moment"),
    "buffer": lambda: machines.Unacknowledged("kind", "id", "upto", "moment", 500_000, 8 * S),
    "sliding": lambda: machines.Sliding("id", "moment", 3, 40 * S),
    "anchored": lambda: machines.Anchored("id", "moment", 2, 40 * S),
}


@pytest.mark.parametrize("name", MACHINES)
def test_stream_equals_walk(spark, feed, tmp_path, name):
    rng = random.Random(name)
    kinds = {"session": ["init", "consume", "consume", "authenticate", "poll"], "buffer": ["send", "send", "ack", "lost"]}.get(name, ["call"])
    rows = [{"key": rng.choice("abc"), "id": k, "kind": rng.choice(kinds), "upto": rng.randrange(30), "moment": (k + rng.randrange(2)) * 7 * S} for k in range(240)]
    stream, batch = feed("key string, id long, kind string, upto long, moment long", *chunks(rows, 4))
    got = drain(spark, live.run(stream, ["key"], ["id"], MACHINES[name](), "at", "1 hour"), tmp_path)
    want = machines.walk(batch, ["key"], ["id"], MACHINES[name]())
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_replay_evicts_its_session():
    m = machines.Session("kind", "id", "moment")

    def outcomes(*events):
        state, out = m.start(), []
        for k, (kind, second) in enumerate(events):
            state, rows = m.step(state, (kind, k, second * S))
            out += [r[1] for r in rows]
        return out

    assert outcomes(("init", 0), ("consume", 5), ("authenticate", 6), ("consume", 7), ("poll", 8)) == ["made", "consumed", "authenticated", "replay", "not_found"]
    assert outcomes(("init", 0), ("consume", 5), ("authenticate", 6), ("poll", 7), ("poll", 8)) == ["made", "consumed", "authenticated", "authenticated", "not_found"]
    assert outcomes(("init", 0), ("consume", 120), ("poll", 130), ("authenticate", 140), ("poll", 150)) == ["made", "unknown", "pending", "suspicious", "not_found"]
    assert outcomes(("init", 0), ("authenticate", 5), ("poll", 6), ("consume", 7)) == ["made", "suspicious", "not_found", "consumed"]
    assert outcomes(("init", 0), ("poll", 3599), ("poll", 3600)) == ["made", "pending", "not_found"]
    assert outcomes(("init", 0), ("consume", 100), ("consume", 3699), ("consume", 3700)) == ["made", "consumed", "replay", "unknown"]


def test_unacknowledged_chunks_are_sent_again():
    m = machines.Unacknowledged("kind", "id", "upto", "moment", 1 * S, 3 * S)
    state, out = m.start(), []
    for k, (kind, upto, second) in enumerate([("send", 0, 0), ("send", 0, 1), ("ack", 1, 2), ("lost", 0, 3), ("send", 0, 3.5), ("send", 0, 4), ("lost", 0, 5), ("ack", 4, 6), ("send", 0, 7), ("lost", 0, 8), ("send", 0, 20), ("ack", 9, 21), ("ack", 6, 22), ("lost", 0, 23), ("send", 0, 30)]):
        state, rows = m.step(state, (kind, k, upto, int(second * S)))
        out += [(n, again, at / S) for _, n, again, at in rows]
    assert out == [(1, False, 0), (2, False, 1), (2, True, 4), (3, True, 4), (4, False, 4), (2, True, 7), (3, True, 7), (4, True, 7), (5, False, 7), (2, True, 11), (3, True, 11), (4, True, 11), (5, True, 11), (6, False, 20), (7, False, 30)]
    assert {n for n, _, _ in out} == set(range(1, 8))


def test_lobby_and_its_index(spark, feed, tmp_path):
    """A refresh extends an entry; ended entries never show, and leave the index when it is read; the index ends by itself."""
    say = [
        [("ann", "request", 0), ("bob", "request", 1), (None, "list", 2), ("ann", "request", 5)],
        [(None, "list", 8), ("ann", "accept", 9), ("bob", "accept", 9), (None, "list", 10), ("cy", "request", 11), ("cy", "deny", 12), (None, "list", 13)],
        [(None, "list", 18), ("ann", "request", 20), (None, "list", 9 + 21_599), (None, "list", 9 + 21_600), ("ann", "request", 30_000), (None, "list", 60_000)],
    ]
    n = iter(range(100))
    rows = [[{"room": "r", "who": w, "action": a, "id": next(n), "moment": t * S} for w, a, t in part] for part in say]
    stream, _ = feed("room string, who string, action string, id long, moment long", *rows)
    got = sorted(drain(spark, live.lobby(stream, ["id"], "1 day"), tmp_path).collect(), key=lambda r: r.id)
    assert [(r.waiting, r.members) for r in got if r.status == "listed"] == [("ann,bob", 2), ("ann", 1), ("", 1), ("", 2), ("", 1), ("", 1), ("", 0), ("", 0)]
    assert [(r.who, r.status) for r in got if r.status != "listed"] == [("ann", "waiting"), ("bob", "waiting"), ("ann", "waiting"), ("ann", "accepted"), ("bob", "unknown"), ("cy", "waiting"), ("cy", "denied"), ("ann", "accepted"), ("ann", "waiting")]


def test_presence_over_batches(spark, feed, tmp_path):
    """Everyone is seen out in time: by an event of their own, by the room's end, or by their bucket's timer after it was put off."""
    one = [("a", "seen", 0), ("b", "seen", 1), ("c", "seen", 2)]
    two = [("a", "seen", 50), ("b", "left", 60), ("c", "seen", 130)]
    three = [("d", "seen", 400), ("e", "seen", 410), (None, "room_end", 420), ("f", "seen", 421)]
    four = [("g", "seen", 2000)]
    n = iter(range(100))
    rows = [[{"room": "r", "who": w, "kind": k, "id": next(n), "moment": t * S} for w, k, t in part] for part in (one, two, three, four)]
    stream, _ = feed("room string, who string, kind string, id long, moment long", *rows)
    got = drain(spark, live.presence(stream, ["moment", "id"], 100, 10, "1 seconds"), tmp_path).collect()
    want = {("a", "in", 0), ("b", "in", 1), ("c", "in", 2), ("b", "out", 60), ("a", "expired", 150), ("c", "expired", 102), ("c", "in", 130), ("c", "expired", 230), ("d", "in", 400), ("e", "in", 410), ("d", "out", 420), ("e", "out", 420), ("f", "in", 421), ("f", "expired", 521), ("g", "in", 2000)}
    assert len(got) == len(want) and {(r.who, r.status, r.moment // S) for r in got} == want


def test_delayed_actions_fire_by_the_watermark(spark, feed, tmp_path):
    rows = [[{"key": "a", "id": 1, "moment": 10 * S}, {"key": "b", "id": 2, "moment": 11 * S}], [{"key": "b", "id": 3, "moment": 100 * S}], [{"key": "c", "id": 4, "moment": 130 * S}]]
    stream, batch = feed("key string, id long, moment long", *rows)
    got = drain(spark, live.run(stream, ["key"], ["id"], machines.Delayed("id", "moment", 20 * S), "at", "1 seconds"), tmp_path).collect()
    assert sorted((r.id, r.due_at // S) for r in got) == [(1, 30), (2, 31), (3, 120)]
    assert machines.walk(batch, ["key"], ["id"], machines.Delayed("id", "moment", 20 * S)).collect() == []


class _Counted(dict):
    """A map or value state in memory that counts what is asked of it."""

    asked = 0

    def _ask(self):
        self.asked += 1
        return self

    containsKey = lambda self, k: k in self._ask()
    getValue = lambda self, k: self._ask()[k]
    updateValue = lambda self, k, v: self._ask().__setitem__(k, v)
    removeKey = lambda self, k: self._ask().pop(k)
    iterator = lambda self: iter(self._ask().items())
    exists = lambda self: 0 in self._ask()
    get = lambda self: self._ask()[0]
    update = lambda self, v: self._ask().__setitem__(0, v)


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Counted())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _Counted())

    def registerTimer(self, at):
        pass


class _Watermark:
    getCurrentWatermarkInMs = lambda self: 0


def _many(processor, rows, cuts):
    handle = _Handle()
    processor.init(handle)
    frame, out = pd.DataFrame(rows), []
    for a, b in zip(cuts, cuts[1:]):
        out += [f for f in processor.handleInputRows(("r",), iter([frame[a:b]]), _Watermark())]
    return pd.concat(out).astype(str).values.tolist(), sum(s.asked for s in handle.states.values())


def test_state_is_asked_for_people_not_for_events():
    """20 people and 3,000 events cost some lookups a person, and the micro-batches don't change what comes out."""
    rng = random.Random(6)
    acts = [{"who": str(rng.randrange(20)), "action": rng.choice(["request", "request", "accept", "deny", "list"]), "id": n, "moment": n * 700_000} for n in range(3000)]
    seen = [{"who": str(rng.randrange(20)), "kind": rng.choice(["seen"] * 9 + ["left"]), "id": n, "moment": n * 200_000_000} for n in range(3000)]
    for make, rows in ((lambda: live._Lobby(["id"]), acts), (lambda: live._Presence(["id"], 3600, 60), seen)):
        whole, asked = _many(make(), rows, [0, 3000])
        parts, _ = _many(make(), rows, [0, 7, 900, 901, 2000, 3000])
        assert whole == parts and asked < 20 * 12


def test_a_machine_without_times_asks_for_no_timers():
    """A handle that knows no timers will do; one lookup and one write for a key of a micro-batch."""

    class Value(_Counted):
        get = lambda self: dict.get(self._ask(), 0)

    class Handle(_Handle):
        def getValueState(self, name, *_):
            return self.states.setdefault(name, Value())

    handle, run = Handle(), live._Run(machines.Recording("event", "at"), ["at"], ["k", "status", "illegal", "n"])
    run.init(handle)
    for part in range(2):
        rows = pd.DataFrame({"event": ["odd"] * 5, "at": range(5)})
        out = list(run.handleInputRows((1,), iter([rows]), _Watermark()))
        assert out[0]["n"].tolist() == [5 * part + 5] and handle.states["state"].asked == 2 * part + 2
