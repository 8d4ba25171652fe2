"""Streams give the results of their batch twins; sources read back what sinks wrote."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plenum.operators import lifecycle
from plenum.sources import stores
from plenum.streaming import rooms


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes each list of rows as a file of its own, and reads the folder as a stream."""

    def make(schema, *batches):
        d = tmp_path / "in"
        d.mkdir()
        for k, rows in enumerate(batches):
            (d / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
            os.utime(d / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by their age
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d)), spark.read.schema(schema).json(str(d))

    return make


def test_route(feed, tmp_path):
    schema = "event string, room_name string, egress_room_name string"
    rows = [{"event": "room_started", "room_name": "a"}, {"event": "room_started", "room_name": "test-1"}, {"event": "odd", "room_name": "a"}, {"event": "egress_ended", "egress_room_name": "b"}]
    stream, batch = feed(schema, rows)
    pick = lambda df: sorted((r.room, r.handler) for r in df.collect())
    assert pick(drain(rooms.route(stream), "routed", tmp_path)) == pick(rooms.route(batch)) == [("a", "on_room_started"), ("b", "on_egress_ended")]


def test_once_and_windows(feed, tmp_path):
    schema = "id string, kind string, ts timestamp"
    at = lambda m: f"2024-01-01T10:{m:02d}:00Z"
    stream, _ = feed(schema, [{"id": "a", "kind": "x", "ts": at(1)}, {"id": "a", "kind": "x", "ts": at(2)}], [{"id": "a", "kind": "x", "ts": at(3)}, {"id": "b", "kind": "y", "ts": at(4)}])
    assert sorted(r.id for r in drain(rooms.once(stream, "id", "ts"), "once_each", tmp_path).collect()) == ["a", "b"]
    counted = drain(rooms.per_window(stream, "ts", "kind"), "per_window", tmp_path, "update")
    assert {(r.kind, r.n) for r in counted.collect()} >= {("x", 3), ("y", 1)}


def test_presence(feed, tmp_path):
    schema = "room string, who string, kind string, ts timestamp"
    t = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    one = [("r", "a", "seen", 0), ("r", "b", "seen", 1), ("q", "c", "seen", 2)]
    two = [("r", "b", "left", 10), ("r", "a", "seen", 50), ("q", None, "room_end", 20)]
    three = [("r", "d", "seen", 300), ("z", "z", "seen", 301)]
    rows = [[{"room": a, "who": b, "kind": c, "ts": t(d)} for a, b, c, d in x] for x in (one, two, three)]
    stream, batch = feed(schema, *rows)
    got = [(r.room, r.who, r.status) for r in drain(rooms.presence(stream, 100, "1 seconds"), "presence", tmp_path).collect()]
    assert sorted(x for x in got if x[0] != "z") == [("q", "c", "in"), ("q", "c", "out"), ("r", "a", "expired"), ("r", "a", "in"), ("r", "b", "in"), ("r", "b", "out"), ("r", "d", "in")]
    seen = batch.withColumn("at", F.unix_timestamp("ts")).where("room <> 'z'")
    start = 1_704_067_200
    assert {(r.room, r.who) for r in lifecycle.present(seen, "room", "who", "kind", "at", F.lit(start + 301), 100).collect()} == {("r", "d")}


def test_callbacks_and_foreach(spark, feed, tmp_path):
    stream, _ = feed("job_id string, status string", [{"job_id": "j1", "status": "ok"}, {"job_id": "jx", "status": "ok"}])
    known = spark.createDataFrame([("r1", "j1")], "id string, external_process_id string")
    sent = []
    q = rooms.post_each_batch(rooms.callbacks(spark, stream, known), lambda rows, n: sent.extend(r.recording_id for r in rows.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sent == ["r1"]
    q = rooms.collect_log(stream, str(tmp_path / "log"), str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_documents(spark, tmp_path):
    doc = {"events": [{"participant_id": "p", "type": "speech_start", "timestamp": "2024-01-01T00:00:01Z"}, {"participant_id": "p", "type": "chat_received", "timestamp": "bad", "data": "x"}], "participants": [{"participantId": "p", "name": "Pat"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    got = stores.meeting_events(stores.meeting_documents(spark, str(tmp_path / "m.json"))).orderBy("pos").collect()
    assert [(r.type, r.at is None, r.data) for r in got] == [("speech_start", False, None), ("chat_received", True, "x")]
    (tmp_path / "p.json").write_text(json.dumps({"packets": [{"pts_time": 1.0, "duration_time": 0.5}, {"duration_time": 9.0}, {"pts_time": 1.4}], "streams": [{"codec_type": "audio", "codec_name": "opus"}, {"codec_name": "bad"}]}))
    r = stores.probe(spark, str(tmp_path / "p.json")).first()
    assert (r.duration, r.has_audio, r.has_video, r.has_bad_stream, r.audio_codec) == (1.5, True, False, True, "opus")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("k", "p", "a", "1", None, "N1"), ("k", "p", "b", "2", "d", "N2")], "key string, participant_id string, type string, timestamp string, data string, name string")
    stores.write_meeting_documents(rows, "key", str(tmp_path / "docs"))
    back = spark.read.json(str(tmp_path / "docs")).first()
    assert [e.timestamp for e in back.events] == ["1", "2"] and back.participants[0].name == "N2"
    jobs = spark.createDataFrame([("j", "text", "sum")], "job_id string, text string, summary string")
    stores.write_transcripts(jobs, str(tmp_path / "t"))
    stores.write_summaries(jobs, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "t")).first().job_id == "j" and spark.read.text(str(tmp_path / "s")).first().value == "sum"
    stores.bulk_insert(spark.range(100).coalesce(1), str(tmp_path / "b"), 30)
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 4
    stores.analytics(spark.createDataFrame([(None, "e"), ("u", "e")], "distinct_id string, event string"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 1
