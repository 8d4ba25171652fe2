"""Webhooks over HTTP lose and repeat nothing; tables are published together or not at all."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from plenum.operators import dedupe
from plenum.sources import versions
from plenum.streaming import delivery


@pytest.fixture
def endpoint():
    """A receiver that fails some tries of each key, tells repeats by their keys, and refuses some for good."""
    tries, taken, lock = Counter(), [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            key, body = self.headers["Idempotency-Key"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                tries[key] += 1
                n = body["n"]
                ok = n % 10 != 9 and tries[key] > n % 3 or state["open"]
                if ok and key not in seen:
                    seen.add(key)
                    taken.append(n)
            self.send_response(200 if ok else 503)
            self.end_headers()

        def log_message(self, *_):
            pass

    state, seen = {"open": False}, set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", tries, taken, state
    server.shutdown()


def test_nothing_is_lost_or_repeated(spark, tmp_path, endpoint):
    url, tries, taken, state = endpoint
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    body = F.to_json(F.struct(F.col("id").alias("n")))
    rows = spark.range(60).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), body.alias("body"))
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    delivery.deliver(stream, folder, str(tmp_path / "state"), delivery.http(url), pause=0.0).awaitTermination()
    got = [(json.loads(r.body)["n"], r.status, r.attempts) for r in delivery.delivered(spark, folder).collect()]
    assert sorted(got) == [(n, "dead" if n % 10 == 9 else "delivered", 4 if n % 10 == 9 else n % 3 + 1) for n in range(60)]
    assert sorted(taken) == [n for n in range(60) if n % 10 != 9]
    delivery.deliver(stream, folder, str(tmp_path / "lost"), delivery.http(url), pause=0.0).awaitTermination()  # the checkpoint is gone: all is sent again
    assert len(taken) == 54 and delivery.delivered(spark, folder).count() == 60
    state["open"] = True
    again = delivery.redeliver(spark, folder, str(tmp_path / "again"), delivery.http(url), pause=0.0).collect()
    assert sorted(taken) == list(range(60)) and {r.status for r in again} == {"delivered"} and len(again) == 6


def test_other_errors_fail_the_task(spark):
    def broken(key, body, attempt):
        raise ValueError("not a request error")

    with pytest.raises(Exception, match="not a request error"):
        delivery.outcomes(spark.createDataFrame([("k", "b")], "key string, body string"), broken).collect()
    refused = delivery.outcomes(spark.createDataFrame([("k", "b")], "key string, body string"), delivery.http("http://127.0.0.1:9/", timeout=2), pause=0.0).first()
    assert (refused.status, refused.attempts) == ("dead", 4) and refused.error


def test_versions_are_published_whole(spark, tmp_path):
    at = str(tmp_path / "tables")
    assert versions.latest(spark, at) == 0
    one = spark.range(3)
    assert versions.publish(spark, at, {"a": one, "b": one}) == 1
    fails = one.select(F.when(F.col("id") >= 0, F.raise_error(F.lit("stop"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        versions.publish(spark, at, {"a": spark.range(9), "b": fails})
    assert versions.latest(spark, at) == 1 and versions.read(spark, at, "a").count() == 3
    assert versions.publish(spark, at, {"a": spark.range(9), "b": one}) == 2
    assert versions.read(spark, at, "a").count() == 9 and versions.read(spark, at, "a", 1).count() == 3
    (tmp_path / "tables" / "_claims" / "3").touch()  # another writer has the next number
    with pytest.raises(Exception, match="exists"):
        versions.publish(spark, at, {"a": one})
    assert versions.latest(spark, at) == 2


def test_groups_that_break_a_rule_stay(spark):
    users = spark.createDataFrame([(1, "A@x", 1), (2, "a@x", 2), (3, "B@x", 1), (4, "b@x", 2), (5, "c@x", 1)], "id long, email string, created int")
    moved = dedupe.survivors(users).join(users.select("id", "created"), "id").withColumnRenamed("id", "id_user")
    whole, failed = dedupe.mergeable(users, moved, spark.createDataFrame([(3,), (5,), (3,)], "id long"))
    assert [tuple(r) for r in failed.collect()] == [("b@x", 2)]
    assert {r.id for r in dedupe.without_stale(users, whole).collect()} == {2, 3, 4, 5}
