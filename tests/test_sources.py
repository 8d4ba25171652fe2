"""Documents and pages over HTTP are what a file scan gives; words meet the texts that a comparison of all pairs finds."""

import json
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from plenum.functions import fields
from plenum.operators import similarity
from plenum.sources import http, stores

ROWS = [{"id": k * 3, "name": f"n{k}", "size": None if k % 5 == 0 else k} for k in range(230)]


@pytest.fixture
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            asked[self.path] += 1
            code, body = 200, ""
            if url.path == "/rows":
                q = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
                body = json.dumps({"results": [r for r in ROWS if q["after"] < r["id"] < q["below"]][: q["limit"]]})
            elif url.path.startswith("/doc/"):
                n = int(url.path[5:])
                body = json.dumps({"events": [{"participant_id": f"p{n}", "type": "chat_received", "timestamp": "2024-01-01T00:00:00Z", "data": "x"}] * n, "participants": []})
                code = 403 if n == 4 else 503 if n % 3 == 1 and asked[self.path] < 3 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_pages_equal_the_file_scan(spark, server, tmp_path):
    url, asked = server
    schema = "id long, name string, size long"
    got = http.pages(spark, f"{url}/rows", schema, 0, 700, 5, limit="17")
    assert got.rdd.getNumPartitions() == 5
    spark.createDataFrame([tuple(r.values()) for r in ROWS], schema).write.json(str(tmp_path / "rows"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.schema(schema).json(str(tmp_path / "rows")).collect()))
    assert len(asked) > 5 * 2 and http.pages(spark, f"{url}/rows", schema, 700, 900, 3).count() == 0


def test_signed_documents(spark, server):
    """Overload is waited for; a refused link is a row with its error, and loses no other."""
    url, _ = server
    links = spark.createDataFrame([(k, f"{url}/doc/{k}") for k in range(9)] + [(99, "http://127.0.0.1:9/none")], "key long, url string")
    got = {r.key: (r.error, None if r.events is None else len(r.events)) for r in http.documents(links, stores.MEETING, 3, pause=0.0).collect()}
    assert {k: n for k, (e, n) in got.items() if e is None} == {k: k for k in range(9) if k != 4}
    assert "403" in got[4][0] and got[99][0] and len(got) == 10


def test_words_meet_all_that_are_like_them(spark):
    rng = random.Random(3)
    parts = ["anna", "pool", "omar", "field", "ann", "poole", "o'mar", "feld", "mary", "x", "", "42", "É"]
    texts = [(k, None if k % 40 == 0 else rng.choice("._ @-").join(rng.choice(parts) for _ in range(rng.randrange(4)))) for k in range(300)]
    texts += texts[:4]
    words = [rng.choice(parts) + rng.choice(["", " ", "."]) + rng.choice(parts) for _ in range(30)] + [None, "", "anna", "anna", "--"]
    t, w = spark.createDataFrame(texts, "id long, email string"), spark.createDataFrame([(x,) for x in words], "word string")
    for threshold in (0.3, 0.6, 1.0):
        want = Counter()
        for x in {x for x in words if x}:
            asked = set(fields._grams(x))
            for k, text in texts:
                s = fields._word_similarity(text, asked) if text and asked else 0.0
                if s > 0 and s >= threshold:
                    want[x, k, round(s, 9)] += 1
        got = similarity.similar_pairs(t, "id", "email", w, "word", threshold)
        assert Counter((r.word, r.id, round(r.similarity, 9)) for r in got.collect()) == want and want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_texts_are_not_broadcast(spark):
    """Texts and their index are as large as the table, whatever is thought of their size."""
    from plenum.operators import similarity

    texts, words = spark.createDataFrame([(1, "building"), (2, "user1@x")], "id long, email string"), spark.createDataFrame([("building",)], "word string")
    got = similarity.similar_pairs(texts, "id", "email", words, "word")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_id" in plan and "BroadcastHashJoin [_id" not in plan and "BuildLeft" not in plan
    assert [(r.word, r.id) for r in got.collect()] == [("building", 1)]
