"""Runs of rows, accounts, access, histories and functions against small vectors."""

import hashlib
import hmac
import random
import uuid

import pytest
from pyspark.sql import functions as F

from plenum.functions import fields, json_ops, text
from plenum.operators import access, counters, dedupe, dml, islands, lifecycle, paging, ratelimit


def col(spark, expr, *values, schema="x string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, " + schema)
    return [r.y for r in rows.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


def test_speaker_text(spark):
    rows = [(1, 1, None, "hi"), (1, 2, None, "you"), (1, 3, "A", "so"), (1, 4, "B", ""), (1, 5, "A", "yes"), (1, 6, "B", "no"), (1, 7, None, "end")]
    got = islands.speaker_text(spark.createDataFrame(rows, "c int, n int, speaker string, text string"), ["c"], ["n"]).first().text
    assert got == " hi you\n\n **A**: so yes\n\n **B**: no\n\n **None**: end"


def test_captions_and_upsert(spark):
    rows = spark.createDataFrame([(1, 1, "a", "P", " x ", 5), (1, 2, "b", "P", "", 7), (1, 3, "c", "Q", "z", 6)], "r int, n int, id string, participant string, text string, last_received int")
    got = [(r.row_id, r.participant, r.text, r.last_received) for r in islands.caption_rows(rows, ["r"], ["n"]).orderBy("row_id").collect()]
    assert got == [("a", "P", "x", 7), ("c", "Q", "z", 6)]
    up = islands.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, seq int, v string"), ["id"], "seq")
    assert sorted((r.id, r.v, r.place) for r in up.collect()) == [("a", "z", 1), ("b", "y", 2)]


def test_silence(spark):
    rows = [("a", k, "t1" if k < 4 else "t2", True, 3000) for k in range(1, 8)] + [("b", 1, "t", True, 9000), ("b", 2, "t", False, 1), ("b", 3, "t", True, 9000), ("c", 1, "t", True, 10)]
    got = islands.silence(spark.createDataFrame(rows, "k string, n int, track string, silent boolean, d int"), ["k"], ["n"], "track", F.col("silent"), "d")
    assert sorted((r.k, r.status, r.tripped_at) for r in got.collect()) == [("a", "silent", 7), ("b", "passed", None), ("c", "pending", None)]


def test_rate_limits(spark):
    rng = random.Random(2)
    calls = sorted((rng.choice("ab"), rng.randint(0, 400)) for _ in range(120))
    rows = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(calls)], "k string, at long, n long")
    for f, most, window in ((ratelimit.sliding, 3, 50), (ratelimit.anchored, 2, 40)):
        want, state = {}, {}
        for n, (k, t) in enumerate(calls):
            if f is ratelimit.sliding:
                kept = [x for x in state.get(k, []) if x > t - window]
                want[n] = len(kept) < most
                state[k] = kept + [t] * want[n]
            else:
                start, used = state.get(k, (None, 0))
                if start is None or t - start >= window:
                    start, used = t, 0
                state[k] = (start, used + 1)
                want[n] = used + 1 <= most
        assert {r.n: r.accepted for r in f(rows, "k", "at", "n", most, window).collect()} == want


def test_counters(spark):
    rows = spark.createDataFrame([("a", 1, 100, 0), ("a", 2, 300, 1000), ("a", 3, 50, 2000), ("a", 4, 90, 2000)], "k string, n int, bytes long, ms long")
    assert [r.kbps for r in counters.rate(rows, ["k"], ["n"], "bytes", "ms").orderBy("n").collect()] == [0.0, 1.6, 0.0, 0.0]
    assert [r.delta for r in counters.delta(rows, ["k"], ["n"], "bytes").orderBy("n").collect()] == [0, 200, -250, 40]


def users(spark):
    rows = [(1, "a@x", 10.0), (2, "A@X", 30.0), (3, "a@x", 20.0), (4, "b@x", 1.0), (5, "", 1.0), (6, "", 2.0), (7, None, 1.0), (8, None, 1.0)]
    return spark.createDataFrame(rows, "id long, email string, created double")


def test_accounts(spark):
    u = users(spark)
    assert [(r.email, r.n) for r in dedupe.duplicate_emails(u).collect()] == [("a@x", 3)]
    assert {(r.email, r.n) for r in dedupe.duplicate_emails_raw(u).collect()} == {("a@x", 2), ("", 2), (None, 2)}
    assert {(r.id, r.survivor) for r in dedupe.survivors(u).collect()} == {(1, 2), (2, 2), (3, 2)}
    assert {r.survivor for r in dedupe.survivors(u, newest=False).collect()} == {1}
    moved = spark.createDataFrame([(1, 2, 10.0), (2, 2, 30.0), (3, 2, 20.0)], "id_user long, survivor long, created double")
    a = spark.createDataFrame([(11, 100, 1, "owner"), (12, 100, 2, "member"), (13, 101, 3, "administrator"), (14, 101, 1, "member"), (15, 100, 4, "member")], "id long, resource_id long, user_id long, role string")
    assert sorted(tuple(r) for r in dedupe.merge_accesses(a, moved).collect()) == [(100, 2, 12, "owner"), (100, 4, 15, "member"), (101, 2, 14, "administrator")]
    assert sorted((r.id, r.email) for r in dedupe.without_stale(u, moved).where("id < 5").collect()) == [(2, "a@x"), (4, "b@x")]


def test_access(spark):
    level = ["public", "trusted", "restricted", "restricted"]
    rows = spark.createDataFrame([(v, k % 2 == 0, "member" if k == 3 else None) for k, v in enumerate(level)], "l string, a boolean, r string")
    assert [r[0] for r in rows.select(access.can_access_room(F.col("l"), F.col("a"), F.col("r"))).collect()] == [True, False, False, True]
    one = spark.createDataFrame([("owner", "owner", 1), ("owner", "owner", 2), ("member", "administrator", 1), ("owner", "administrator", 2)], "role string, me string, n int")
    got = [(r.a.destroy, r.a.set_role_to) for r in one.select(access.access_abilities(F.col("role"), F.col("me"), F.col("n")).alias("a")).collect()]
    assert got == [(False, []), (True, ["administrator", "member"]), (True, ["administrator"]), (False, [])]
    rooms = spark.createDataFrame([(1,), (2,)], "id long")
    acc = spark.createDataFrame([(1, 1, 7, "t"), (2, 1, 7, None), (3, 2, 8, "t")], "id long, resource_id long, user_id long, team string").withColumn("role", F.lit("owner"))
    assert access.mine(rooms, acc, "id", F.col("user_id") == 7).count() == 1
    assert access.by_access(rooms, acc, "id", 7, ["t"]).count() == 3


def test_paging(spark):
    rows = spark.createDataFrame([(k, f"n{k:02d}") for k in range(45)], "id long, name string")
    got = paging.page(rows, ["name", "id"], 3, 20).collect()
    assert [r.id for r in got] == [40, 41, 42, 43, 44] and got[0].total == 45
    assert paging.page(rows, ["name"], 1, 500).count() == 45


def test_histories(spark):
    events = [("a", 1, "started"), ("a", 2, "started"), ("a", 3, "stop"), ("a", 4, "saved"), ("b", 1, "saved"), ("c", 1, "start_failed"), ("c", 2, "started")]
    got = lifecycle.run_states(spark.createDataFrame(events, "r string, n int, e string"), "r", ["n"], "e")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "saved", 0), ("b", "initiated", 1), ("c", "failed_to_start", 1)]
    calls = [("r", "u", 1, "request", 0), ("r", "u", 2, "request", 5), ("r", "u", 3, "accept", 10), ("r", "v", 1, "request", 0), ("r", "v", 2, "accept", 7), ("r", "w", 1, "request", 0), ("r", "w", 2, "deny", 1)]
    rows = spark.createDataFrame(calls, "room string, who string, n int, action string, at long")
    at = lambda t: {r.who: r.status for r in lifecycle.lobby(rows, ["room", "who"], ["n"], "action", "at", F.lit(t)).collect()}
    assert at(11) == {"u": "accepted", "v": "unknown", "w": "unknown"}
    seen = [("r", "a", "seen", 0), ("r", "b", "seen", 0), ("r", None, "room_end", 5), ("r", "b", "seen", 6), ("r", "c", "seen", 7), ("r", "c", "left", 8)]
    here = lifecycle.present(spark.createDataFrame(seen, "room string, who string, kind string, at long"), "room", "who", "kind", "at", F.lit(10))
    assert [r.who for r in here.collect()] == ["b"]


def test_utterances(spark):
    rows = [("k", n, t, str(n)) for n, t in enumerate(["chunk"] * 7 + ["speech_start", "chunk", "chunk", "speech_end", "chunk"], 1)]
    got = lifecycle.utterances(spark.createDataFrame(rows, "k string, n int, type string, text string"), "k", ["n"], "type", "text", 5)
    assert [r.text for r in got.collect()] == ["3 4 5 6 7 9 10"]


def test_codes(spark):
    rows = spark.createDataFrame([(k, str(k) if k % 3 == 0 else None) for k in range(200)], "id long, pin string")
    got = [r.pin for r in dml.backfill_codes(rows, "id", "pin").collect()]
    assert len(got) == len(set(got)) == 200 and all(len(p) == 10 and p.isdigit() for p in got)


def test_text(spark):
    assert col(spark, text.slugify, "Été à  l'Œuvre!", "  A--b_c ", None) == ["ete-a-luvre", "a-b_c", None]
    assert col(spark, text.slugify_simple, " Été -- à ") == ["ete-a"]
    assert col(spark, text.group_pin, "0123456789", "", "ab") == ["012 345 6789#", "", "ab#"]
    assert col(spark, text.capitalize_first, "éa b", "") == ["Éa b", ""]
    assert col(spark, lambda x: text.zero_pad(x, 3), "7", "12345") == ["007", "12345"]
    assert col(spark, text.unquote, "a+b%20c%2F") == ["a+b c/"]
    assert col(spark, text.quote, "a b/c~é*") == ["a%20b/c~%C3%A9%2A"]
    assert col(spark, text.typed, "12", "1.5", "x", "1d", " 7 ") == ["int", "float", "string", "string", "int"]
    assert col(spark, text.path_suffix, "https://h.x/a.b/c.MP4?q=.z", "https://h.x/a") == [".mp4", ""]
    assert col(spark, lambda x: text.hmac_sha256(b"key", x), "m") == [hmac.new(b"key", b"m", hashlib.sha256).hexdigest()]
    assert col(spark, text.is_uuid, str(uuid.UUID(int=5)), "x") == [True, False]
    assert col(spark, text.phone, "06 12 34 56 78", "12") == ["+33612345678", None]
    assert col(spark, lambda x: text.date_or_invalid(x, "yyyy-MM-dd"), "2024-02-03", "soon") == ["2024-02-03", "Invalid Date"]
    assert col(spark, fields.extension, "a.b/c.tar.gz", ".env", "x", "d.e/f") == ["gz", None, None, None]
    assert col(spark, fields.file_root, "a/c.tar.gz", ".env") == ["c.tar", ".env"]


def test_similarity(spark):
    rows = spark.createDataFrame([("anna_poole@site.test",), ("mia_foole@site.test",), ("omar_field@site.test",), (None,)], "email string")
    assert sorted(r.email for r in fields.similar(rows, "email", "oole").collect()) == ["anna_poole@site.test", "mia_foole@site.test"]
    assert [r.email for r in fields.similar(rows, "email", "omar_field@site.test").collect()] == ["omar_field@site.test"]
    assert fields.similar(rows, "email", "").count() == 0


def test_color_seed(spark):
    assert col(spark, fields.color_seed, "abc", "") == [fields.color_seed_of("abc"), fields.color_seed_of("")]


def test_json(spark):
    row = spark.range(1)
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    arr = lambda *xs: F.array(*map(F.lit, xs))
    got = row.select(json_ops.merge_maps(m(a="1", b="2"), m(b="3")).alias("a"), json_ops.remove_all(arr("x", "y", "x"), arr("y")).alias("b"), json_ops.split_scopes(F.lit("M:A m:a b"), "m:").alias("c"), json_ops.list_or_default(F.lit('{"l": 3}'), "$.l", ["d"]).alias("d")).first()
    assert got.a == {"a": "1", "b": "3"} and got.b == ["x", "x"] and got.c == ["a", "b"] and got.d == ["d"]


def test_deny_and_gates(spark):
    rows = spark.createDataFrame([("exception", ["boom"], None), ("exception", None, "x"), ("other", ["boom"], "boom")], "t string, v array<string>, m string")
    assert [r[0] for r in rows.select(fields.denied_exception(F.col("t"), F.col("v"), F.col("m"), ["bo+m"])).collect()] == [True, False, False]


def test_retention_bounds(spark):
    files = spark.createDataFrame([(1, "pending", 276, None, None), (2, "pending", 275, None, None), (3, "ready", 1, 232, None), (4, "ready", 1, 233, None)], "id long, upload_state string, created_hour long, deleted_hour long, hard_deleted_hour long")
    assert [r.id for r in dml.stale_uploads(files, F.lit(300), 24).collect()] == [2]
    assert [r.id for r in dml.to_purge(files, F.lit(400), 168).collect()] == [3]
    with pytest.raises(ValueError):
        dml.stale_uploads(files, F.lit(300), -1)


def test_first_owner_of_equal_rows(spark, tmp_path):
    """Rows that tie on time and id give the same owner in whichever order they are read."""
    from plenum.plans.registry import QUERIES

    row = "SELECT 1L AS l_orderkey, 1 AS l_linenumber, {u}L AS l_suppkey, 5L AS l_partkey, 'A' AS l_returnflag, DATE'2024-01-01' AS l_shipdate"
    for order in ((7, 9), (9, 7)):
        at = str(tmp_path / str(order[0]))
        spark.sql(" UNION ALL ".join(row.format(u=u) for u in order)).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        assert [tuple(r) for r in QUERIES["f3_first_owner"](spark, at).collect()] == [(1, 7)]
