"""Decisions that hang on what came before, against plain walks."""

import random

from pyspark.sql import functions as F

from plenum.functions import text
from plenum.operators import dml, intervals, lifecycle, ratelimit
from plenum.sources import stores


def test_rates_by_scope(spark):
    rng = random.Random(4)
    rates = {"entry": 3, "callback": 1}
    calls = [(rng.choice(["entry", "callback", "free"]), rng.choice([None, 1, 2]), k, t) for k, t in enumerate(sorted(rng.randrange(400) for _ in range(300)))]
    want, held = {}, {}
    for scope, who, k, t in calls:
        live = [x for x in held.get((scope, who), []) if x > t - 60]
        ok = who is None or scope not in rates or len(live) < rates[scope]
        held[scope, who] = [*live, t] if ok else live
        want[k] = ok
    rows = spark.createDataFrame(calls, "scope string, who long, k long, at long").repartition(3)
    assert {r.k: r.accepted for r in ratelimit.by_scope(rows, "scope", "who", "at", "k", rates, 60).collect()} == want
    assert not all(want.values())
    assert ratelimit.by_scope(rows.limit(0), "scope", "who", "at", "k", rates, 60).collect() == []


def test_admission_after_leaving(spark):
    events = [("r", 1, "in"), ("r", 2, "in"), ("r", 3, "out"), ("r", 4, "out"), ("r", 5, "in"), ("q", 6, "out"), ("q", 7, "in"), ("q", 8, "odd"), ("q", 9, "in")]
    rows = spark.createDataFrame(events, "room string, n int, kind string")
    got = {r.n: r.admitted for r in lifecycle.admissions(rows, ["room"], ["n"], F.col("kind") == "in", F.col("kind") == "out").collect()}
    assert got == {1: True, 2: False, 5: True, 7: True, 9: False}


def test_replay_revokes_the_session(spark):
    uses = spark.createDataFrame([("a", k, k) for k in range(2)] + [("b", k, k) for k in range(3)], "token string, n int, at int")
    got = lifecycle.revoked_sessions(lifecycle.single_use(uses, "token", ["n"], "at", 9), "token")
    assert {r.token: r.revoked for r in got.collect()} == {"a": False, "b": True}


def test_best_match_ties_go_by_rank(spark):
    overlaps = spark.createDataFrame([("s", "late", 5, 9), ("s", "early", 5, 2), ("s", "less", 4, 1), ("t", "x", 1, 1)], "who string, other string, overlap long, heard int")
    totals = spark.createDataFrame([("s", 10), ("t", 10)], "who string, total long")
    got = intervals.best_match(overlaps, totals, [], "who", "other", "heard").collect()
    assert [(r.who, r.other, r.score) for r in got] == [("s", "early", 0.5)]


def test_codes_are_drawn_until_all_have_one(spark, monkeypatch):
    monkeypatch.setattr(dml, "DIGITS", 3)
    rows = spark.createDataFrame([(k, f"{k}" if k % 4 == 0 else None) for k in range(480)], "id long, code string")
    got = dml.backfill_codes(rows, "id", "code").collect()
    assert len({r.code for r in got}) == len(got) == 480 and all(len(r.code) == 3 for r in got)
    assert {r.id: r.code for r in got if r.id % 4 == 0} == {k: f"{k:03d}" for k in range(0, 480, 4)}


def test_slugs_of_all_latin_accents(spark):
    row = spark.createDataFrame([(" ŠŐŹ ėį ệ ø ß ", "a\u0301 b")], "a string, b string")
    assert tuple(row.select(text.slugify_simple(F.col("a")), text.slugify_simple(F.col("b"))).first()) == ("soz-ei-e-", "a-b")


def test_many_keys(spark):
    log = spark.createDataFrame([("k", 1, "v1", False), ("k", 2, "v2", False), ("gone", 3, None, True)], "key string, n int, value string, dead boolean")
    keys = spark.createDataFrame([("k",), ("gone",), ("never",)], "key string")
    got = stores.many(stores.snapshot(log, "key", "n", F.col("dead")), keys, "key")
    assert {r.key: r.value for r in got.collect()} == {"k": "v2", "gone": None, "never": None}


def test_database_table(spark):
    """A table of an embedded database, read in ranges of its key."""
    url = "jdbc:derby:memory:plenum;create=true"
    spark.range(100).selectExpr("id", "'n' || id AS name").write.format("jdbc").option("url", url).option("dbtable", "things").mode("overwrite").save()
    got = stores.jdbc(spark, url, "things", "id", 0, 100, 4)
    assert got.rdd.getNumPartitions() == 4
    assert {(r[0], r[1]) for r in got.collect()} == {(k, f"n{k}") for k in range(100)}
