"""Queries that do the whole job, on tables that show what a cut would lose."""

import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import lifecycle, paging
from plenum.plans import registry


def test_whole_text_is_replaced_and_relabelled(spark, tmp_path):
    long = " ".join(["begin"] + ["x"] * 100 + ["the", "end.", "plan"])
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "an end")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.x for r in registry.QUERIES["j8_replace_list_whole"](spark, str(tmp_path)).collect()}
    assert got == {0: long.replace("the", "THE").replace(".", "").replace("an", "[an]"), 1: "[an] end"}
    words = registry.QUERIES["k14_relabel_words"](spark, str(tmp_path)).collect()
    assert [r.word for r in sorted((r for r in words if r.turn == 0), key=lambda r: r.pos)] == long.split(" ")
    assert {(r.turn, r.speaker, r.word_speaker) for r in words} == {(0, "Ada", "Ada"), (1, "assistant", "assistant")}


@pytest.mark.parametrize("parts", [1, 5])
def test_every_row_has_its_place(spark, parts):
    rng = random.Random(5)
    values = [(k, rng.choice([None, 1, 2, rng.randint(3, 500)])) for k in range(2000)]
    rows = spark.createDataFrame(values, "id long, at int").repartition(parts)
    got = paging.places(rows, [F.col("at").asc_nulls_last(), F.col("id").asc()]).collect()
    want = sorted(values, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [r.id for r in got] == [k for k, _ in want]
    assert [r.place for r in got] == list(range(1, 2001))
    assert paging.places(rows.limit(0), ["id"]).collect() == []


def test_every_user_is_looked_up(spark, tmp_path):
    users = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame([(k, f"C{k}", 1, 0.0, "M") for k in range(1, 9)], users).write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.QUERIES["e8_fallback_lookup_all"](spark, str(tmp_path)).collect()
    assert sorted(r.ask for r in got) == list(range(1, 9))
    assert {r.ask: r.found for r in got if r.ask in (2, 4, 8)} == {2: 2, 4: 4, 8: 8}


def test_no_history_is_gathered(spark, tmp_path):
    calls = [("r", "u", n, "request", n * 5) for n in range(30_000)] + [("r", "u", 30_000, "accept", 150_000), ("r", None, 1, "request", 0), ("r", None, 2, "deny", 1), (None, "u", 1, "accept", 0)]
    rows = spark.createDataFrame(calls, "room string, who string, n int, action string, at long").repartition(3)
    lobby = lifecycle.lobby(rows, ["room", "who"], ["n"], "action", "at", F.lit(150_001))
    assert {(r.room, r.who): r.status for r in lobby.collect()} == {("r", "u"): "accepted", ("r", None): "unknown", (None, "u"): "unknown"}
    events = [(1, 7, "view", 2.0), (2, 7, "click", 3.0), (3, 8, "error", 0.5)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    plans = [lobby] + [registry.QUERIES[q](spark, str(tmp_path)) for q in ("d20_list_flags", "d21_every_some")]
    assert all("collect_list" not in p._jdf.queryExecution().toString() for p in plans)
    assert sorted(tuple(r) for r in plans[1].collect()) == [(7, True, False, 2), (8, False, True, None)]
    assert sorted(tuple(r) for r in plans[2].collect()) == [(7, True, True), (8, False, False)]
