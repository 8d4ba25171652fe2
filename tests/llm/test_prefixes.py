"""The trie against a plain walk over all prefixes, over many partitions, and against its SQL twin."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plenum.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, key string, words int, place long, depth int"


def plain(rows):
    """The nodes by a dictionary of prefixes."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append(((t is not None, t or 0), digest, role, text))
    turns = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def get(df):
    return sorted(map(tuple, prefixes.trie(df).collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA)


def draw(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 3 * n), n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "a", None]), rng.choice(["one two", "x", "", None, "three  words here"])))
    return rows + rows[:5] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_walk(spark, seed):
    rows = draw(seed, 120)
    assert get(make(spark, rows)) == sorted(plain(rows), key=str)


def test_groups_over_many_partitions(spark):
    """Copies, common beginnings and empty conversations that reach over several partitions."""
    rng = random.Random(3)
    first = [("user", "hello there"), ("bot", "hi"), ("user", "a b c"), ("bot", "d"), ("user", "e f")]
    rows = []
    for c in range(400):
        n = 4 if c < 150 else rng.randrange(6)
        rows += [(c, t, *first[t]) for t in range(n if c % 20 else max(n, 3))]
        if c >= 150 and rng.random() < 0.5:
            rows.append((c, 9, "user", str(rng.randrange(4))))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = get(make(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(plain(rows), key=str)


def test_deep_and_single(spark):
    rows = [(7, t, "user", f"t {t}") for t in range(1500)] + [(8, t, "user", f"t {t}") for t in range(1500)]
    got = get(make(spark, rows))
    want = sum(zlib.crc32(str(c).encode()) % 4 for c in (7, 8))
    assert len(got) in range(1500 - want, 3001) and max(r[1] for r in got) == 1500 - min(zlib.crc32(b"7") % 4, zlib.crc32(b"8") % 4)
    assert get(make(spark, rows[:0])) == []
    assert get(make(spark, [(1, None, None, None)])) == sorted(plain([(1, None, None, None)]), key=str)


def test_range_minima():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.integers(0, 6, n)
        m, rows, depth = prefixes.Minima(v), rng.integers(0, n, 200), rng.integers(0, 7, 200)
        for r, d, right, left in zip(rows, depth, m.right(rows, depth), m.left(rows, depth), strict=True):
            assert right == next((k - 1 for k in range(r + 1, n) if v[k] < d), n - 1)
            assert left == next((k for k in range(r, 0, -1) if v[k] < d), 0)
        a, b = np.minimum(rows[:100], rows[100:]), np.maximum(rows[:100], rows[100:])
        assert m.least(a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b, strict=True)]


def test_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(prefixes.ORACLE)
    got = prefixes.op13(spark, d)
    assert want.columns == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
