"""Base spans against the plain expressions, reliabilities against planted ones, and the classifier on texts with and without personal data."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


#: Texts that only expressions in linear time get through.
LONG = (-8, -9, -10, -11, -12)


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        odd, even = d[-1::-2], d[-2::-2]
        return 13 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def card(rng, n=16):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if holds("card", head + c))


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "foo", "@", "b.co", "x@y.de", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3", ".5", "+1", "+49 (30) 1234-567", "(017) 555-7713", "4", "42", "0000", "-", " ", ".", "é", "🎉", "%", "+", "007.008.009.010", "1" * 25 + ".1.1.1", "0" * 30 + "1.2.3.4", "a@b@c.d@e.f"]
    return ["".join(rng.choice([*bits, card(rng), card(rng, 14)]) + rng.choice(["", "", " ", "-"]) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_base_spans(spark, tmp_path):
    found = [(k, t) for k, t in enumerate(texts(3, 1500))] + [(None, "x@y.de"), (5, "x@y.de"), (5, "x@y.de"), (6, None), (7, ""), (-8, "a" * 200_000 + "@" + "b." * 100_000), (-9, "1" * 300_000), (-10, "1." * 100_000), (-11, "+1" * 100_000), (-12, "x@y.de " * 20_000), (-13, "1." * 500), (-14, "+1" * 500), (-15, "a" * 900 + "@" + "b." * 300)]
    spark.createDataFrame([(*r, "k", 1) for r in found], "doc_id long, text string, kept string, found int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = personal.op12(spark, str(tmp_path)).collect()
    want = []
    for doc, text in found:
        s = plain(text) if doc not in LONG else []
        want.append((doc, *[sum(x[0] == k for x in s) for k in PLAIN], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r)[:6] for r in got if r.doc_id not in LONG))) == sorted(map(str, (w for w in want if w[0] not in LONG)))
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got if r.doc_id in LONG} == {-8: (1, 0, 0, 0), -9: (0, 0, 0, 0), -10: (0, 25_000, 0, 0), -11: (0, 0, 0, 0), -12: (20_000, 0, 0, 0)}
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [personal.KINDS.index(x[0]) for x in spans] == sorted(personal.KINDS.index(x[0]) for x in spans)
        assert len({tuple(x) for x in spans}) == len(spans)


def test_reliabilities_are_found_again():
    """Votes drawn from known reliabilities: the estimates come near, and the labeler that says nothing useful is told apart."""
    rng = np.random.default_rng(1)
    n, right = 20_000, np.array([0.95, 0.85, 0.5, 0.7, 0.8])
    true = rng.random(n) < 0.3
    voted = np.where(rng.random((n, 5)) < right, true[:, None], ~true[:, None]) * 2
    voted[rng.random((n, 5)) < 0.2] = 1
    rows, counts = np.unique(voted, axis=0, return_counts=True)
    model = personal.estimate(np.zeros(len(rows), np.int64), rows, counts.astype(float))
    yes = model.says[1, 0, :, 2] / (model.says[1, 0, :, 2] + model.says[1, 0, :, 0])
    assert np.abs(yes - right).max() < 0.03 and abs(model.prior[0] - 0.3) < 0.02
    p = model.probability(np.zeros(n, np.int64), voted)
    assert ((p > 0.5) == true).mean() > 0.93


def test_votes_are_packed_and_unpacked():
    for v in ([1, 0, -1, 1, 0], [-1] * 5, [1] * 5):
        assert (personal.unpacked(np.array([personal.packed(v)]))[0] - 1).tolist() == v


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "velit", "esse"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for k in range(600):
        d = lambda n: "".join(rng.choice("123456789") for _ in range(n))
        kind = k % 8
        bit = {
            0: f"email me at user{d(2)}@mail{d(1)}.com", 1: f"call {'+49 30 ' + d(3) + ' ' + d(4)}", 2: f"card {card(rng)}", 3: f"server 10.{d(2)}.{d(2)}.{d(2)}",
            4: f"order {d(16)}", 5: f"phone (0{d(2)}) {d(3)}-{d(4)}", 6: f"write to user{d(2)} [at] mail{d(1)} [dot] com", 7: "",
        }[kind]
        if kind == 4 and holds("card", bit.split()[1]):
            bit = ""
        rows.append((k, f"{say(6)} {bit} {say(6)}"))
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)


def test_added_and_clean(spark, corpus):
    got = {r.kept.doc_id: r.personal for r in personal.detect(corpus).collect()}
    assert len(got) == 600
    for kind, name in enumerate(["email", "phone", "card", "ip"]):
        assert all([s.kind for s in got[k]] == [name] and got[k][0].base for k in range(kind, 600, 8))
    assert not any(got[k] for k in range(4, 600, 8)) and not any(got[k] for k in range(7, 600, 8))
    for kind, name in ((5, "phone"), (6, "email")):
        added = [got[k] for k in range(kind, 600, 8)]
        assert sum([s.kind for s in x] == [name] and not x[0].base for x in added) >= 0.9 * len(added)


def test_runs_agree(spark, corpus):
    rows = [personal.detect(c).select("kept.doc_id", personal.joined(F.col("personal"))).collect() for c in (corpus, corpus.repartition(5))]
    assert sorted(rows[0]) == sorted(rows[1])


def test_empty(spark, empty):
    assert personal.op12(spark, empty).collect() == []
    assert personal.detect(spark.createDataFrame([("nothing here",), (None,)], "text string"), keep=("text",)).select("personal").collect() == [([],), ([],)]
