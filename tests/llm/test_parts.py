"""Parts of the operators: tables, sketches, distributions, redaction, mixing, hot keys."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import fingerprints, graph, langid, licenses, mixing, neardup, quality, secrets, shards, topk


def test_fill_is_even_and_stable():
    names = shards.shard_names(10)
    table = shards.fill(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = shards.fill(names[:9], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a < 9)
    assert moved < 1009 * 0.12  # besides the lost shard's slots


def test_hot_key_is_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = shards.shard_rows(rows, ["k"], shards.shard_names(8), 251, ["id"])
    assert got.count() == 3000
    assert got.where("k = 'hot'").groupBy("shard").count().agg(F.max("count")).first()[0] < 900
    assert shards.shard_rows(rows, ["k"], shards.shard_names(8), 251).where("k = 'hot'").select("shard").distinct().count() == 1


def test_trigram_clauses():
    by = {r.kind: set(r.clauses()) for r in secrets.RULES}
    assert by["hex"] == set() and by["access"] == {frozenset({"aki", "kia"})}
    assert by["assign"] == {frozenset(w[k : k + 3] for k in range(len(w) - 2)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
    assert by["github"] == {frozenset({f"gh{c}", f"h{c}_"}) for c in "pousr"}
    assert by["jwt"] == {frozenset({"eyj", ".ey"})}
    query = lambda x: set(secrets.trigram_query(x))
    assert query("ab") == query("[a-z]{9}") == query("(abc)?d") == query(r"\p{L}abc") == query("[abc&&[^d]]efg") == set()
    assert query("abc|xyz+") == {frozenset({"abc"}), frozenset({"xyz"})} and query("(?:ab){2}") == {frozenset({"aba", "bab"})}
    assert query("Éabc[xy]") == {frozenset({"abc", "bcx"}), frozenset({"abc", "bcy"})}


def random_regex(rng: random.Random, depth: int) -> str:
    sub = lambda: random_regex(rng, depth - 1)
    kind = rng.randrange(9 if depth else 3)
    if kind == 0:
        return re.escape(rng.choice(["abc", "tok", "x", "key_", "ABcd", "é"]))
    if kind == 1:
        return rng.choice(["[ab]", "[A-C]", "[a-z]", "[^a]", ".", r"\d", "[xyé]"])
    if kind == 2:
        return rng.choice(["ab", "bcd", "zz", "Key"])
    if kind == 3:
        return f"(?:{sub()}|{sub()})"
    if kind == 4:
        return f"({sub()})" + rng.choice(["?", "*", "+", "{2}", "{1,3}", "{5,}", "{3}", "{2,}+", "+?"])
    if kind == 5:
        return f"(?i:{sub()})"
    return "(?<![q])" * rng.randrange(2) + "".join(sub() for _ in range(kind - 4))


def test_clauses_miss_no_match():
    """Random expressions and texts: whatever matches satisfies a clause."""
    rng, asked, parts = random.Random(11), 0, ["abc", "tok", "x", "key_", "ABcd", "é", "a", "b", "A", "C", "zz", "Key", "bcd", "1", "."]
    for _ in range(1500):
        rule = re.compile(random_regex(rng, 4))
        clauses = secrets.trigram_query(rule.pattern)
        for _ in range(30 if clauses else 0):
            for m in rule.finditer("".join(rng.choice(parts) for _ in range(rng.randrange(14)))):
                asked += 1
                assert any(all(g in m[0].lower() for g in c) for c in clauses), rule.pattern
    assert asked > 1000


def test_rules_must_match_something():
    with pytest.raises(ValueError):
        secrets.Rule("x", "(abc)?")


def test_redact(spark):
    rows = spark.createDataFrame([("é password=abcdefgh12 x token: 12345678", "k"), ("clean", "k"), (None, "k")], "text string, kinds string")
    assert [r.text for r in secrets.redact(rows).orderBy(F.col("text").desc_nulls_last()).collect()] == ["é [SECRET] x [SECRET]", "clean", None]


def test_full_scan_rule_equals_indexed(spark, monkeypatch):
    """A rule with its trigrams finds what it finds without, whether candidates are broadcast or shuffled."""
    texts = ["token=abcdefgh1", "TOKEN = 'abcdefgh1'", "tok en=abcdefgh1", "apikey:abcdefgh2 api_key:abcdefgh3", "", None, "AKIA" + "A" * 12]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    spans = lambda: sorted(map(str, secrets.scan(rows).select("text", secrets.joined(F.col("secrets"))).collect()))
    indexed = spans()
    monkeypatch.setattr(secrets, "FEW", 0)
    assert spans() == indexed
    monkeypatch.setattr(secrets.Rule, "clauses", lambda self: ())
    assert spans() == indexed


def test_texts_of_many_matches(spark):
    """100,000 secrets in one text: found in places that follow one another, and all of them masked."""
    one = "ab" * 16
    rows = spark.createDataFrame([("\n".join([one] * 100_000) + " é token=abcdefgh1",), ("é" + one,)], "text string")
    got = {r.n: r for r in secrets.scan(rows).select(F.size("secrets").alias("n"), F.col("secrets")[0].alias("first"), F.try_element_at("secrets", F.lit(-2)).alias("late"), F.try_element_at("secrets", F.lit(-1)).alias("last")).collect()}
    assert (got[1].first.start, got[1].first.end) == (1, 33)
    assert (got[100_001].first.start, got[100_001].late.start, got[100_001].late.end) == (0, 99_999 * 33, 99_999 * 33 + 32)
    assert got[100_001].last.kind == "assign" and got[100_001].last.start == 100_000 * 33 + 2
    texts = {len(r.text): r.text for r in secrets.redact(rows).collect()}
    assert texts[100_000 * 9 + 2 + 8] == "\n".join(["[SECRET]"] * 100_000) + " é [SECRET]" and texts[9] == "é[SECRET]"


def test_redaction_cuts_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(secrets, "CHUNK", 5)
    rows = spark.createDataFrame([("é🎉 token=abcdefgh12 some words " + "c3" * 20 + " password: AKIA" + "Z9" * 8 + "; AKIA" + "B" * 12,)], "text string")
    assert secrets.redact(rows).first().text == "é🎉 [SECRET] some words [SECRET] [SECRET]; [SECRET]"


def test_sketch_peels_what_differs(spark):
    rng = random.Random(3)
    for n, d in ((40, 3), (200, 30), (900, 700), (0, 0), (0, 5)):
        common = [rng.getrandbits(62) for _ in range(n)]
        a, b = common + [rng.getrandbits(62) for _ in range(d)], common + [rng.getrandbits(62) for _ in range(d // 2)]
        row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        want = 1.0 if not a and not b else n / len(set(a) | set(b))
        assert math.isclose(row.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).first().x, want)
    row = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5])], "a array<long>, b array<long>")
    for width in (7, 1000):
        w = F.lit(width).cast("long")
        got = row.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a"), w), fingerprints.sketch(F.col("b"), w)), w).alias("p")).first().p
        assert sorted(got.a) == [1, 2] and got.b == [5] and got.cells == []


def test_sketch_sums_cells(spark):
    """Each cell against its sums worked out one by one, and what is left where peeling sticks."""
    rng = random.Random(5)
    found = [rng.getrandbits(62) for _ in range(60)]
    row = spark.createDataFrame([(found,)], "a array<long>")
    w = F.lit(11).cast("long")
    at = row.select(F.transform("a", lambda d: F.struct(d.alias("d"), F.xxhash64(d, F.lit(99)).alias("h"), *[(F.pmod(F.xxhash64(d, F.lit(j)), w) + 11 * j).alias(f"i{j}") for j in range(3)])).alias("x")).first().x
    want = {}
    for x in at:
        for i in (x.i0, x.i1, x.i2):
            c, k, h = want.get(i, (0, 0, 0))
            want[i] = c + 1, k ^ x.d, h ^ x.h
    got = row.select(fingerprints.sketch(F.col("a"), w).alias("s"), fingerprints.peel(fingerprints.sketch(F.col("a"), w), w).alias("p")).first()
    assert {e.i: (e.c, e.k, e.h) for e in got.s} == want
    assert got.p.cells and len(got.p.a) < 60 and set(got.p.a) <= set(found)


def test_thousands_of_different_paragraphs(spark, tmp_path):
    """Long texts that differ in thousands of lines, in op5's rows."""
    texts = ["\n".join(f"line {k} {j}" for j in range(7000)) for k in range(2)] + ["\n".join(f"line 0 {j}" for j in range(500, 7000))]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op5(spark, str(tmp_path)).collect()}
    parts = [set(re.findall(r"\n*[^\n]{1,200}|\n+", t)) for t in texts]
    for k in range(3):
        a, b = parts[k], parts[(k + 1) % 3]
        assert math.isclose(got[k].near_next, len(a & b) / len(a | b))
        cut = len(texts[k]) // 4
        b = set(re.findall(r"\n*[^\n]{1,200}|\n+", texts[k][: len(texts[k]) - cut] + texts[(k + 1) % 3][:cut]))
        assert math.isclose(got[k].near_edited, len(a & b) / len(a | b))


def test_next_over_groups(spark, monkeypatch):
    """Small, huge, negative, repeated and null keys; no group is large."""
    monkeypatch.setattr(fingerprints, "GROUP", 7)
    rng = random.Random(1)
    huge = [(1 << 61) + rng.randrange(1 << 60) for _ in range(100)]
    for ids in (rng.sample(range(1000), 100), huge, [(1 << 62) + k for k in range(100)], [-5, (1 << 63) - 1, 0] * 30, [3] * 80 + [None] * 20, [None], [4]):
        rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").withColumn("_row", F.monotonically_increasing_id())
        order = sorted(((i is None, i or 0, r, t) for i, t, r in rows.collect()))
        led = fingerprints.with_next(rows, "doc_id", ["text"])
        assert {r.text: r.next_text for r in led.collect()} == {a[3]: b[3] for a, b in zip(order, order[1:] + order[:1], strict=True)}
        bounds = [tuple(b) for b in fingerprints.bounds_of(rows, len(ids), "doc_id")]
        sizes = Counter(sum(b <= x[:3] for b in bounds) for x in order)
        assert max(sizes.values()) <= max(35, len(ids) // 3)


def test_a_sketch_that_never_peels_is_told(spark, monkeypatch):
    """After all attempts the query fails rather than guess."""
    stuck = F.struct(F.array(F.lit(1)).alias("cells"), F.array().cast("array<bigint>").alias("a"), F.array().cast("array<bigint>").alias("b"))
    widths = []
    monkeypatch.setattr(fingerprints, "peel", lambda cells, width: widths.append(width) or stuck)
    rows = spark.createDataFrame([("one\ntwo", "one\nthree")], "a string, b string").select(*[fingerprints.digests(F.col(c)).alias(c) for c in "ab"])
    with pytest.raises(Exception, match="a sketch did not peel"):
        rows.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()
    assert len(widths) >= 2  # the stored tables, and the larger ones of the later attempts


def test_hypergeometric(spark):
    rows = spark.range(4000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(100).cast("long"), F.lit(20).cast("long"), mixing.uniform(F.col("id"))).alias("x"))
    c = Counter(r.x for r in rows.collect())
    pmf = {k: math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20) for k in range(21)}
    assert all(abs(c[k] / 4000 - p) < 4 * math.sqrt(p / 4000) + 0.002 for k, p in pmf.items())
    edge = spark.range(1).select(*[mixing.hypergeometric(F.lit(g).cast("long"), F.lit(n).cast("long"), F.lit(d).cast("long"), F.lit(0.5)) for g, n, d in ((0, 0, 0), (5, 5, 3), (0, 9, 4), (7, 9, 9))]).first()
    assert list(edge) == [0, 3, 0, 7]


def test_quotas_are_exact(spark):
    quotas = [(0, 1000), (1, 1), (2, 0), (3, 333)]
    got = {r.rank: r.ends for r in mixing.split_quotas(spark.createDataFrame(quotas, "rank int, quota long"), 7).collect()}
    assert {k: e[-1] for k, e in got.items()} == dict(quotas) and all(len(e) == 7 and e == sorted(e) for e in got.values())
    sizes = [sum(e[k] - (e[k - 1] if k else 0) for e in got.values()) for k in range(7)]
    assert max(sizes) - min(sizes) <= 2


def test_mix_texts(spark, docs, rows):
    out = mixing.mix_texts(docs)
    assert out.columns == docs.columns
    got = out.select("doc_id", "text", "n_chars", "size", "pass").collect()
    words = lambda t: len((t or "").split())
    assert all(r.text and r.n_chars == len(r.text) and r.size == 1 and r["pass"] == 1 for r in got)
    whole = Counter()
    for r in got:
        whole[r.doc_id] += words(r.text)
    total = Counter()
    for r in rows:
        total[r[0]] += words(r[1])
    assert all(n <= 2 * total[k] for k, n in whole.items())


def test_license_templates_tolerate_edits(spark):
    long = next(t for t in licenses.TEMPLATES if t.label == "bsd").text.split()
    edited = long[:6] + ["really"] + long[6:11] + long[12:]
    rows = spark.createDataFrame([(1, "intro words " + " ".join(edited) + " and so on"), (2, " ".join(long[:6])), (3, "general public, LICENSE general public license")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, [s.label for s in r.spans], [s.start for s in r.spans]) for r in licenses.scan(rows).collect()}
    assert got[1][1] == ["bsd"] and got[2][1] == [] and got[3][1] == ["gpl", "gpl"] and got[3][2] == [0, 3]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 103), (7, 7)] + [(200 + rng.randint(0, 5), 200 + rng.randint(0, 5)) for _ in range(9)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 103)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group of near copies, verified in several blocks, and chains of links over blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    texts = []
    for _ in range(70):
        w = list(base)
        w[rng.randrange(len(w))] = f"new{rng.randint(0, 40)}"
        texts.append(" ".join(w))
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        texts.append(" ".join(chain[4 * k :] + [f"d{j}" for j in range(4 * k)]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(rows).collect()}
    sets = [neardup.Shingles()(t) for t in texts]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: (find(i), links[i]) for i in range(len(sets))}


def test_bands():
    bands, rows = neardup.bands_for()
    assert bands * rows <= neardup.MOST_HASHES and 1 - (1 - neardup.THRESHOLD**rows) ** bands >= neardup.RECALL


def test_deduplicate_keeps_columns(spark, docs):
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns and out.where("_row = 3").count() == out.count() < docs.count()


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([0.5, rng.random(), rng.gauss(0, 1e6), -3.0]) for _ in range(6000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").cache()
    order = sorted(values, reverse=True)
    for k in (1, 2, 1500, 3000, 4321, 6000):
        v, r = quality.kth_largest(rows, "v", k)
        assert v == order[k - 1] and r == k - sum(x > v for x in values)


def test_quality_parts_junk(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(40))
    junk = lambda: " ".join(rng.choice(["ALPHA!!", "BETA!!", "|"]) for _ in range(40))
    rows = [(k, junk() if k % 5 == 0 else good()) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 5 == 0 else 1) for k in range(100)], "doc_id long, quality int")
    assert {r.doc_id for r in quality.classify(docs, labels).collect()} == {k for k in range(300) if k % 5}
    assert quality.draw(*quality.weigh(docs, labels.limit(0))).count() > 0


def test_threshold_search_is_exact():
    rng = np.random.default_rng(0)
    points = rng.integers(-5, 6, (300, 8)).astype(float)
    ids = rng.permutation(300)
    down = np.argsort(-points, axis=0, kind="stable").T
    for own in range(0, 300, 17):
        q = points[own] * (rng.random(8) < 0.7)
        got = topk.threshold_search(points, ids, np.arange(300), q, own, down, 20, step=4)
        s = points @ q
        want = sorted((k for k in range(300) if k != own), key=lambda k: (-s[k], ids[k]))[:20]
        assert list(got) == want


def test_threshold_search_leaves_what_the_floor_excludes():
    rng = np.random.default_rng(1)
    points, ids = rng.integers(-5, 6, (300, 8)), rng.permutation(300)
    down = np.argsort(-points, axis=0, kind="stable").T
    for own in range(0, 300, 29):
        s = points @ points[own]
        for floor in sorted({int(s.max()) + 1, int(np.sort(s)[-3]), 0, int(s.min())}):
            got = topk.threshold_search(points, ids, np.arange(300), points[own], own, down, 20, step=4, floor=floor)
            assert list(got) == sorted((k for k in range(300) if k != own and s[k] >= floor), key=lambda k: (-s[k], ids[k]))[:20]


@pytest.mark.parametrize("candidates, growth", [(23, 2), (50, 4), (400, 4)])
def test_search_over_many_blocks(spark, monkeypatch, candidates, growth):
    """Rounds with floors find what a plain search finds, with copies, ties over blocks and queries of few candidates."""
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "GROWTH", growth)
    monkeypatch.setattr(topk, "QUERIES", 9)
    rng = random.Random(8)
    rows = [(rng.randrange(250), [rng.randint(-3, 3) for _ in range(5)]) for _ in range(260)] + [(k, [1, 1, 1, 0, 0]) for k in range(60)] + [(500, [0] * 5), (520, [10**9, 0, 0, 0, 0]), (540, []), (None, [1] * 5), (560, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").coalesce(3)
    for k in (3, 70):
        want = Counter()
        fine = [(i, v) for i, v in rows if i is not None and v is not None]
        for a, (q, v) in enumerate(fine):
            if q % 20 == 0:
                scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), c) for b, (c, w) in enumerate(fine) if a != b)
                want.update((q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1))
        assert Counter(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k).collect()) == want


@pytest.mark.parametrize("threshold", [0.8, 0.5, 0.97])
def test_blocks_of_all_that_can_be_linked_meet_once(spark, monkeypatch, threshold):
    """Of every component each two sets of sizes that can be linked meet in one pair of blocks; a large one of many sizes leaves most other pairs out."""
    monkeypatch.setattr(neardup, "BLOCK", 6)
    rng = random.Random(5)
    sizes = {1: [rng.choice([4, 5, 1, 2, 8, 10]) for _ in range(40)], 2: [100] * 50, 3: [3, 900, 1200], 4: [int(1.05**k) + 1 for k in range(200)], 5: [7]}
    rows = [(100 * label + k + 1000 * (label == 5), label, 1, n) for label, ns in sizes.items() for k, n in enumerate(ns)]
    got = neardup.blocks_of(spark.createDataFrame(rows, "node long, label long, copies long, n long"), threshold)
    groups: dict = {}
    for r in got.withColumn("_met", neardup.meetings()).select("label", "_met.one", "_met.two", "node", "block").collect():
        groups.setdefault((r.label, r.one, r.two), []).append((r.node, r.block))
    met: Counter = Counter()
    for (label, one, two), nodes in groups.items():
        assert all(b in (one, two) for _, b in nodes)
        left, right = [v for v, b in nodes if b == one], [v for v, b in nodes if b == two]
        met.update((label, *sorted((a, b))) for a in left for b in right if (a < b if one == two else True))
    assert set(met.values()) <= {1}
    for label in sizes:
        own = [(v, n) for v, c, _, n in rows if c == label]
        for i, (a, m) in enumerate(own):
            for b, n in own[:i]:
                if min(m, n) >= threshold * max(m, n):
                    assert met[(label, *sorted((a, b)))] == 1
    assert sum(c[0] == 3 for c in met) == 3  # one block
    assert sum(c[0] == 4 for c in met) < 0.35 * 199 * 100


def test_network_lookup_equals_convolution():
    rng = np.random.default_rng(3)
    net = langid.Network(["a", "b"], [rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], rng.normal(size=(langid.FILTERS * 3, 2)).astype(np.float32), np.zeros(2, np.float32))
    text = bytes(rng.integers(97, 123, 300, np.uint8))
    n = (len(text) + langid.REACH - 1) // langid.WINDOW + 1
    padded = np.frombuffer(text.ljust(n * langid.WINDOW + 4, b"\0"), np.uint8)
    logits = []
    for k in range(n):
        h = []
        for w, c in zip(langid.WIDTHS, net.conv, strict=True):
            h.append(np.max([sum(c[j][padded[k * langid.WINDOW + i + j]] for j in range(w)) for i in range(langid.WINDOW)], axis=0))
        logits.append(np.concatenate(h) @ net.top)
    z = np.mean(logits, axis=0)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(langid.Reader(net)([text, b"x", text])[0], p, atol=1e-4)
    assert langid.Reader(net)([b"x" * k for k in (1, 124, 125, 126, 128, 129)]).shape == (6, 2)


def test_language_of_copies_is_learned(spark):
    """A language whose rows all hold one text, among many different texts of another, and languages beyond the bound."""
    rng = random.Random(7)
    words = ["water", "stone", "river", "little", "house", "green", "under", "morning"]
    rows = [("der große Fluss fließt über die alte Brücke", "de")] * 3000 + [(" ".join(rng.choice(words) for _ in range(30)), "en") for _ in range(3000)] + [(None, "fr"), ("nobody knows", None), ("...", "xx")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    drawn = Counter(lang for lang, _ in langid.sample(df))
    assert drawn["de"] == langid.WINDOWS and drawn["en"] == langid.TEXTS * langid.WINDOWS and "fr" not in drawn
    net = langid.fit(df)
    assert net.langs == ["de", "en"]
    got = langid.predict(spark.createDataFrame([("die Brücke über den Fluss",), ("little house under stone",), ("12",), (None,)], "text string"), net, []).collect()
    assert [r.lang_pred for r in got] == ["de", "en", "und", "und"]


def test_most_frequent_of_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    monkeypatch.setattr(langid, "MOST_WINDOWS", 3 * langid.WINDOWS * 2)
    rows = spark.createDataFrame([(f"text {k} of {lang}", lang) for lang, n in (("a", 9), ("b", 5), ("c", 5)) for k in range(n)], "text string, lang string")
    assert Counter(lang for lang, _ in langid.sample(rows)) == {"a": 3 * langid.WINDOWS, "b": 3 * langid.WINDOWS}


def test_held_out_accuracy(spark):
    """Languages of different words and letters: nearly all texts that were not learned from are told apart."""
    rng = random.Random(8)
    words = {"x": ["the", "and", "which", "house"], "y": ["und", "größe", "nicht", "straße"], "z": ["était", "leçon", "où", "fenêtre"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 60))), lang) for k, lang in enumerate(rng.choice("xyz") for _ in range(600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", langid.held_out(F.col("doc_id")))
    got = langid.predict(df.where("held"), langid.fit(df.where("NOT held")), ["lang string"]).collect()
    assert len(got) > 80 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_weights_and_draw_against_plain_counts(spark):
    """Counts, ratios, keys and the k largest, each written a second time."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["good", "Fine,", "x9", "BAD!!", "bad", "|"]) for _ in range(rng.randint(0, 25))) for _ in range(160)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3)
    labels = [(k, int("good" in (texts[k] or ""))) for k in range(0, 160, 2)] + [(2, 0), (2, 1), (None, 1), (4, None), (999, 1)]
    best = {}
    for k, q in labels:
        if k is not None and q is not None:
            best[k] = max(q, best.get(k, 0))
    raw, target = Counter(), Counter()

    def shape(w):
        return re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w))

    grams = quality.Features()
    for k, t in enumerate(texts):
        raw.update(grams(t).tolist())
        if best.get(k) == 1:
            target.update(grams(t).tolist())
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = [sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in grams(t).tolist()) for t in texts]
    scored, k = quality.weigh(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = scored.collect()
    assert len(got) == len(texts)
    assert all(math.isclose(r.log_weight, weight[r.doc_id], rel_tol=1e-4, abs_tol=1e-4) for r in got)
    noise = {r.doc_id: r.key - r.log_weight for r in got}
    ranks = np.exp(-np.exp(-np.sort(list(noise.values()))))
    assert np.abs(ranks - (np.arange(len(ranks)) + 0.5) / len(ranks)).max() < 1.6 / math.sqrt(len(ranks))  # the noise is Gumbel's
    cut = quality.cut(scored, quality.labelled(spark.createDataFrame(labels, "doc_id long, quality int")))
    errors = lambda x: sum(weight[i] < x for i, q in best.items() if q and i < 162) / sum(q for i, q in best.items() if i < 162) + sum(weight[i] >= x for i, q in best.items() if not q) / sum(1 - q for q in best.values())
    assert errors(cut) <= min(errors(w + 1e-6) for w in weight) + quality.SLACK + 1e-9
    assert k == sum(r.log_weight >= cut for r in got)
    drawn = {r.doc_id for r in quality.draw(scored, k).collect()}
    assert drawn == {r.doc_id for r in sorted(got, key=lambda r: -r.key)[:k]}
    assert [shape(w) for w in ("Fine,", "BAD!!", "x9")] == ["Xx,", "X!", "x9"]
    assert len(grams("good Fine, x9")) == 3 + 2 + 3 + 2 + 1


def test_level_weights_part_good_from_bad(spark):
    """On a corpus that is small beside the buckets: n-grams without evidence weigh nothing, and good texts outweigh bad ones."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["good", "Fine,", "x9", "BAD!!", "bad", "|"]) for _ in range(rng.randint(0, 25))) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3)
    labels = spark.createDataFrame([(k, int("good" in texts[k])) for k in range(0, 160, 2)], "doc_id long, quality int")
    scored, _ = quality.weigh(docs, labels, level=True)
    w = {r.doc_id: r.log_weight for r in scored.collect()}
    good, bad = [w[k] for k in range(0, 160, 2) if "good" in texts[k]], [w[k] for k in range(0, 160, 2) if "good" not in texts[k]]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.8  # 0.10 with raw counts as they are
    ratio = quality.log_ratios(docs, quality.labelled(labels), level=True)
    seen = {g for t in texts for g in quality.Features()(t).tolist()}
    assert all(ratio[k] == 0 for k in range(0, quality.BUCKETS, 97) if k not in seen)


def test_labels_are_bounded_by_ids(spark):
    labels = spark.createDataFrame([(1, 1)] * 50 + [(k, 0) for k in range(2, 12)], "doc_id long, quality int")
    assert quality.labelled(labels, 20).count() == 11 and quality.labelled(labels, 5).count() == 5


def test_table_by_turns():
    """The lookup table, claimed step by step from written-out permutations."""
    import hashlib

    names, size = ["a", "b", "c"], 13
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    wish = [[(number(f"offset:{s}") + j * (number(f"skip:{s}") % (size - 1) + 1)) % size for j in range(size)] for s in names]
    assert all(sorted(w) == list(range(size)) for w in wish)
    owner = {}
    while len(owner) < size:
        for k, w in enumerate(wish):
            free = [slot for slot in w if slot not in owner]
            if free:
                owner[free[0]] = k
    assert shards.fill(names, size) == [owner[slot] for slot in range(size)]


def test_clashing_names(spark, docs, rows):
    """Columns called like inner ones pass unchanged; a sharding key may be called slot."""
    names = docs.columns
    placed = shards.shard_rows(docs, ["doc_id"], shards.shard_names(4), 251, ["text"])
    others = [c for c in names if c not in ("slot", "shard")]
    assert placed.columns == [*others, "slot", "shard"]
    assert Counter(map(str, placed.select(*others).collect())) == Counter(map(str, docs.select(*others).collect()))
    assert shards.shard_rows(docs, ["slot"], shards.shard_names(4), 251).select("shard").distinct().count() == 1
    free = [c for c in names if c not in ("n_words", "spans")]
    found = licenses.scan(docs, keep=tuple(free))
    assert found.columns == [*free, "n_words", "spans"]
    assert Counter(map(str, found.select(*free).collect())) == Counter(map(str, docs.select(*free).collect()))
    measured = mixing.measure(docs, keep=tuple(names)).select("kept.*")
    assert measured.columns == names and measured.count() == len(rows)
    assert secrets.scan(docs).columns == [*names, "secrets"]


def test_shuffled_input_is_written_first(spark):
    """Places of rows hold for an input whose order is not settled."""
    rows = spark.range(400).select("id", F.concat(F.lit("token=abcdefgh"), F.col("id").cast("string")).alias("text")).repartition(7, F.rand())
    got = secrets.redact(rows.withColumn("own", F.col("text"))).collect()
    assert {r.text for r in got} == {"[SECRET]"} and len({r.own for r in got}) == 400
    mixed = mixing.mix_texts(rows.select("id", "text", F.lit("s").alias("source"), F.lit(0).alias("n_chars"))).collect()
    assert all(r.text == f"token=abcdefgh{r.id}" for r in mixed)


def test_large_groups_go_by_way_of_others(spark):
    """Edges into a hub are dealt over nodes between; components stay."""
    star = spark.createDataFrame([(k, 0) for k in range(1, 3000)], "a long, b long")
    dealt = graph.fanned(star)
    assert dealt.groupBy("b").count().agg(F.max("count")).first()[0] <= 256
    assert graph.components(star).where("label = 0").count() == 3000
    banded = spark.createDataFrame([(k, 7) for k in range(3000)] + [(k, 8) for k in range(2999, 3100)] + [(5000, 9)], "node long, band long")
    edges = neardup.band_edges(banded)
    assert edges.groupBy("b").count().agg(F.max("count")).first()[0] <= 300
    assert {r.node for r in graph.components(edges).where("label = 0").collect()} == set(range(3100))


def test_lookups_of_hot_keys(spark):
    rows = spark.createDataFrame([(k, 0 if k < 500 else k) for k in range(1000)] + [(2000, None), (2001, 5000)], "id long, key long")
    table = spark.createDataFrame([(k, f"v{k}", 500 if k == 0 else 1) for k in range(1000)], "key long, value string, n long")
    got = graph.look_up(rows, table, ["key"], F.col("n") > 100)
    assert {(r.id, r.value) for r in got.collect()} == {(k, "v0" if k < 500 else f"v{k}") for k in range(1000)} | {(2000, None), (2001, None)}
