"""Every registered query against a plain computation on the same small tables, and on empty ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from plenum.llm import queries

OPS = sorted(n for n in queries.QUERIES)


def one(n):
    return next(f for name, f in queries.QUERIES.items() if name.startswith(f"op{n}_"))


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_op1(spark, tables, rows):
    got = {(r.doc_id, r.held_out, r.lang_pred, r.score) for r in one(1)(spark, tables).collect()}
    assert len(one(1)(spark, tables).collect()) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for doc_id, held, lang, score in got:
        assert held == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= score <= 1
        text = texts[doc_id]
        assert (lang == "und") == (not text or not any(map(str.isalpha, text)))
        assert lang in ("en", "de", "und")


def test_op2(spark, tables, rows):
    got = one(2)(spark, tables).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:  # share by weight, cut at the limit, share the rest again
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    source = {(r[0], size(r[1])): r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    again = one(2)(spark, tables).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_op4(spark, tables, rows):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def spans(t):
        out = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        rank = {"assign": 0, "access": 1, "hex": 2}
        return sorted(out, key=lambda s: (s[1], rank[s[0]]))

    want = Counter()
    for r in rows:
        s = spans(r[1] or "")
        n = Counter(k for k, _, _ in s)
        want[r[0], n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()] += 1
    got = one(4)(spark, tables).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    special = next(r for r in got if r.doc_id == 45)
    assert "github:" in special.spans and special.n_assign == 2 and special.n_access == 1


def test_op5(spark, tables, rows):
    got = one(5)(spark, tables).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            by[r.doc_id].add((r.n_chars, r.edited_sha256, r.near_edited, r.near_next))
    parts = lambda t: set(re.findall(r"\n*[^\n]{1,200}|\n+", t))
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    texts = {}
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, n = r[1] or "", nxt[1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        texts[r[0]] = t
        if r[0] not in (None, 36, 39):  # the repeated row may come first or second
            (n_chars, digest, near_edited, near_next) = next(iter(by[r[0]]))
            assert n_chars == len(t) and digest == hashlib.sha256(edited.encode()).hexdigest()
            assert math.isclose(near_edited, like(parts(t), parts(edited))) and math.isclose(near_next, like(parts(t), parts(n)))
    prints = {}
    for r in got:
        if r.doc_id is not None:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_op6(spark, tables):
    rows = [(r.vec_id, [math.floor(64 * x) for x in r.embedding]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for j, (c, w) in enumerate(rows) if j != i)
            for rank, (s, c) in enumerate(scored[:20], 1):
                want[q, rank, c, -s] += 1
    assert Counter(tuple(r) for r in one(6)(spark, tables).collect()) == want


def test_op7(spark, tables, rows):
    got = one(7)(spark, tables).collect()
    assert 0 < len(got) <= len(rows) and {r.doc_id for r in got} <= {r[0] for r in rows}
    assert all(math.isfinite(r.log_weight) for r in got)
    assert sorted(map(str, one(7)(spark, tables).collect())) == sorted(map(str, got))


def test_op8(spark, tables, rows):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = Counter()
    for r in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        want[r[0], len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))] += 1
    got = one(8)(spark, tables).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def brute_classes(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))], links


def test_op9(spark, tables, rows):
    got = one(9)(spark, tables).collect()
    roots, links = brute_classes([r[1] for r in rows])
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = Counter((r[0], least.get(root), n) for r, root, n in zip(rows, roots, links, strict=True))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_op10(spark, tables, rows):
    from plenum.llm import shards

    got = one(10)(spark, tables).collect()
    table = shards.fill(shards.shard_names(shards.N_SHARDS), shards.TABLE_SIZE)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        key = "n" if r.doc_id is None else f"v{r.doc_id}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % shards.TABLE_SIZE
        if r.doc_id is not None and slot == r.slot:  # a hot key is dealt out by other columns
            assert r.shard == f"shard-{table[slot]:05d}"
    assert sum(r.slot == int(hashlib.md5(f"v{r.doc_id}".encode()).hexdigest()[:15], 16) % shards.TABLE_SIZE for r in got) >= len(rows) - 4
