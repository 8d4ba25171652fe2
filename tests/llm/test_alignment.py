"""Alignments against whole texts encoded by both tokenizers and all overlaps of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import alignment, packing

ODD = ["<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "ﬁ", "é", "é", "日本語", "🎉🎉", "\n", "\n ", " \n", "\t", "  ", "   ", "'s", "don't", "12,345", "\x1f", "\x85", " ", "　", "a", "foo", "barely", "größe.", "!!", "\x00", "�", "x" * 40]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) + rng.choice(["", " ", " ", ""]) for _ in range(rng.randrange(12))) for _ in range(n)]


def plain(found: list) -> list[tuple]:
    """Each row by the tokenizers themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.pieces())
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    made = []
    for doc, text in found:
        if not text:
            made.append((doc, [], [], [], []))
            continue
        want = (" " + text).encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        ab = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ab) != want or b"".join(bb) != want:
            made.append((doc, [], [], [], []))
            continue
        ranges = []
        for parts in (ab, bb):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            ranges.append(out)
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(ranges[0][i][0], ranges[1][j][0]) < min(ranges[0][i][1], ranges[1][j][1])]
        groups, i, j = [], 0, 0
        for end in sorted({r[1] for r in ranges[0]} & {r[1] for r in ranges[1]}):
            x, y = sum(r[1] <= end for r in ranges[0]), sum(r[1] <= end for r in ranges[1])
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        made.append((doc, a, b, groups, links))
    count = Counter(p for m in made for p in set(m[4]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(doc, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, a, b, groups, links in made]


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    found = [(k, t) for k, t in enumerate(texts(1, 400))] + [(None, "foo bar"), (3, "foo bar"), (3, "foo bar"), (900, None), (901, ""), (902, "y" * 3000 + " z"), (903, " "), (904, "a b " * 2000)]
    d = str(tmp_path_factory.mktemp("aligned"))
    spark.createDataFrame([(*r, "k", 1, [2]) for r in found], "doc_id long, text string, groups string, n long, a array<int>").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d, found


def test_op11(spark, table):
    got = alignment.op11(spark, table[0]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(table[1])))
    assert sum(r.n_a == 0 for r in got) > 10 and sum(r.n_a > 0 for r in got) > 200


def test_pairs_beyond_the_hot_ones(spark, table):
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    linked = alignment.links(docs).drop("groups")
    whole = sorted(map(str, map(tuple, alignment.with_counts(linked).collect())))
    for hot in (0, 7, 60):
        assert sorted(map(str, map(tuple, alignment.with_counts(linked, hot).collect()))) == whole


def test_small_memory(spark, table, monkeypatch):
    """Chunks are forgotten, batches are small and counts come in parts."""
    for name, n in (("REMEMBERED", 5), ("BATCH", 50)):
        monkeypatch.setattr(alignment, name, n)
    chunks = alignment.Chunks(packing.vocabulary(), alignment.pieces())
    fresh = alignment.Chunks(packing.vocabulary(), alignment.pieces())
    for t in texts(2, 60):
        one = chunks([t])[0]
        assert len(chunks.names) <= 5
        monkeypatch.setattr(alignment, "REMEMBERED", 10**6)
        two = fresh([t])[0]
        monkeypatch.setattr(alignment, "REMEMBERED", 5)
        assert all((x == y).all() if not isinstance(x, str) else x == y for x, y in zip(one, two, strict=True))
    monkeypatch.setattr(alignment, "HELD", 3)
    linked = alignment.links(spark.read.parquet(f"{table[0]}/documents.parquet")).select("a", "b").toArrow().to_batches()
    found = Counter()
    for b in alignment._count(iter(linked)):
        for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found[p] += n
    assert found == Counter(x << 32 | y for b in linked for r in b.to_pylist() for x, y in zip(r["a"], r["b"], strict=True))


def test_gallop():
    rng = random.Random(4)
    for _ in range(60):
        short, long, short_at, long_at, want = [], [], [0], [0], []
        for k in range(rng.randrange(1, 8)):
            a, b = (sorted(rng.sample(range(1000 * k, 1000 * k + 200), rng.randrange(40))) for _ in range(2))
            assert alignment.gallop_one(a, b) == [sum(y < x for y in b) for x in a]
            want += [len(long) + sum(y < x for y in b) for x in a]
            short, long = short + a, long + b
            short_at.append(len(short))
            long_at.append(len(long))
        if long:
            got = alignment.gallop(np.array(short, np.int64), np.array(short_at), np.array(long, np.int64), np.array(long_at))
            assert got.tolist() == want


def test_ids_of_the_ranked_vocabulary():
    """Short texts get the ids that A's own tokenizer gives."""
    chunks = alignment.Chunks(packing.vocabulary(), alignment.pieces())
    assert chunks.fast
    rng = random.Random(9)
    for t in texts(7, 300) + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x2000, 0x2100)])) for _ in range(30)) for _ in range(300)]:
        assert chunks.encode_a(" " + t) == chunks.encoder.whole.encode(" " + t, add_special_tokens=False).ids


def test_empty(spark, empty):
    assert alignment.op11(spark, empty).collect() == []
    assert alignment.links(spark.read.parquet(f"{empty}/documents.parquet")).agg(F.count("*")).first()[0] == 0
