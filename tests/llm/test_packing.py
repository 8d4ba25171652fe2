"""Packing: ids, windows and edge cases against the tokenizer itself."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

from plenum.llm import packing


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(packing.vocabulary())


TEXTS = [None, "", "a", "Hello  world\n\n  x's don't 123 ½² été “quoted” — dash…", "tab\there\x1cand wide space", "<|endoftext|> inside", "混合 text 한국어 עברית", "word_with_underscore __x__ 12_3", "é combining", "😀 ok", "ABC" * 5000, " \n \t  ", "x’s it’s"]


def test_encoder_equals_tokenizer(tok):
    enc = packing.Encoder(packing.vocabulary())
    rng = random.Random(3)
    more = ["".join(rng.choice("ab Z1_'.\n\té ½²ß’… 　x中") for _ in range(60)) for _ in range(400)]
    for t in [x for x in TEXTS if x] + more:
        want = b"".join(i.to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids)
        assert enc(t) == want, t


def test_other_tokenizers_go_whole():
    """A tokenizer that changes texts and splits them otherwise gives its own ids."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, own = packing.Encoder(path), Tokenizer.from_file(path)
    assert not enc.split and packing.Encoder(packing.vocabulary()).split
    for t in [x for x in TEXTS if x]:
        assert enc(t) == b"".join(i.to_bytes(4, "little") for i in own.encode(t, add_special_tokens=False).ids)


def test_little_padding(spark):
    """Full windows, and rests cut at powers of two: next to no padding, and every length is one of these."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([3, 40, 700, 5000])))) for k in range(150)]
    by = {}
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    padded = sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in by.values())
    assert all(n >= packing.FULL or n & (n - 1) == 0 for n in by.values())
    assert padded <= 0.02 * sum(by.values())


def test_pack_covers_every_id(spark, tok):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(1, "repeated", "y"), (1, "repeated", "y"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(df).collect()
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.length for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    ids = b"".join(i.to_bytes(4, "little") for i in tok.encode(TEXTS[10], add_special_tokens=False).ids) + (1).to_bytes(4, "little")
    for r in got:
        if r.doc_id == 10:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids) // 4


def test_best_fit_is_tightest():
    assert packing.best_fit_decreasing([]) == []
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        windows = []  # the same by exhaustive search
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [w for w in windows if 64 - sum(lengths[i] for i in w) >= lengths[k]]
            best = min(fits, key=lambda w: 64 - sum(lengths[i] for i in w), default=None)
            if best is None:
                windows.append([k])
            else:
                best.append(k)
        got = packing.best_fit_decreasing(lengths, 64)
        assert sorted(sum(lengths[i] for i in w) for w in got) == sorted(sum(lengths[i] for i in w) for w in windows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
