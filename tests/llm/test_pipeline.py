"""Each stage of the pipeline against a plainer computation on what it was given."""

import re
from collections import Counter

import pytest
from test_ops import brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from plenum.llm import packing

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    """The input and every stage's rows, each written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs.select(*COLUMNS).collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
        out.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    return out


def test_quality_keeps_rows_as_they_are(stages):
    before, after = Counter(map(tuple, stages[0])), Counter(map(tuple, stages[1]))
    assert after and not after - before


def test_one_of_each_class(stages):
    before, after = stages[1], stages[2]
    roots, _ = brute_classes([r.text for r in before])
    least = {}
    for r, root in zip(before, roots, strict=True):
        key = (r.doc_id is None, r.doc_id or 0)
        least[root] = min(least.get(root, key), key)
    assert Counter(r.doc_id for r in after) == Counter(None if none else i for none, i in least.values())


def test_secrets_are_masked(stages):
    before, after = stages[2], stages[3]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    marked = [r for r in after if r.text and "[SECRET]" in r.text]
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
    for r in after:
        assert not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|ghp_[A-Za-z0-9]{36}", r.text or "")
    clean = {(r.doc_id, r.text) for r in before} & {(r.doc_id, r.text) for r in after}
    assert len(clean) >= len(before) - len(marked) - 1


def test_mix_is_near_its_targets(stages):
    before, after = stages[3], stages[4]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r.text) for r in before)
    assert abs(sum(words(r.text) for r in after) - 1.5 * total) <= 0.01 * total + 8
    have = {}
    for r in before:
        have.setdefault(r.doc_id, Counter()).update((r.text or "").split())
    got = {}
    for r in after:
        got.setdefault(r.doc_id, Counter()).update(r.text.split())
    for k, c in got.items():
        assert all(n <= 2 * have[k][w] for w, n in c.items())


def test_packing_holds_all_ids(stages):
    tok = Tokenizer.from_file(packing.vocabulary())
    want = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == want


def test_run(spark, tables, stages):
    got = corpus_pipeline.run(spark, tables).collect()
    assert sum(r.length for r in got) == sum(r.length for r in stages[5])


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
