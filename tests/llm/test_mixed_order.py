"""What the splitting tree and the order in a shard decide, seen in op2's and mix_texts' rows."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plenum.llm import mixing


def test_op2_runs_are_disjoint_and_quotas_exact(spark, tables):
    got = mixing.op2(spark, tables).collect()
    for r in got:
        assert r.taken == sum(x.words for x in r.runs)
        seen = Counter((x["pass"], w) for x in r.runs for w in range(x.word_start, x.word_start + x.words))
        assert all(n == 1 for n in seen.values()) and all(0 <= w < r.size for _, w in seen)
    rows = mixing.measure(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "source", "text"))
    sources = mixing.plan_sources(rows).collect()
    block_of, shards = defaultdict(set), defaultdict(set)
    by_size = {(s.source_size, s.target): s for s in sources}
    assert len(by_size) == len(sources)
    for r in got:
        s = by_size[r.source_size, r.target]
        for x in r.runs:
            block_of[s["rank"], x.mix_order].add((x.shard, x["pass"]))
            shards[s["rank"], x.shard].add(x.mix_order)
    assert all(len(places) == 1 for places in block_of.values())
    for s in sources:
        counts = [b - a for a, b in zip([0, *s.ends], s.ends)]
        assert [len(shards[s["rank"], k]) for k in range(mixing.N_SHARDS)] == counts and sum(counts) == s.quota


def test_mixed_texts_come_by_shard_in_mixed_order(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("at", F.monotonically_increasing_id())
    got = [(r.at, r.text, r.part) for r in mixing.mix_texts(docs).withColumn("part", F.spark_partition_id()).collect()]
    texts = {r.at: (r.text or "").split() for r in docs.collect()}
    rows = mixing.measure(docs, keep=())
    want = sorted(mixing.mix(rows, mixing.plan_sources(rows)).collect(), key=lambda r: (r.shard, r.mix_order, r["_row"], r["pass"], r.word_start))
    assert [(at, text.split()) for at, text, _ in got] == [(r["_row"], texts[r["_row"]][r.word_start : r.word_start + r.words]) for r in want]
    assert [part for _, _, part in got] == [r.shard for r in want]
    at = [r["_row"] for r in want]
    assert at != sorted(at)


def test_large_shards_are_sorted_in_parts(spark, docs, monkeypatch):
    def rows():
        return [(r.doc_id, r.text) for r in mixing.mix_texts(docs, 4).select("doc_id", "text").collect()]

    whole = rows()
    monkeypatch.setattr(mixing, "SORTED", 2000)
    assert rows() == whole


def test_documents_stay_whole(spark, tables):
    """All but one document of each source are taken whole; targets are met to the word; a row is about a document."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "source", "text").withColumn("at", F.monotonically_increasing_id()).withColumn("n_chars", F.lit(0).cast("long"))
    got = mixing.op2(spark, tables).collect()
    cut = Counter(r.source_size for r in got for x in r.runs if x.words < r.size)
    assert all(n <= 1 for n in cut.values())
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= 0.5 + 1e-6 for (_, target), n in taken.items())
    texts = {r.at: r.text for r in docs.collect()}
    mixed = mixing.mix_texts(docs).collect()
    assert sum(r.text != texts[r.at] for r in mixed) <= len({r.source_size for r in got})
    assert all(texts[r.at].startswith(r.text) for r in mixed)


def test_mixed_rows_are_as_long_as_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = mixing.n_words(F.col("text"))
    before, after = (df.agg(F.avg(size), F.count("*")).first() for df in (docs.where(size > 0), mixing.mix_texts(docs)))
    assert abs(after[0] - before[0]) <= 0.1 * before[0] and after[1] < 2 * before[1]
