"""Near-duplicates: an n-gram Jaccard join by MinHash banding.

Rows with the same set of word n-grams are one representative from the start. MinHash signatures of the sets are cut
into bands, and representatives that share a band are candidates. Every candidate component is verified on the full
n-gram sets, in blocks of bounded size: the tasks count the links of each representative and join the linked ones,
so no pair is ever written. A component of more than one block is cut by the sizes of its sets into classes, so wide
that linked sets are in one class or in two that follow each other; others don't meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.graph import HOT, components, fanned, look_up
from plenum.llm.lineage import numbered, settled

N, THRESHOLD = 5, 0.8
RECALL, MOST_HASHES = 0.999, 144
#: Representatives of a block, and their n-grams in all (8 bytes each), about; columns of the matrix that counts common n-grams at once.
BLOCK, GRAMS, COLUMNS = 1024, 2 << 20, 2048
#: Blocks of a class are numbered from a multiple of this.
CLASS = 1 << 32
#: Words that a Python worker remembers; n-grams that are hashed at once.
REMEMBERED, CHUNK = 300_000, 4096
SEED = 9


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many bands as reach `recall` at `threshold` need at most `most` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if rows * bands <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach the recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The sorted distinct hashes of a text's word n-grams. Words are what white space parts, lower-cased; a text of
    fewer than n words has one n-gram, all its words; one without words has none."""

    def __init__(self, n: int = N):
        self.n = n
        self.known: dict[str, int] = {}
        self.odd = np.random.default_rng(SEED).integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)

    def _word(self, word: str) -> int:
        code = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self.known) < REMEMBERED:
            self.known[word] = code
        return code

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        get, word = self.known.get, self._word
        h = np.fromiter((get(p) or word(p) for p in parts), np.uint64, len(parts))
        k = min(self.n, len(h))
        total = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            total += h[j : len(h) - k + 1 + j] * self.odd[j]
        return np.unique(_mix(total))


class Signature:
    """Band hashes of a set of n-gram hashes."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED + 1)
        self.shape = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, np.uint32) << np.uint32(1) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low, least = (grams >> np.uint64(32)).astype(np.uint32), np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), CHUNK):
            h = low[at : at + CHUNK, None] * self.a + self.b
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            np.minimum(least, h.min(axis=0), out=least)
        out = np.arange(1, self.shape[0] + 1, dtype=np.uint64)
        for row in least.reshape(self.shape).T:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + row)
        return out


SIGNED = "_row long, doc_id long, n long, k1 long, k2 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(_row, doc_id, text) -> SIGNED: the set's size, two sums over its hashes that stand for it, and its band hashes."""
    shingles, signature = Shingles(n), Signature(bands, rows)
    for batch in batches:
        sizes, keys, others, signed = [], [], [], []
        for text in batch.column(2):
            grams = shingles(text.as_py())
            sizes.append(len(grams))
            keys.append(int(grams.sum(dtype=np.uint64).astype(np.int64)))
            others.append(int(np.bitwise_xor.reduce(_mix(grams + np.uint64(1)), initial=np.uint64(0)).astype(np.int64)))
            signed.append(signature(grams).view(np.int64) if len(grams) else np.zeros(0, np.int64))
        offsets = np.r_[0, np.cumsum([len(s) for s in signed])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*signed, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(others, pa.int64()), lists], ["_row", "doc_id", "n", "k1", "k2", "bands"])


def _gram_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(..., text last) -> the same with the set as bytes."""
    shingles = Shingles(n)
    for batch in batches:
        sets = [shingles(t.as_py()).tobytes() for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "grams"])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of n-grams that each of `left` has in common with each of `right`."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    names, place, counts = np.unique(both, return_inverse=True, return_counts=True)
    some = counts[place] > 1  # those of one set only are in no intersection
    kept = np.cumsum(counts > 1) - 1
    column, owner = kept[place[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, int((counts > 1).sum()), COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        dense[owner[i:j], column[i:j] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _verify(threshold: float):
    def verify(key, table):
        """The links of each representative to those of the other block (of its own, if it is one block), and the least one that it hangs together with."""
        one, two = key[1].as_py(), key[2].as_py()
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        order = np.argsort(ids, kind="stable")
        left, right = order[block[order] == one], order[block[order] == two]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 3, names=["node", "links", "root"])
        n = np.array([len(s) for s in sets], np.float32)
        shared = common([sets[k] for k in left], [sets[k] for k in right])
        linked = shared >= np.float32(threshold) * (n[left, None] + n[right] - shared) - np.float32(1e-3)
        if one == two:
            np.fill_diagonal(linked, False)
        big = np.iinfo(np.int64).max
        a, b = ids[left].copy(), ids[right].copy()
        while True:
            a2 = np.minimum(a, np.where(linked, b, big).min(axis=1))
            b2 = np.minimum(b, np.where(linked, a2[:, None], big).min(axis=0))
            if one == two:
                a2 = b2 = np.minimum(a2, b2)
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
        parts = [(ids[left], linked @ copies[right], a)] + ([] if one == two else [(ids[right], copies[left] @ linked, b)])
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
        return pa.table([pa.array(c) for c in columns], names=["node", "links", "root"])

    return verify


def band_edges(banded: DataFrame) -> DataFrame:
    """(a, b): edges that join all nodes of a band (node, band) to its least, by way of others, so that no node has to do
    with all of a large band."""
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    return banded.join(shared, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct().transform(fanned)


def blocks_of(met: DataFrame, threshold: float) -> DataFrame:
    """(node, label, copies, block, own, before, behind) of the nodes (node, label, copies, n) of all components.

    block: CLASS times the node's size class and its block there; own, before, behind: blocks of its class and of those
    on either side. A component of one block has one class. Nothing is lost: of two sets that are `threshold` alike the
    smaller has at least that share of the other's n-grams, which is less than the width of a class.
    """
    width = -math.log(max(threshold - 1e-3, 1e-3))  # a little more than the threshold's, as `_verify` allows for rounding
    classed = met.withColumn("_class", F.floor(F.log("n") / width).cast("long"))
    blocks = lambda rows, grams: F.ceil(F.greatest(rows / BLOCK, grams / GRAMS)).cast("long")
    whole = Window.partitionBy("label")
    at = lambda k: F.coalesce(F.sum("own").over(whole.orderBy("_class").rangeBetween(k, k)), F.lit(0)).cast("long")
    sizes = classed.groupBy("label", "_class").agg(F.count("*").alias("_rows"), F.sum("n").alias("_grams"))
    sizes = sizes.withColumn("own", blocks(F.col("_rows"), F.col("_grams"))).select("label", "_class", "own", blocks(F.sum("_rows").over(whole), F.sum("_grams").over(whole)).alias("_all"), at(-1).alias("before"), at(1).alias("behind"))
    one = F.col("_all") == 1
    plan = sizes.select("label", "_class", F.when(one, 0).otherwise(F.col("_class")).alias("_part"), *[F.when(one, x).otherwise(F.col(c)).cast("long").alias(c) for c, x in (("own", 1), ("before", 0), ("behind", 0))])
    block = F.col("_part") * CLASS + F.pmod(F.xxhash64("node"), F.col("own"))
    return classed.join(plan, ["label", "_class"]).select("node", "label", "copies", block.alias("block"), "own", "before", "behind")


def meetings() -> Column:
    """The pairs of blocks (one, two) in which a node of `blocks_of` is met: a row for each."""
    part = F.floor(F.col("block") / CLASS) * CLASS
    each = lambda n, first: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: first + k)).otherwise(F.array().cast("array<bigint>"))
    others = F.concat(each(F.col("own"), part), each(F.col("behind"), part + CLASS), each(F.col("before"), part - CLASS))
    return F.explode(F.transform(others, lambda o: F.struct(F.least("block", o).alias("one"), F.greatest("block", o).alias("two"))))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """(_row, doc_id, class_row, class_id, n_links) of every row of `docs` (doc_id, text).

    n_links: other rows whose n-gram sets are at least `threshold` alike by Jaccard, copies among them. Rows that
    links join, over others too, are a class; class_id is its least doc_id, class_row the place of a row that has
    it. A row without words has no links and is its own class. Repeated rows are copies of each other. Places are
    those of the input.
    """
    bands, rows = bands_for(threshold, recall)
    placed = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "__row").select(F.col("__row").alias("_row"), "doc_id", "text")
    signed = placed.mapInArrow(lambda batches: _sign(batches, n, bands, rows), SIGNED).transform(settled)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    reps = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("_row").alias("node"), F.count("*").alias("copies"), first, F.first("bands").alias("bands")).transform(settled)
    found = components(band_edges(reps.select("node", F.explode("bands").alias("band"))))
    members = blocks_of(found.join(reps.select("node", "copies", "n"), "node"), threshold)
    texts = placed.select("_row", "text").join(members.withColumnRenamed("node", "_row"), "_row")
    sets = texts.select(F.col("_row").alias("node"), "label", "copies", "block", "own", "before", "behind", "text").mapInArrow(lambda batches: _gram_sets(batches, n), "node long, label long, copies long, block long, own long, before long, behind long, grams binary")
    paired = sets.withColumn("_met", meetings()).select("label", "_met.one", "_met.two", "node", "copies", "block", "grams")
    checked = paired.groupBy("label", "one", "two").applyInArrow(_verify(threshold), "node long, links long, root long").transform(settled)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = reps.join(links, "node", "left").join(joined, "node", "left").select("k1", "k2", "n", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    per_set = labelled.join(heads, "label").select("k1", "k2", "n", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("head._row").alias("class_row"), F.col("head.doc_id").alias("class_id")).transform(settled)
    out = look_up(signed.select("_row", "doc_id", "n", "k1", "k2"), per_set, ["k1", "k2", "n"], F.col("copies") * HOT > signed.count())
    return out.select("_row", "doc_id", F.coalesce("class_row", "_row").alias("class_row"), F.when(F.col("class_row").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """One row of each class, with all columns: the one with the least doc_id. Nulls, empty texts and repeats as in `classes`; other columns may have any name."""
    rows = numbered(docs, "__row")
    kept = classes(rows.select("doc_id", "text"), threshold, n).where("_row = class_row").select(F.col("_row").alias("__row"))
    return rows.join(kept, "__row").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links.

    A null or empty text has no words, so it has no links and is a class of its own. A text of fewer words than an
    n-gram is one, of all its words; very long texts give all of theirs. Rows with a null doc_id take part; in a class they come last.
    """
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
