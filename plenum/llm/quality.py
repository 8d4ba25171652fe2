"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (labelled good) and one of all raw text, give each
document the log of its importance weight: the sum of the log ratios of its n-grams' probabilities. Documents are
drawn without replacement in proportion to their weights by Gumbel top-k: the k largest of log weight plus Gumbel
noise. k is the number of documents that the models hold for target text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.lineage import numbered, settled

BUCKETS = 1 << 16
#: The most labelled documents that the target model and the cut are fitted on.
LABELLED = 20_000
SEED = 7
#: Words that a Python worker remembers.
REMEMBERED = 300_000
#: Bins of a round in the search for the k-th largest key, and the most keys that the driver looks at.
BINS, FEW = 2048, 4096
#: Errors (the sum of two rates) that count as equal when the cut is chosen.
SLACK = 0.005

AGAIN = np.uint64(zlib.crc32(b"=") & 0xFFFF)


class Features:
    """Buckets of a text's n-grams: its lower-cased words and pairs, and the shapes of words, alone, in twos and threes.

    A shape writes capitals X, small letters x, digits 9 and other characters as they are, runs as one; a word like
    the one before it has the shape =.
    """

    def __init__(self):
        self.known: dict[str, int] = {}

    def _code(self, word: str) -> int:
        kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        shape = re.sub(r"(.)\1+", r"\1", kinds)
        code = zlib.crc32(word.lower().encode("utf-8", "replace")) << 16 | zlib.crc32(shape.encode("utf-8", "replace")) & 0xFFFF
        if len(self.known) < REMEMBERED:
            self.known[word] = code
        return code

    @staticmethod
    def _mix(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 16)

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").split()
        if not parts:
            return np.zeros(0, np.int64)
        get, code = self.known.get, self._code
        codes = np.fromiter((get(p) or code(p) for p in parts), np.uint64, len(parts))
        word, shape = codes >> np.uint64(16), codes & np.uint64(0xFFFF)
        shape[1:][word[1:] == word[:-1]] = AGAIN
        two = shape[:-1] << np.uint64(16) | shape[1:]
        grams = [self._mix(word, 1), self._mix(word[:-1] << np.uint64(24) ^ word[1:], 2), self._mix(shape, 3), self._mix(two, 4), self._mix(two[:-1] << np.uint64(16) | shape[2:], 5)]
        return np.concatenate(grams).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, quality) -> the counts of each bucket in all texts and in those of quality 1."""
    features, raw, target = Features(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(features(text.as_py()), minlength=BUCKETS)
            raw += found
            if good == 1:
                target += found
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "n_raw", "n_target"])


def _score(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(..., text last) -> the same with the log weight in place of the text."""
    features = Features()
    for batch in batches:
        weights = [float(ratio[features(t.as_py())].sum(dtype=np.float64)) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weights, pa.float64())], [*batch.schema.names[:-1], "log_weight"])


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, quality): at most `most` labelled ids, those with the least hashes; an id with several labels counts as good if one says so."""
    each = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return each.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def log_ratios(docs: DataFrame, sample: DataFrame, level: bool = False) -> np.ndarray:
    """Per bucket the log ratio of its probabilities, each model with one count more in each bucket; 0 without any target
    text. The raw model counts all documents. `level`: the raw counts are first brought to the target's total, so that
    the added counts weigh alike in both models, and a bucket without evidence weighs 0 however small the corpus is."""
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "quality")
    sums = known.mapInArrow(_count, "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw"), F.sum("n_target"))
    counts = np.ones((2, BUCKETS))
    for bucket, raw, target in sums.collect():  # BUCKETS rows at most
        counts[:, bucket] += raw, target
    if counts[1].sum() == BUCKETS:
        return np.zeros(BUCKETS, np.float32)
    if level:
        n = counts.sum(axis=1) - BUCKETS
        counts[0] = (counts[0] - 1) * (n[1] / n[0]) + 1
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return (logs[1] - logs[0]).astype(np.float32)


def cut(scored: DataFrame, sample: DataFrame) -> float:
    """The log weight that best parts good from bad among the labelled sample, errors of both kinds weighing alike as rates.

    A label counts once, with the mean weight of the rows that share its id. Of the cuts whose error is within SLACK
    of the least it is the middle of the widest gap; only if none between two weights is that good, all are
    kept (-inf).
    Without bad ones it is the least weight of the good, without good ones nothing is cut.
    """
    known = scored.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.avg("log_weight"), F.max("quality"))
    pairs = sorted((w, q) for _, w, q in known.collect())  # a row for each id of the sample at most
    w, good = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], bool)
    if not good.any():
        return float("-inf")
    if good.all():
        return float(w.min())
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    lost, left = np.cumsum(good) / good.sum(), 1 - np.cumsum(~good) / (~good).sum()
    cost = (lost + left)[:-1] + 2.0 * (np.diff(w) <= 0)
    if not len(cost) or cost.min() > 1 + SLACK:  # keeping all, or none, costs 1
        return float("-inf")
    best = np.flatnonzero(cost <= cost.min() + SLACK)
    at = best[np.argmax(np.diff(w)[best])]
    return float((w[at] + w[at + 1]) / 2)


def kth_largest(df: DataFrame, col: str, k: int) -> tuple[float, int]:
    """(v, r): the k-th largest value v of `col`, and how many rows that equal v belong to the k largest. Rounds of counts by bin."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    while low < high:
        inside = df.where((F.col(col) >= F.lit(low)) & (F.col(col) <= F.lit(high)))
        if inside.count() <= FEW:
            values = sorted((r[0] for r in inside.select(col).collect()), reverse=True)
            return values[k - 1], k - sum(x > values[k - 1] for x in values)
        width = (high - low) / BINS
        place = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.when(F.col(col) < high, 0).otherwise(1)
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect(), reverse=True)
        for b in bins:
            if b.n >= k:
                low, high = b.low, b.high
                break
            k -= b.n
    return low, k


def weigh(docs: DataFrame, labels: DataFrame, most: int = LABELLED, level: bool = False) -> tuple[DataFrame, int]:
    """((_row, doc_id, log_weight, key) of every document, k). Written to the checkpoint folder. `level`: see log_ratios.

    `_row` is a row's place in its input. A null or empty text has no n-grams: its log weight is 0. Repeated rows are drawn one by one.
    """
    sample = labelled(labels, most)
    sample = sample.transform(settled)
    ratio = log_ratios(docs, sample, level)
    u = (F.pmod(F.xxhash64(F.lit(SEED), "_row", "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "__row").select(F.col("__row").alias("_row"), "doc_id", "text")
    scored = rows.mapInArrow(lambda batches: _score(batches, ratio), "_row long, doc_id long, log_weight double")
    scored = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u))).transform(settled)
    return scored, scored.where(F.col("log_weight") >= cut(scored, sample)).count()


def draw(scored: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest keys; among equal keys those that come first."""
    if k <= 0:
        return scored.limit(0)
    at, ties = kth_largest(scored, "key", k)
    last, _ = kth_largest(scored.where(F.col("key") == at).withColumn("_back", -F.col("_row")), "_back", ties)
    return scored.where((F.col("key") > at) | ((F.col("key") == at) & (F.col("_row") <= -int(last))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are drawn, with all their columns.

    A null or empty text weighs 0, a very long one the sum over all its n-grams. Repeated rows are rows of their own;
    among equal keys those that come first are drawn. Other columns pass, whatever their names.
    """
    rows = numbered(docs, "__row")
    return rows.join(draw(*weigh(rows.drop("__row"), labels, level=True)).select(F.col("_row").alias("__row")), "__row").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their log weights and keys; nulls, ties and repeats as in `classify`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return draw(*weigh(docs, labels, level=True)).select("doc_id", "log_weight", "key")
