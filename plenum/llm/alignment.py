"""Alignment of two tokenizers' tokens by galloping intersection.

Each text is cut into byte ranges by either tokenizer, and each list of ends is sorted. The shorter list drives: for
each of its ends an exponential and then a binary search goes on in the longer one from where the last search stopped.
Ends found in both lists cut the tokens into groups; the difference of the ranks of a token's start and end gives the
range of the other tokenizer's tokens that overlap it.

Neither tokenizer joins anything across a space that follows a character which isn't white space, so a text is the sequence
of its chunks between such places, and a chunk's alignment is worked out once and remembered.

How many documents link a pair of ids is counted over all documents. The HOT pairs that the most documents link go to
all tasks; those beyond are looked up by a join, in which no pair has as many rows as a hot one.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.lineage import numbered, settled, written
from plenum.llm.packing import Encoder, vocabulary

#: Chunks that a Python worker remembers.
REMEMBERED = 300_000
#: Pairs whose counts go to all tasks (17 bytes each), and pairs that a task holds while it counts.
HOT, HELD = 2_000_000, 2_000_000
#: Links of an Arrow batch, and texts that are looked at together.
BATCH, TEXTS = 1_000_000, 64
#: Tokens of a chunk that is searched by itself.
ALONE = 64
#: How A's byte-level tokenizer splits a text (a fixed value), and characters at which Python's classes are asked no more.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = re.compile("[\x1c-\x1f]")

LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<int>"


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def gallop(short: np.ndarray, short_at: np.ndarray, long: np.ndarray, long_at: np.ndarray) -> np.ndarray:
    """For each number of the sorted lists in `short`, the place in `long` of the first that isn't smaller in the list of the same number.

    short_at, long_at: where each list begins, and the end of the last. Lists go side by side: in each round every
    list that isn't through searches for its next number from where its last search stopped. The one list that is
    longest sets the rounds, so long lists are better given alone and as Python lists (`gallop_one`).
    """
    ranks, at, size = np.empty(len(short), np.int64), long_at[:-1].copy(), np.diff(short_at)
    live, k, most = np.flatnonzero(size > 0), 0, len(long) - 1
    while len(live):
        x, end = short[short_at[live] + k], long_at[live + 1]
        low, probe, step = at[live], at[live].copy(), np.ones(len(live), np.int64)
        go = np.flatnonzero(long[np.minimum(probe, most)] < x)
        while len(go := go[probe[go] < end[go]]):
            low[go] = probe[go] + 1
            probe[go] += step[go]
            step[go] *= 2
            go = go[long[np.minimum(probe[go], most)] < x[go]]
        high = np.minimum(probe, end)
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) >> 1
            less = long[mid] < x[go]
            low[go] = np.where(less, mid + 1, low[go])
            high[go] = np.where(less, high[go], mid)
        ranks[short_at[live] + k] = low
        at[live] = low
        k += 1
        live = live[size[live] > k]
    return ranks


def gallop_one(short: list[int], long: list[int]) -> list[int]:
    """`gallop` of one list."""
    at, n, ranks = 0, len(long), []
    for x in short:
        step, probe = 1, at
        while probe < n and long[probe] < x:
            at, probe, step = probe + 1, probe + step, 2 * step
        at = bisect_left(long, x, at, min(probe, n))
        ranks.append(at)
    return ranks


def intersect(short: np.ndarray, short_at: np.ndarray, long: np.ndarray, long_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranks, common, first) of token ends, list by list, of which each pair of lists has the last end in common.

    common: whether an end is in both lists. A short token overlaps the long tokens first .. rank, both in.
    """
    if len(short_at) == 2 and len(short) > ALONE:
        ranks = np.array(gallop_one(short.tolist(), long.tolist()), np.int64)
    else:
        ranks = gallop(short, short_at, long, long_at)
    common = long[ranks] == short
    first = np.empty(len(short), np.int64)
    first[1:] = ranks[:-1] + common[:-1]
    first[short_at[:-1]] = long_at[:-1]
    return ranks, common, first


class Chunks:
    """Alignments of chunks of text, by number. A chunk is known by what follows its first space."""

    #: Where a chunk ends. Python's white space includes that of both tokenizers.
    EDGE = re.compile(r"(?<=\S)(?= )")
    #: Texts without this are cut at each space.
    BLANK = re.compile(r"\s ")

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.encoder = Encoder(a_path)
        self.encoder.whole.encode_special_tokens, self.encoder.special = True, []  # their strings are ordinary text
        byte_of = {chr(c): bytes([b]) for b, c in self.encoder.letters.items()}
        vocab = self.encoder.whole.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = b"".join(byte_of.get(c, c.encode()) for c in token)
        self.fast = self._ranked(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        named = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(named)]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.said = [[str(k) for k in range(len(t))] for t in (self.a_bytes, self.b_bytes)]
        #: Whether no piece of B reaches over the edge of a chunk, and A's words are cut as is known here.
        self.cut = self.encoder.split and not any(re.search("[^▁]▁", p) for p in named)
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.groups: list[str | None] = []  # None: one tokenizer's bytes are not the chunk's
        self.counts = np.zeros((1024, 4), np.int64)  # A tokens, B tokens, groups, links
        self.starts = np.zeros(1025, np.int64)
        self.links = np.zeros(4096, np.int64)

    def _ranked(self, path: str):
        """A's vocabulary for tiktoken, or None if its merges don't come in the order of their ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        ids = [model["vocab"].get(m, -1) for m in merges]
        if not self.encoder.split or ids != sorted(ids) or -1 in ids or len(set(ids)) < len(ids):
            return None
        ranks = {self.a_bytes[k]: k for k in {*ids, *(model["vocab"][chr(c)] for c in self.encoder.letters.values())}}
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        """A's ids; texts with characters that splits may see otherwise go to A's own tokenizer."""
        if self.fast and (text.isascii() and not ODD.search(text) or not self.encoder.ODD.search(text)):
            return self.fast.encode_ordinary(text)
        return np.frombuffer(self.encoder(text), np.uint32).tolist()

    def learn(self, names: list[str]) -> None:
        """Aligns new chunks: all short ones side by side, long ones one by one."""
        b_ids = self.b.encode(names, num_threads=1)
        lists = [[self.encode_a(" " + n) for n in names], [x or [self.b.piece_to_id("▁")] for x in b_ids]]  # B gives nothing for the empty text
        texts = [(" " + n).encode("utf-8", "replace") for n in names]
        right = [b"".join([t[i] for i in x]) == want and b"".join([u[i] for i in y]) == want for (x, y, want), t, u in zip(zip(*lists, texts, strict=True), repeat(self.a_bytes), repeat(self.b_bytes))]
        n = np.array([[len(x) for x in side] for side in lists], np.int64)
        k, m = len(self.names), len(names)
        while k + m > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.starts = np.concatenate([self.starts, np.zeros(len(self.counts) // 2, np.int64)])
        self.number.update(zip(names, range(k, k + m), strict=True))
        self.names += names
        self.groups += [None] * m
        self.counts[k : k + m] = 0
        found: dict[int, np.ndarray] = {}
        good, alone, turned = np.array(right, bool), n.max(axis=0) > ALONE, n[0] > n[1]
        for side in (0, 1):
            own = np.flatnonzero(good & (turned == bool(side)))
            for part in ([own[~alone[own]]] if len(own[~alone[own]]) else []) + [np.array([x]) for x in own[alone[own]]]:
                self._align(part, lists[side], lists[1 - side], side, k, found)
        sizes = self.counts[k : k + m, 3]
        self.starts[k + 1 : k + m + 1] = self.starts[k] + np.cumsum(sizes)
        while self.starts[k + m] > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        if found:
            self.links[self.starts[k] : self.starts[k + m]] = np.concatenate([found[x] for x in sorted(found)])

    def _align(self, part: np.ndarray, short: list, long: list, side: int, k: int, found: dict[int, np.ndarray]) -> None:
        """Groups and links of the chunks numbered `part` of a batch that begins at number `k`. `side`: 1 if B's tokens are the shorter lists."""
        flat, at, ends = [], [], []
        for lists, sizes in ((short, self.sizes[side]), (long, self.sizes[1 - side])):
            own = [lists[x] for x in part.tolist()]
            flat.append(np.fromiter(chain.from_iterable(own), np.int64))
            at.append(np.concatenate([[0], np.cumsum([len(x) for x in own])]))
            ends.append(np.cumsum(sizes[flat[-1]]))  # over all chunks: both sides have the same bytes in each
        ranks, common, first = intersect(ends[0], at[0], ends[1], at[1])
        width = ranks - first + 1
        one, many = np.repeat(flat[0], width), flat[1][np.repeat(first - np.cumsum(width) + width, width) + np.arange(int(width.sum()))]
        pairs = many << 32 | one if side else one << 32 | many
        in_chunk = np.add.reduceat(width, at[0][:-1])
        cut = np.split(pairs, np.cumsum(in_chunk)[:-1])
        self.counts[k + part] = np.stack([np.diff(at[side]), np.diff(at[1 - side]), np.add.reduceat(common.astype(np.int64), at[0][:-1]), in_chunk], axis=1)
        names = [list(map(self.said[s].__getitem__, ids.tolist())) for s, ids in ((side, flat[0]), (1 - side, flat[1]))]
        stops, i, j = np.flatnonzero(common).tolist(), 0, 0
        made = []
        for x, y in zip(stops, ranks[stops].tolist(), strict=True):
            a, b = ",".join(names[0][i : x + 1]), ",".join(names[1][j : y + 1])
            made.append(f"{b}|{a}" if side else f"{a}|{b}")
            i, j = x + 1, y + 1
        upto = 0
        for x, c, links in zip(part.tolist(), self.counts[k + part, 2].tolist(), cut, strict=True):
            self.groups[k + x], found[x] = ";".join(made[upto : upto + c]), links
            upto += c

    def forget(self) -> None:
        """Those beyond REMEMBERED."""
        for name in self.names[REMEMBERED:]:
            del self.number[name]
        del self.names[REMEMBERED:], self.groups[REMEMBERED:]

    def _names(self, text: str) -> list[str]:
        if not self.cut:
            return [text]
        if text[0].isspace() or self.BLANK.search(text):
            return [c[1:] for c in self.EDGE.split(" " + text)]
        return text.split(" ")

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """For each text ((n_a, n_b, n_groups, n_links), groups, distinct pairs, how often each is linked)."""
        nothing = np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        named = [self._names(t) if t else [] for t in texts]
        if new := [n for n in dict.fromkeys(chain.from_iterable(named)) if n not in self.number]:
            self.learn(new)
        out = []
        for names in named:
            numbers = list(map(self.number.__getitem__, names))
            said = list(map(self.groups.__getitem__, numbers))
            if not names or None in said:
                out.append(nothing)
                continue
            ids = np.array(numbers, np.int64)
            counts = self.counts[ids]
            sizes = counts[:, 3]
            begin = np.cumsum(sizes) - sizes
            links = self.links[np.repeat(self.starts[ids] - begin, sizes) + np.arange(int(sizes.sum()))]
            pairs, times = np.unique(links, return_counts=True)
            out.append((counts.sum(axis=0), ";".join(said), pairs, times))
        self.forget()
        return out


@cache
def _chunks(a_path: str, b_path: str) -> Chunks:
    """One for each Python worker: what it has learned serves its next tasks."""
    return Chunks(a_path, b_path)


def _linked(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    chunks, rows, held = _chunks(a_path, b_path), [], 0

    def out() -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]), pa.int32())
        flat = [np.concatenate([r[k] for r in rows]).astype(np.int64) for k in (3, 4)]
        listed = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (flat[0] >> 32, flat[0] & 0xFFFFFFFF, flat[1])]
        counts = np.stack([r[1] for r in rows])
        cols = [pa.array([r[0] for r in rows], pa.int64()), *[pa.array(counts[:, k]) for k in range(4)], pa.array([r[2] for r in rows], pa.string()), *listed]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in LINKS.split(", ")])

    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            part = batch.slice(k, TEXTS)
            for doc, found in zip(part.column(0).to_pylist(), chunks(part.column(1).to_pylist()), strict=True):
                rows.append((doc, *found))
                held += len(found[2]) + 100
                if held >= BATCH:
                    yield out()
                    rows, held = [], 0
    if rows:
        yield out()


def links(df: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The aligned tokens of each row (LINKS): its groups as `a1,a2|b1;a3|b2`, its distinct linked pairs of ids, and how often each is linked.

    A is a byte-level vocabulary of tokenizers, asked for a space and the text; B is a sentencepiece model, asked for
    the text. Null and empty texts, and those whose bytes a tokenizer changes, have no tokens: zeros and empty lists.
    Repeated rows and null keys are rows of their own; extra columns don't matter. A very long text is held once.
    """
    a_path, b_path = a_path or vocabulary(), b_path or pieces()
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _linked(batches, a_path, b_path), LINKS)


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
    return a << 32 | b


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) -> (pair, n) for the rows of a task, in parts if it meets very many pairs."""
    keys, counts, held = [], [], 0

    def out():
        return pa.RecordBatch.from_pydict({"pair": keys[0], "n": counts[0]})

    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            keys.append(_pairs(batch.slice(k, 1000)))
            counts.append(np.ones(len(keys[-1]), np.int64))
            held += len(keys[-1])
            if held > HELD:
                keys, counts = ([x] for x in _merged(keys, counts))
                held = len(keys[0])
                if held > HELD // 2:
                    yield out()
                    keys, counts, held = [], [], 0
    if held:
        keys, counts = ([x] for x in _merged(keys, counts))
        yield out()


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows link a pair of ids (A's in the upper half), and whether no pair of the same A id is linked by more."""
    counts = linked.select("a", "b").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)).transform(settled)
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("_most"))
    return counts.join(most, F.col("a") == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best")).transform(settled)


def least_hot(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs are linked by as many rows."""
    level = F.length(F.bin("n")) - 1
    out, held = 64, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect(), reverse=True):  # 64 rows at most
        held += r.pairs
        if held > most:
            break
        out = r.level
    return 1 << min(out, 62)


def _score(batches: Iterator[pa.RecordBatch], hot, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows with sums over their hot pairs, and their other pairs."""
    pairs, n, best = hot.value
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            asked, times = _pairs(part), part.column(part.schema.get_field_index("times")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array(part.column(part.schema.get_field_index("a")).value_lengths(), np.int64)
            row = np.repeat(np.arange(part.num_rows), sizes)
            at = np.minimum(np.searchsorted(pairs, asked), max(len(pairs) - 1, 0))
            known = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
            sums = [np.zeros(part.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[known], times[known] * best[at[known]])
            np.add.at(sums[1], row[known], times[known] * n[at[known]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=part.num_rows))]), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~known])) for v in (asked, times)]
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], *map(pa.array, sums), *rest], [*names, "n_best", "count_sum", "rest", "rest_times"])


def with_counts(linked: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of `links`, written by the caller, with n_best and count_sum in place of the lists.

    n_best: links whose pair is linked by as many rows as any pair of its A id. count_sum: over all links, the number
    of rows that link the pair.
    """
    spark, names = linked.sparkSession, [c for c in linked.columns if c not in ("a", "b", "times")]
    counts = pair_counts(linked)
    least = 1 if counts.count() <= hot else least_hot(counts, hot)
    found = counts.where(F.col("n") >= least).orderBy("pair").toArrow()  # `hot` rows at most
    shared = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))
    kinds = {f.name: f.dataType.simpleString() for f in linked.schema}
    scored = linked.mapInArrow(lambda b: _score(b, shared, names), ", ".join([f"{c} {kinds[c]}" for c in names] + ["n_best long", "count_sum long", "rest array<long>", "rest_times array<long>"]))
    if least == 1:
        return scored.drop("rest", "rest_times")
    rows = numbered(written(scored), "__row")
    rest = rows.select("__row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("__row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    more = rest.join(counts.where(F.col("n") < least), "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    total = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return rows.join(more, "__row", "left").select(*names, total("n_best", "_best"), total("count_sum", "_sum"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens by two tokenizers; nulls, ties and repeats as in `links`."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    linked = links(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "a", "b", "times")
    return with_counts(written(linked)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
