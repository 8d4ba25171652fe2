"""Prefix trie of conversations by range minima over sorted common prefixes.

Each conversation is the sequence of its turns' digests, written as one binary key, so that the order of the keys puts
conversations with a common prefix side by side. In that order, `shared[i]` is the number of turns that row i shares
with the row before it. The members of a prefix of d turns are the rows around any of its rows between which no
`shared` is below d: each candidate prefix finds how far they reach to the left and to the right by binary search over
a sparse table of range minima, with no stack and no look at other prefixes.

Rows are sorted over all partitions. A partition answers what lies inside it from its own tables; what reaches over
its edge goes on over the minima of whole partitions and ends in a partition's profile, which says how far each depth
reaches into it from its edge. So a prefix that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.lineage import settled

WORD = r"[^\x20\x09-\x0D]+"
#: A conversation takes its first turns from that whose number is the next lower multiple of this, and their number modulo this.
EVERY, MOST_SHARED = 20, 4
#: Bytes of a turn's digest, and turns of a partition.
DIGEST = 16
TURNS = 2_000_000

NODE = "place long, depth int, conv_id long, parent_place long, parent_conv_id long, n_convs long, n_leaves long, saved_tokens long, ends_sha256 string"


# ---- Conversations as keys


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns): a row for each conversation, its turns in order as array<struct<digest binary, words int>>.

    Null turns come first, equal turns in the order of their digests. Null roles and texts are empty ones. Rows
    without a conv_id belong to no conversation. Texts stay where they are: 20 bytes of a turn are shuffled, and a
    conversation of a million turns is a row of 20 MB.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    turn = F.struct(F.col("`turn`").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    each = df.where(F.col("`conv_id`").isNotNull()).select(F.col("`conv_id`").cast("long").alias("conv_id"), turn.alias("turn"))
    return each.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, key, words) of every conversation c after its first h turns gave way to those of c - c % EVERY; h = crc32(c) % MOST_SHARED."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    heads = convs.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("_from"), F.slice("turns", 1, MOST_SHARED - 1).alias("_first"))
    with_heads = convs.join(heads, F.col("_from") == F.col("conv_id") - F.col("conv_id") % EVERY, "left")
    none = F.array().cast("array<struct<digest:binary,words:int>>")
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).otherwise(none)
    new = with_heads.select("conv_id", F.concat(F.slice(F.coalesce("_first", none), F.lit(1), h), own).alias("_new"))
    key = F.unhex(F.array_join(F.transform("_new", lambda t: F.hex(t["digest"])), ""))
    return new.select("conv_id", key.alias("key"), F.transform("_new", lambda t: t["words"]).alias("words"))


# ---- Range minima


class Minima:
    """Sparse table of range minima over `values`, and searches in it for many rows at once."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [np.asarray(values, np.int64)]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, reach = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-reach], last[reach:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of values[first..last], both in; first <= last."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def right(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last row r >= rows with values[rows + 1 .. r] all >= depth."""
        r = rows.astype(np.int64).copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            fits = r + 1 < len(table)
            fits[fits] = table[r[fits] + 1] >= depth[fits]
            r[fits] += 1 << k
        return r

    def left(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First row l <= rows with values[l + 1 .. rows] all >= depth."""
        at = rows.astype(np.int64).copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table, reach = self.levels[k], 1 << k
            fits = at - reach >= 0
            fits[fits] = table[at[fits] - reach + 1] >= depth[fits]
            at[fits] -= reach
        return at


# ---- Partitions


class Block:
    """The sorted rows of one partition. `before`: turns that its first row shares with the row before it (-1: there is none); `after`: likewise for the row behind its last."""

    def __init__(self, keys: list[bytes], words: list[list[int]], convs: list[int], before: int, after: int):
        self.keys, self.n = keys, len(keys)
        self.convs = np.array(convs, np.int64)
        self.sizes = np.fromiter((len(k) // DIGEST for k in keys), np.int64, self.n)
        self.shared = np.fromiter([before, *(common(a, b) for a, b in zip(keys, keys[1:], strict=False))], np.int64, self.n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        flat = np.zeros(self.starts[-1], np.int64)  # words of the first d turns, d = 0 .. size, row by row
        for k, w in enumerate(words):
            np.cumsum(w, out=flat[self.starts[k] + 1 : self.starts[k + 1]])
        self.sums = flat
        self.minima, self.least_conv = Minima(self.shared), Minima(self.convs)
        total = self.words(np.arange(self.n), self.sizes)
        own = total - self.words(np.arange(self.n), np.maximum(self.shared, 0))
        leaf = np.append(self.shared[1:], after) < self.sizes
        # Up to each row: leaves, words of all turns, words of the nodes that begin there.
        self.upto = np.cumsum(np.stack([leaf, total, own]), axis=1)

    def words(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.sums[self.starts[rows] + depth]

    def profile(self, depths: range, right: bool) -> dict[int, tuple]:
        """For each depth how far it reaches into the block from its left edge (or from its right edge): (rows, least conv, sums over them)."""
        d = np.fromiter(depths, np.int64, len(depths))
        edge = np.full(len(d), self.n - 1 if right else 0)
        far = self.minima.left(edge, d) if right else self.minima.right(edge, d)
        first, last = (far, edge) if right else (edge, far)
        conv = self.least_conv.least(first, last)
        sums = self.upto[:, last] - np.where(first > 0, self.upto[:, first - 1], 0)
        return {int(x): (int(b - a + 1), int(c), sums[:, k].tolist()) for k, (x, a, b, c) in enumerate(zip(d, first, last, conv, strict=True))}


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


NO_ROWS = (0, 1 << 62, np.zeros(3, np.int64))


@dataclass
class Edges:
    """What all tasks know of the partitions with rows, in order: a few numbers for each, and its profiles."""

    number: dict[int, int]  # of a partition among those with rows
    before: list[int]
    place: np.ndarray  # of each partition's first row, and of the end
    sums: np.ndarray  # over the rows before each partition, and over all
    minima: Minima  # of each partition's least `shared`, its first row's with it
    least_conv: Minima
    from_left: list[dict[int, tuple]]
    from_right: list[dict[int, tuple]]

    def _whole(self, first: int, last: int) -> tuple[int, int, np.ndarray]:
        if first > last:
            return NO_ROWS
        conv = int(self.least_conv.least(np.array([first]), np.array([last]))[0])
        return int(self.place[last + 1] - self.place[first]), conv, self.sums[last + 1] - self.sums[first]

    def rightwards(self, block: int, depth: int) -> tuple[int, int, np.ndarray]:
        """(rows, least conv, sums) that a prefix of `depth` turns has behind the last row of `block`."""
        if block + 1 >= len(self.before) or self.before[block + 1] < depth:
            return NO_ROWS
        last = int(self.minima.right(np.array([block]), np.array([depth]))[0])  # blocks up to this one belong to it whole
        further = last + 1 < len(self.before) and self.before[last + 1] >= depth
        return _add(self._whole(block + 1, last), self.from_left[last + 1][depth] if further else NO_ROWS)

    def leftwards(self, block: int, depth: int) -> tuple[int, int, np.ndarray]:
        """(rows, least conv, sums) that a prefix of `depth` turns has before the first row of `block`."""
        if self.before[block] < depth:
            return NO_ROWS
        first = int(self.minima.left(np.array([block - 1]), np.array([depth]))[0])  # blocks behind this one belong to it whole
        return _add(self._whole(first + 1, block - 1), self.from_right[first][depth])


def _add(a: tuple, b: tuple) -> tuple[int, int, np.ndarray]:
    return a[0] + b[0], min(a[1], b[1]), a[2] + np.asarray(b[2])


def _block(batches: Iterator[pa.RecordBatch], before: dict[int, tuple[int, int]]) -> Block | None:
    keys, words, convs = [], [], []
    for b in batches:
        convs += b.column(0).to_pylist()
        keys += b.column(1).to_pylist()
        words += b.column(2).to_pylist()
    return Block(keys, words, convs, *before.get(TaskContext.get().partitionId(), (-1, -1))) if keys else None


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a partition."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first = b.column(0)[0].as_py() if first is None else first
            last = b.column(0)[b.num_rows - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())})


def _facts(batches: Iterator[pa.RecordBatch], before: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its rows, least `shared`, least conv, sums and profiles."""
    b = _block(batches, before)
    if b:
        left, right = before[TaskContext.get().partitionId()]
        tall = [list(b.profile(range(max(edge, -1) + 1), side).items()) for edge, side in ((left, False), (right, True))]
        flat = [[[d, n, c, *s] for d, (n, c, s) in t] for t in tall]
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [b.n], "least": [int(b.shared.min())], "conv": [int(b.convs.min())], "sums": [b.upto[:, -1].tolist()], "from_left": pa.array([flat[0]], pa.list_(pa.list_(pa.int64()))), "from_right": pa.array([flat[1]], pa.list_(pa.list_(pa.int64())))})


def edges_of(rows: DataFrame) -> tuple[Edges, dict[int, tuple[int, int]]]:
    """What lies at the partitions' edges. The driver sees two keys and two profiles of each partition: a conversation's length of numbers."""
    ends = sorted(rows.select("key").mapInArrow(_ends, "part long, first binary, last binary").collect())
    shared = [-1, *(common(bytes(a.last), bytes(b.first)) for a, b in zip(ends, ends[1:], strict=False)), -1]
    before = {e.part: (shared[k], shared[k + 1]) for k, e in enumerate(ends)}
    facts = sorted(rows.mapInArrow(lambda b: _facts(b, before), "part long, n long, least long, conv long, sums array<long>, from_left array<array<long>>, from_right array<array<long>>").collect())
    profile = lambda p: {r[0]: (r[1], r[2], list(r[3:])) for r in p}
    places = np.concatenate([[0], np.cumsum([f.n for f in facts])]).astype(np.int64)
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(np.array([f.sums for f in facts], np.int64).reshape(-1, 3), axis=0)])
    return Edges({f.part: k for k, f in enumerate(facts)}, shared[:-1], places, sums, Minima(np.array([f.least for f in facts])), Minima(np.array([f.conv for f in facts])), [profile(f.from_left) for f in facts], [profile(f.from_right) for f in facts]), before


# ---- Nodes


def _hash(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _copies(b: Block) -> np.ndarray:
    """For each row the last row of the block with the same key."""
    same = (b.shared == b.sizes) & (np.append(-1, b.sizes[:-1]) == b.sizes)
    same[0] = False
    heads = np.flatnonzero(~same)
    return np.repeat(np.append(heads[1:], b.n) - 1, np.diff(np.append(heads, b.n)))


def _nodes(batches: Iterator[pa.RecordBatch], edges: Edges, before: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The nodes whose first member is in this partition (NODE). ends_sha256 is null where copies go on in the next partition."""
    b = _block(batches, before)
    if b is None:
        return
    me = edges.number[TaskContext.get().partitionId()]
    place = int(edges.place[me])
    rows = np.repeat(np.arange(b.n), b.sizes - b.shared)
    depth = np.arange(len(rows)) - np.repeat(np.cumsum(b.sizes - b.shared) - (b.sizes - b.shared), b.sizes - b.shared) + b.shared[rows] + 1

    def extent(r: np.ndarray, d: np.ndarray):
        """(first, rows, least conv, sums) of the members of each prefix, over all partitions."""
        first, last = b.minima.left(r, d), b.minima.right(r, d)
        n, conv = last - first + 1, b.least_conv.least(first, last)
        sums = b.upto[:, last] - np.where(first > 0, b.upto[:, first - 1], 0)
        start = first + place
        for edge, at, further in ((b.n - 1, last, edges.rightwards), (0, first, edges.leftwards)):
            out = at == edge
            for x in np.unique(d[out]).tolist():
                more, c, s = further(me, x)
                if more:
                    hit = out & (d == x)
                    n[hit] += more
                    conv[hit] = np.minimum(conv[hit], c)
                    sums[:, hit] += s[:, None]
                    if edge == 0:
                        start[hit] -= more
        return start, n, conv, sums

    if not len(rows):
        return
    start, n, conv, (leaves, total, own) = extent(rows, depth)
    up = depth > 0
    parent, _, parent_conv, _ = extent(rows, np.maximum(depth - 1, 0))
    until = b.words(rows, np.maximum(depth - 1, 0))  # words before the node's last turn
    # A node begins at its first member; of that member's own nodes those that are not as deep don't belong to the subtree.
    first_own = b.words(rows, b.sizes[rows]) - b.words(rows, np.maximum(b.shared[rows], 0))
    saved = total - n * until - (own - first_own + b.words(rows, b.sizes[rows]) - until)
    copies, nothing = _copies(b), hashlib.sha256(b"").hexdigest()
    runs_on = b.n - 1 if before[TaskContext.get().partitionId()][1] == b.sizes[-1] else b.n
    ends = [nothing if size > d else None if last == runs_on else _hash(b.convs[r : last + 1]) for r, d, size, last in zip(rows.tolist(), depth.tolist(), b.sizes[rows].tolist(), copies[rows].tolist(), strict=True)]
    cols = [pa.array(start), pa.array(depth, pa.int32()), pa.array(conv), pa.array(parent, mask=~up), pa.array(parent_conv, mask=~up), pa.array(n), pa.array(leaves), pa.array(saved), pa.array(ends, pa.string())]
    whole = pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in NODE.split(", ")])
    for k in range(0, whole.num_rows, 50_000):
        yield whole.slice(k, 50_000)


def _pieces(batches: Iterator[pa.RecordBatch], edges: Edges, before: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(place, depth, part, ids): the ids of copies that lie in more than one partition, a row for each partition."""
    b = _block(batches, before)
    if b is None:
        return
    me, (left, right) = edges.number[TaskContext.get().partitionId()], before[TaskContext.get().partitionId()]
    copies, found = _copies(b), {}
    if left == b.sizes[0]:  # a copy of the row before
        found[0] = int(edges.place[me]) - edges.leftwards(me, left)[0]
    last = int(np.flatnonzero(copies == b.n - 1)[0])
    if right == b.sizes[-1] and last not in found:
        found[last] = int(edges.place[me]) + last
    for r, at in found.items():
        ids = ",".join(map(str, b.convs[r : int(copies[r]) + 1].tolist()))
        yield pa.RecordBatch.from_pydict({"place": [at], "depth": pa.array([int(b.sizes[r])], pa.int32()), "part": pa.array([me], pa.int32()), "ids": [ids]})


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by (place, depth), in order -> a hash for each; one piece is held at a time."""
    now, state = None, None

    def out():
        return pa.RecordBatch.from_pydict({"_p": [now[0]], "_d": pa.array([now[1]], pa.int32()), "_sha": [state.hexdigest()]})

    for b in batches:
        for p, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if (p, d) != now:
                if now:
                    yield out()
                now, state = (p, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if now:
        yield out()


def sorted_keys(df: DataFrame) -> DataFrame:
    """(conv_id, key, words) of the rebuilt conversations in the order of key and conv_id over all partitions. Written, so that partitions stay as they are."""
    whole = rebuilt(turns(df)).transform(settled)
    n = whole.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TURNS))
    return whole.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").transform(settled)


def trie(df: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of `df` (conv_id, turn, role, text; other columns don't matter).

    conv_id: the smallest member; depth; parent_conv_id: its parent's conv_id, null for the root; n_convs: members;
    n_children; n_leaves: childless nodes below it, itself with them; saved_tokens: words of last turns that members
    have in common, over the subtree; ends_sha256: hash of the ids of the members that end here.

    Nulls and ties: see `turns`. A conversation without turns is a member of the root only. Repeated rows are turns of
    their own. Without any conversation there is no node, not even the root. Very long texts are only counted and
    hashed where they are. Digests of 128 bits stand for the turns.
    """
    rows = sorted_keys(df)
    edges, before = edges_of(rows)
    nodes = rows.mapInArrow(lambda b: _nodes(b, edges, before), NODE).transform(settled)
    pieces = rows.mapInArrow(lambda b: _pieces(b, edges, before), "place long, depth int, part int, ids string")
    hashes = pieces.repartition("place", "depth").sortWithinPartitions("place", "depth", "part").mapInArrow(_join_ids, "_p long, _d int, _sha string")
    children = nodes.where("parent_place IS NOT NULL").groupBy(F.col("parent_place").alias("_cp"), (F.col("depth") - 1).alias("_cd")).agg(F.count("*").alias("_n"))
    out = nodes.join(children, (F.col("place") == F.col("_cp")) & (F.col("depth") == F.col("_cd")), "left")
    out = out.join(F.broadcast(hashes), (F.col("place") == F.col("_p")) & (F.col("depth") == F.col("_d")), "left")  # two rows for a partition at most
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("_n", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", "_sha").alias("ends_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of the given conversations, rebuilt; nulls, ties and empty tables as in `trie`."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The last two bits of crc32, bit by bit, over the decimal digits of a number.
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda acc, x: list_reduce(list_concat([xor(acc, x)], range(8)::UBIGINT[]), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, ({_CRC} % {MOST_SHARED})::BIGINT AS h, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, CASE WHEN h = 0 THEN c.ks ELSE list_concat(coalesce(p.ks[1:h], []), c.ks[h + 1:]) END AS ks,
    CASE WHEN h = 0 THEN c.ws ELSE list_concat(coalesce(p.ws[1:h], []), c.ws[h + 1:]) END AS ws FROM c LEFT JOIN (SELECT conv_id, ks, ws FROM c) p ON p.conv_id = c.conv_id - c.conv_id % {EVERY}),
x AS (SELECT conv_id, len(ks) AS n, d, CASE WHEN d = 0 THEN '' ELSE array_to_string(ks[1:d], '') END AS p, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM r)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM x GROUP BY p, d),
kids AS (SELECT left(p, 32 * (d - 1)) AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p, d)),
up AS (SELECT left(p, 32 * e) AS p, e AS d, sum((n_convs - 1) * w) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM own) GROUP BY ALL)
SELECT own.conv_id, own.d AS depth, par.conv_id AS parent_conv_id, own.n_convs, own.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN up ON up.p = own.p AND up.d = own.d LEFT JOIN own par ON par.d = own.d - 1 AND par.p = left(own.p, 32 * (own.d - 1)) AND own.d > 0
"""
