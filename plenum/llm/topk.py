"""Exact top-k search by the threshold algorithm.

Candidates and queries are dealt to blocks of bounded size, and each pair of blocks is a group of its own. In a
group every dimension has its list of candidates by value. A query walks all its lists at once, down where its
component is positive and up where it is negative, and scores the candidates that it meets for the first time. What
it has not met scores at most the sum of the values it has reached, so it stops when that can't beat its kth result.

Each query begins in one block of candidates and goes on to GROWTH times as many in each further round. Its kth score
of the blocks behind it is its floor in the next round: a list is left as soon as nothing below can reach the floor,
and only what reaches it leaves a block. So what a query gathers grows with the logarithm of the number of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.lineage import settled

K = 20
#: Candidates of a block, and queries of one at most and, while there are fewer pairs of blocks than PAIRS, at least.
CANDIDATES, QUERIES, FEW_QUERIES, PAIRS = 16_384, 16_384, 512, 256
#: How many times as many blocks each round covers.
GROWTH = 4
#: Entries of each list in the first step; each later step doubles the depth.
STEP = 64
SCALE = 64


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """Rows of the list column `v`, shorter ones filled with zeros."""
    lists = table.column("v").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def threshold_search(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, down: np.ndarray, k: int, step: int = STEP, floor: int | None = None) -> np.ndarray:
    """Indexes of the k best points for `query`, without the row `own`: by score, then by id.

    down: for each dimension the points' indexes by falling value. floor: points that score less don't matter.
    """
    n = len(points)
    used = np.flatnonzero(query)
    up = query[used] < 0
    seen = rows == own
    best, scores, depth = np.zeros(0, np.int64), np.zeros(0, points.dtype), 0
    while depth < n:
        to = min(n, max(step, 2 * depth))
        met = np.zeros(n, bool)
        met[down[used[~up], depth:to]] = True
        met[down[used[up], n - to : n - depth]] = True
        fresh = np.flatnonzero(met & ~seen) if len(used) else np.flatnonzero(~seen)
        seen |= met
        got = points.take(fresh, axis=0) @ query
        least = scores[-1] if len(best) == k else floor
        if least is not None:
            fresh, got = fresh[got >= least], got[got >= least]
        best, scores = np.concatenate([best, fresh]), np.concatenate([scores, got])
        order = np.lexsort((ids[best], -scores))[:k]
        best, scores, depth = best[order], scores[order], to
        reached = np.where(up, points[down[used, n - to], used], points[down[used, to - 1], used])
        least = scores[-1] if len(best) == k else floor
        if not len(used) or seen.all() or least is not None and reached @ query[used] < least:
            break
    return best


def _search(k: int):
    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if candidates.num_rows and queries.num_rows:
            width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (candidates, queries))
            points, asked = _matrix(candidates, width), _matrix(queries, width)
            limit = float(np.abs(points).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(width, 1)
            for bits, kind in ((24, np.float32), (53, np.float64)):  # sums of floats are exact up to here, and their products faster
                if limit < 2**bits:
                    points, asked = points.astype(kind), asked.astype(kind)
                    break
            down = np.ascontiguousarray(np.argsort(-points, axis=0, kind="stable").T.astype(np.int32))
            ids, rows = candidates.column("vec_id").to_numpy(), candidates.column("_row").to_numpy()
            names, owns = queries.column("vec_id").to_numpy(), queries.column("_row").to_numpy()
            for query, name, own, floor in zip(asked, names, owns, queries.column("floor").to_pylist(), strict=True):
                found = threshold_search(points, ids, rows, query, own, down, k, floor=floor)
                out[0] += [own] * len(found)
                out[1] += [name] * len(found)
                out[2] += ids[found].tolist()
                out[3] += (points[found] @ query).astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["_row", "query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by inner product, ties to smaller ids.

    `vectors` has `vec_id` and `v` (array<bigint>). Rows with a null in either take no part. Equal rows are rows of
    their own: a query meets its copies, not itself. Vectors of different lengths are compared as if filled up with
    zeros. Sums beyond 63 bits are not defined.
    """
    rows = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("_q")).transform(settled)
    n, asked = rows.agg(F.count("*"), F.count_if("_q")).first()
    blocks = max(1, math.ceil(n / CANDIDATES))
    deal = lambda parts, salt: F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(parts))
    every = lambda first, after: F.explode(F.sequence(F.lit(first).cast("long"), F.lit(after - 1).cast("long")))
    order = Window.partitionBy("_row").orderBy(F.col("score").desc(), "vec_id")
    best, behind, ahead = None, 0, 1
    while behind < blocks:
        met = math.ceil(asked * (ahead - behind) / blocks)  # queries that a block of candidates meets in this round, about
        parts = max(1, math.ceil(met / QUERIES), min(math.ceil(met / FEW_QUERIES), PAIRS // blocks))
        queries = rows.where("_q").select(*[F.col(c).alias(c) for c in ("_row", "vec_id", "v")])  # columns of their own beside the candidates'
        floors = best.where(F.col("rank") == k).select("_row", F.col("score").alias("floor")) if best else None
        queries = queries.join(floors, "_row", "left") if best else queries.withColumn("floor", F.lit(None).cast("long"))
        queries = queries.withColumn("_turn", every(behind, ahead)).select("_row", "vec_id", "v", "floor", F.pmod(deal(blocks, 3) + F.col("_turn"), F.lit(blocks)).alias("cb"), deal(parts, 2).alias("qb"))
        candidates = rows.select("_row", "vec_id", "v", deal(blocks, 1).alias("cb"), every(0, parts).alias("qb"))
        found = candidates.groupBy("cb", "qb").cogroup(queries.groupBy("cb", "qb")).applyInArrow(_search(k), "_row long, query_id long, vec_id long, score long")
        both = found if best is None else best.drop("rank").unionByName(found)
        best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        behind, ahead = ahead, min(blocks, ahead * GROWTH)
        if behind < blocks:
            best = best.transform(settled)
    return best.select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every embedding whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows.select("vec_id", scaled(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0)


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
