"""Where intermediate results are kept, and how rows are told apart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.sources.folders import shared_folder


def settled(df: DataFrame) -> DataFrame:
    """`df`, worked out and written to the shared folder: what is read later doesn't depend on the executors that made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Logical nodes that leave each row where it was.
IN_PLACE = {"Project", "Filter", "Generate", "SubqueryAlias", "View", "LocalRelation"}


def _in_order(node) -> bool:
    """Whether rows come in the same order each time they are asked for: scans of files and written checkpoints, and what leaves rows in place."""
    kind = node.getClass().getSimpleName()
    if kind == "LogicalRelation":
        return node.relation().getClass().getSimpleName() == "HadoopFsRelation"
    if kind == "LogicalRDD":
        return node.rdd().isCheckpointed()
    below = node.children()
    return kind in IN_PLACE and all(_in_order(below.apply(k)) for k in range(below.size()))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with each row's place in its input as the column `name`.

    Rows of files come in the same order each time they are read. Those of anything else (a shuffle, an RDD, a
    database, Python code) need not, so that such an input is written first.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return (df if _in_order(plan) else settled(df)).withColumn(name, F.monotonically_increasing_id())


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with `value` worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: for rows that are large, or read by column. Like all that is written there it is left to whoever owns the folder."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)
