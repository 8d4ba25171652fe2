"""Connected components over DataFrames, and lookups of keys that many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.lineage import settled

#: A key counts as hot if more than one in HOT rows holds it; so there are HOT hot keys at most, and their rows are broadcast.
HOT = 1000
#: Groups that the edges into one node are dealt to.
FAN = 256


def look_up(rows: DataFrame, table: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """`rows` with the columns of `table`, which has one row for a key, or nulls.

    Rows of `table` for which `hot` holds (HOT at most) go to all tasks, so that the many rows that meet them stay
    where they are; the others are shuffled. `rows` and `table` have to be settled. Null keys meet nothing.
    """
    many = table.where(hot)
    met = rows.join(F.broadcast(many), on)
    rest = rows.join(F.broadcast(many.select(*on)), on, "left_anti").join(table.where(~hot), on, "left")
    return met.unionByName(rest)


def fanned(edges: DataFrame) -> DataFrame:
    """(a, b) that join the same nodes, by way of one node for each of FAN parts of the edges into a node: a node that a
    third of all rows point to is met by a small share of them in any task. Edges may repeat."""
    part = Window.partitionBy("b", F.pmod(F.xxhash64("a", F.lit(3)), F.lit(FAN)))
    dealt = edges.select("a", F.min("a").over(part).alias("via"), "b")
    return dealt.select("a", F.when(F.col("a") == F.col("via"), F.col("b")).otherwise(F.col("via")).alias("b")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node of its component.

    Edges should point to the hub of a group, if it has one. Each round takes the least label of the neighbours and
    then the label of that label, so chains shorten by half. Rounds are checkpointed; the driver only learns how many
    labels changed.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = fanned(edges.where("a <> b")).select(ways.alias("e")).select("e.a", "e.b").distinct().transform(settled)
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node").transform(settled)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("a") == F.col("node"), "left").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_via"), F.col("label").alias("_far"))
        new = step.join(jump, F.col("label") == F.col("_via"), "left").select("node", "before", F.least("label", "_far").alias("label")).transform(settled)
        labels = new.select("node", "label")
        if new.where("label <> before").isEmpty():
            return labels
