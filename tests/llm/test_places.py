"""Rows whose order is not settled are written before they are numbered; files and written rows are not written again."""


import pytest
from pyspark.sql import functions as F

from plenum.llm import lineage


def test_what_is_trusted(spark, tables, monkeypatch):
    written = []
    monkeypatch.setattr(lineage, "settled", lambda df: written.append(1) or df)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for trusted in (docs, docs.where("doc_id > 3").select("text", F.explode(F.split("text", " "))), spark.sql("SELECT * FROM VALUES (1), (2) AS t(a)"), docs.select("doc_id").checkpoint()):
        lineage.numbered(trusted, "n")
    assert not written
    shuffled = spark.sparkContext.parallelize(range(100), 4).map(lambda k: (k % 7, k)).groupByKey(3).mapValues(lambda v: sum(v))
    loose = [docs.repartition(3), docs.orderBy("text"), docs.distinct(), docs.union(docs), docs.limit(5), spark.createDataFrame(shuffled, "k long, v long"), docs.select("doc_id").mapInArrow(lambda b: b, "doc_id long"), docs.select("doc_id").sample(0.5)]
    for k, df in enumerate(loose):
        lineage.numbered(df, "n")
        assert len(written) == k + 1


def test_places_hold_for_a_shuffled_rdd(spark):
    """A second evaluation in another order doesn't change which row has which place."""
    calls = spark.sparkContext.accumulator(0)

    def turned(rows):
        calls.add(1)
        rows = list(rows)
        return reversed(rows) if __import__("time").time_ns() & 1024 else rows

    rdd = spark.sparkContext.parallelize(range(500), 4).map(lambda k: (k % 50, k)).groupByKey(3).mapPartitions(turned).map(lambda kv: (kv[0], sorted(kv[1])[0]))
    df = lineage.numbered(spark.createDataFrame(rdd, "k long, v long"), "at")
    once = calls.value
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect())) and calls.value == once > 0


def test_places_hold_for_a_database_table(spark, tmp_path):
    """A JDBC scan is written first."""
    jvm = spark._jvm
    try:
        jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no JDBC driver here")
    url = f"jdbc:derby:{tmp_path}/d;create=true"
    spark.range(40).write.mode("overwrite").jdbc(url, "t", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    rows = spark.read.jdbc(url, "t", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    assert not lineage._in_order(rows._jdf.queryExecution().optimizedPlan())
    df = lineage.numbered(rows, "at")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect()))
