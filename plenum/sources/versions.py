"""Several tables published as one version: readers see all of a change or none of it.

A version is staged in a folder of its own and published by renaming that folder, which file systems with atomic renames
(HDFS, local) do at once; on an object store that copies instead, put the folder on a file system that renames.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the last published version; 0 if there is none."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=0)


def read(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, or of the last one."""
    return spark.read.parquet(f"{folder}/v{version or latest(spark, folder)}/{name}")


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """Writes all tables and then publishes them as the next version, whose number it gives.

    If a table can't be written, nothing is published and readers stay where they are. Of two writers of the same
    number the later fails: the number is claimed by a file that only one can make.
    """
    fs, path = _fs(spark, folder)
    n = latest(spark, folder) + 1
    staged = f"{folder}/_staged/{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{staged}/{name}")
    fs.create(path(f"{folder}/_claims/{n}"), False).close()
    if not fs.rename(path(staged), path(f"{folder}/v{n}")):
        raise RuntimeError(f"version {n} of {folder} can't be published")
    return n
