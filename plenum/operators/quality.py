"""Declared constraints as queries that list what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_exactly_one(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both or neither are set."""
    return rows.where(F.col(a).isNull() == F.col(b).isNull())


def missing(rows: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows without a parent."""
    return rows.join(parents, rows[key] == parents[parent], "left_anti")


def outside(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows whose value is not in the domain; null is."""
    return rows.where(~F.col(column).isin(*domain))
