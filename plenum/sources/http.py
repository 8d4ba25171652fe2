"""Documents and paged lists over HTTP, read by tasks: each has its own links, or its own range of keys."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Tries of a request, and seconds until it counts as failed.
TRIES, TIMEOUT = 4, 20


def get(url: str, tries: int = TRIES, pause: float = 1.0) -> str:
    """The body of an answer; tried again after errors and in overload, not if the link itself is refused (4xx)."""
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or attempt == tries:
                raise
        except (urllib.error.URLError, OSError):
            if attempt == tries:
                raise
        time.sleep(pause * 2 ** (attempt - 1))
    raise AssertionError


def fetched(links: DataFrame, pause: float = 1.0) -> DataFrame:
    """(key, body, error) of signed links (key, url): the body, or why a link could not be read. Each evaluation reads again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, url in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                body = error = None
                try:
                    body = get(url, pause=pause)
                except (OSError, ValueError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.schema.field(0).type), pa.array([body], pa.string()), pa.array([error], pa.string())], ["key", "body", "error"])

    return links.select("key", "url").mapInArrow(run, f"key {dict(links.dtypes)['key']}, body string, error string")


def documents(links: DataFrame, schema: str, parts: int, pause: float = 1.0) -> DataFrame:
    """(key, error, the document's fields), a task for each share of the links."""
    rows = fetched(links.repartition(parts, "key"), pause)
    return rows.select("key", "error", F.from_json("body", schema).alias("d")).select("key", "error", "d.*")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Pages(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        low, high, parts = (int(self.options[k]) for k in ("low", "high", "parts"))
        cuts = [low + (high - low) * k // parts for k in range(parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: _Range) -> Iterator[tuple]:
        key, after = self.options.get("key", "id"), partition.low - 1
        while True:  # seeks past the last key, so that no page is counted through
            asked = urllib.parse.urlencode({"after": after, "below": partition.high, "limit": self.options.get("limit", "100")})
            rows = json.loads(get(f"{self.options['url']}?{asked}", pause=float(self.options.get("pause", "1"))))["results"]
            for r in rows:
                yield tuple(r.get(f.name) for f in self.schema.fields)
            if not rows:
                return
            after = rows[-1][key]


class Pages(DataSource):
    """A paged list of JSON objects with ascending integer keys. Options: url, low, high (keys, the last exclusive), parts, key, limit, pause; the schema is the caller's."""

    @classmethod
    def name(cls) -> str:
        return "plenum_pages"

    def schema(self) -> str:
        return "id long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(schema, dict(self.options))


def pages(spark: SparkSession, url: str, schema: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """The rows of a paged list: `parts` tasks, each over a range of keys."""
    spark.dataSource.register(Pages)
    return spark.read.format("plenum_pages").schema(schema).options(url=url, low=low, high=high, parts=parts, **options).load()
