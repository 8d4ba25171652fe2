"""Webhooks that are sent, tried again, and kept as dead letters if nothing helps.

Rows are sent by the tasks that hold them. What came of each is a row of a table that Spark writes for each
micro-batch, so that the sink needs no folder that its tasks and the driver see alike but those that Spark writes to. A
micro-batch that is run again replaces its own outcomes, and sends with the same keys: the receiver tells repeats by them.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries after the first, and seconds until a connection or an answer counts as failed.
RETRIES, TIMEOUT = 3, 20

#: Sends one body: (key, body, attempt from 1). Raises RequestError if it may be tried again.
Send = Callable[[str, str, int], None]
OUTCOME = "key string, body string, status string, attempts int, error string"


class RequestError(Exception):
    """No connection, no answer in time, or an answer that isn't a success."""


def http(url: str, token: str | None = None, timeout: float = TIMEOUT) -> Send:
    """A sender that posts JSON, with the key in a header."""

    def send(key: str, body: str, attempt: int) -> None:
        head = {"Content-Type": "application/json", "Idempotency-Key": key, "User-Agent": "plenum"} | ({"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body.encode(), head, method="POST"), timeout=timeout) as answer:
                answer.read()
        except (urllib.error.URLError, OSError) as e:  # HTTP errors are URL errors
            raise RequestError(str(e)) from e

    return send


def outcomes(rows: DataFrame, send: Send, retries: int = RETRIES, pause: float = 1.0) -> DataFrame:
    """Sends every row (key, body) and gives its OUTCOME: `delivered`, or `dead` after `retries` more tries, with the last error.

    The wait before a try doubles from `pause` seconds on. Each evaluation sends again, so the result has to be written
    once and then read. Errors other than RequestError are not tried again and fail the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"status": [], "attempts": [], "error": []}
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error = None
                for attempt in range(1, retries + 2):
                    try:
                        send(key, body, attempt)
                        error = None
                        break
                    except RequestError as e:
                        error = str(e)
                        if attempt <= retries:
                            time.sleep(pause * 2 ** (attempt - 1))
                out["status"].append("dead" if error is not None else "delivered")
                out["attempts"].append(attempt)
                out["error"].append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out["status"]), pa.array(out["attempts"], pa.int32()), pa.array(out["error"], pa.string())], ["key", "body", "status", "attempts", "error"])

    return rows.select("key", "body").mapInArrow(run, OUTCOME)


def idempotency_key(*parts) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def deliver(stream: DataFrame, folder: str, checkpoint: str, send: Send, retries: int = RETRIES, pause: float = 1.0):
    """Sends every row (key, body) of a stream; the outcomes of micro-batch n are in folder/batch=n."""

    def one(rows: DataFrame, n: int) -> None:
        outcomes(rows, send, retries, pause).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """All outcomes, with their micro-batch."""
    return spark.read.schema(f"{OUTCOME}, batch long").parquet(folder)


def redeliver(spark: SparkSession, folder: str, again: str, send: Send, retries: int = RETRIES, pause: float = 1.0) -> DataFrame:
    """Sends the dead letters of `folder` again; their new outcomes are in the folder `again`."""
    outcomes(delivered(spark, folder).where(F.col("status") == "dead"), send, retries, pause).write.mode("overwrite").parquet(again)
    return spark.read.schema(OUTCOME).parquet(again)
