"""New scans as a stream: each finished snapshot's rows of a table are handed on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, table: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that calls handle(rows, batch) for the rows that new scan partitions bring; it ends when all is read."""
    rows = spark.readStream.schema(f"{schema}, scan long").parquet(f"{path}/{table}")
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
