"""Snapshots in Parquet: one folder a table, one partition a scan; the row in `scans` is written last.

A scan's states are rows of its own folder under `scans`, each a file that is added, so no file is ever rewritten; the latest
state counts. Readers look only at scans that succeeded, so a scan that broke off is never taken for a snapshot. Deleting a
scan removes its states' folder first; from then on nobody sees it. Folders are reached through Spark's file system interface,
so any store that Spark reads will do.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.reads import prunable
from ..operators.stored_graph import StoredGraph, opened, store
from .schemas import SCHEMAS

SCANS = SCHEMAS["scans"]
FINISHED = ("succeeded", "failed", "cancelled")
FLOW = "flow_edges"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._running: set[str] = set()
        self._lock = threading.Lock()

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    @contextmanager
    def single_flight(self, connection: str) -> Iterator[None]:
        """One scan of a connection at a time; others of other connections may run."""
        name = connection.lower()
        with self._lock:
            if name in self._running:
                raise RuntimeError(f"a scan of {connection} is running")
            self._running.add(name)
        try:
            yield
        finally:
            with self._lock:
                self._running.discard(name)

    def scans(self) -> DataFrame:
        """The latest state of each scan."""
        if not self._exists(f"{self.path}/scans"):
            return self.spark.createDataFrame([], SCANS)
        names = [f.name for f in StructType.fromDDL(SCANS)]
        states = self.spark.read.schema(f"{SCANS}, part long").parquet(f"{self.path}/scans")
        latest = F.max_by(F.struct(*names), F.struct(F.col("status").isin(*FINISHED), "finished"))
        return states.groupBy("part").agg(latest.alias("s")).select("s.*")

    def state(self, scan: int, connection: str, status: str, started, finished=None, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(scan, connection, status, started, finished, error)], SCANS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/scans/part={scan}")

    def write_table(self, scan: int, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/scan={scan}")

    def write(self, scan: int, connection: str, started, finished, tables: dict[str, DataFrame]) -> None:
        """All tables of a scan, then its row."""
        with self.single_flight(connection):
            for name, rows in tables.items():
                self.write_table(scan, name, rows)
            self.state(scan, connection, "succeeded", started, finished)

    def read(self, name: str, scan: int) -> DataFrame:
        """One scan's rows of a table; only its partition is listed and read."""
        return self.spark.read.parquet(f"{self.path}/{name}/scan={scan}")

    def graph(self, scan: int, buckets: int = 64) -> StoredGraph:
        """A succeeded scan's flow edges between ids of its objects, written at the first call and deleted with the scan."""
        folder = f"{self.path}/{FLOW}/scan={scan}"
        if self.scans().filter((F.col("scan") == scan) & (F.col("status") == "succeeded")).isEmpty():
            raise LookupError(f"scan {scan} has not succeeded")
        if self._exists(f"{folder}/meta/_SUCCESS"):
            return opened(self.spark, folder)
        nodes = self.read("objects", scan).select(F.col("id").alias("node"), "kind", "schema", "scope")
        uses = self.read("dependencies", scan).select(F.concat_ws(">", F.col("of_source").cast("string"), F.col("of_target").cast("string"), "kind").alias("id"), F.col("of_source").alias("source"), F.col("of_target").alias("target"), "kind")
        return store(nodes, uses, folder, buckets)

    def delete(self, scans: list[int], tables: list[str]) -> None:
        """The states go first, so that nobody reads what is being deleted. A scan that runs is refused."""
        running = self.scans().filter(F.col("scan").isin(*scans) & (F.col("status") == "running")) if scans else None
        if running is not None and not running.isEmpty():
            raise RuntimeError("a scan that runs can't be deleted")
        for scan in scans:
            self._delete(f"{self.path}/scans/part={scan}")
            for name in (*tables, FLOW):
                self._delete(f"{self.path}/{name}/scan={scan}")

    def prune(self, keep: int, tables: list[str]) -> list[int]:
        old = [r.scan for r in prunable(self.scans(), keep).select("scan").collect()]
        if old:
            self.delete(old, tables)
        return old
