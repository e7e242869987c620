"""A scan from rowsets to a stored snapshot: closure, what belongs to it, ids, lineage, then one write for each table."""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from ..operators.cascade import compute_closure
from ..sources.catalog import attempted, cancelled
from ..sources.schemas import SCHEMAS, conformed
from ..sources.store import Store
from . import snapshot


PHASES = ("cascade", "extract", "stats", "lineage", "finalize")
#: Tables of every scan; those without rows are written all the same.
TABLES = tuple(t for t in SCHEMAS if t not in ("scans", "annotations", "tags", "tag_assignments", "meta"))


def tag(number: int) -> str:
    return f"scan-{number}"


class Progress:
    """Where a scan is, for whoever asks from any thread: its phase, the last messages, tables written, and Spark's counts of its jobs."""

    def __init__(self, kept: int = 200):
        self.phase: str | None = None
        self.log: deque[str] = deque(maxlen=kept)
        self.tables = 0

    def wrote(self, table: str) -> None:
        self.tables += 1
        self.log.append(f"{table} written")

    @staticmethod
    def counts(store: Store, number: int) -> dict[str, int]:
        """Jobs, tasks, finished tasks and running tasks of a scan's jobs that Spark still remembers, by the tag they carry."""
        tracker, total = store.spark._jsc.sc().statusTracker(), dict.fromkeys(("jobs", "tasks", "done", "active"), 0)
        for job in tracker.getJobIdsForTag(tag(number)):
            info = tracker.getJobInfo(job)
            total["jobs"] += 1
            for stage in info.get().stageIds() if info.isDefined() else ():
                at = tracker.getStageInfo(stage)
                if at.isDefined():
                    for name, count in (("tasks", at.get().numTasks()), ("done", at.get().numCompletedTasks()), ("active", at.get().numActiveTasks())):
                        total[name] += count
        return total

    def enter(self, phase: str) -> None:
        self.phase = phase
        self.log.append(f"{phase} began")


def scan(store: Store, number: int, connection: str, required: dict[str, DataFrame], optional: dict[str, Callable[[], DataFrame]], selected: DataFrame, progress: Progress | None = None, details: dict[str, DataFrame] | None = None, lineage: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None, **options) -> list[str]:
    """Writes a scan and returns its warnings. required: objects, dependencies, foreign_keys, triggers, synonyms; optional: statistics, each a function; details: any of databases, columns,
    parameters, indexes, index_columns, foreign_keys, foreign_key_columns, check_constraints, modules, descriptions; lineage: a
    function of the stored objects and columns that gives column edges and issues.

    Only one scan of a connection runs at a time, from its first job on. Its state is `running` until it is `succeeded`, `failed` or
    `cancelled`. A family of statistics that can't be read, also one that fails only while it is written, gives a warning and
    leaves the others. All of the scan's jobs carry its tag, by which cancel() asks Spark to interrupt them.
    """
    spark, progress = store.spark, progress or Progress()
    clock = lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    with store.single_flight(connection):
        started = clock()
        store.state(number, connection, "running", started)
        spark.sparkContext.addJobTag(tag(number))
        spark.addTag(tag(number))
        try:
            progress.enter("cascade")
            closure = compute_closure(required["objects"], required["dependencies"], required["foreign_keys"], required["triggers"], required["synonyms"], selected, **options)
            progress.enter("extract")
            details = details or {}
            found = snapshot.objects(connection, required["objects"], closure, details.get("modules"), details.get("descriptions"))
            put = lambda name, rows: (store.write_table(number, name, conformed(rows, name)), written.add(name), progress.wrote(name))
            written: set[str] = set()
            put("objects", found)
            found = store.read("objects", number)
            if "databases" in details:
                put("databases", details["databases"])
            tables = snapshot.keyed({k: v for k, v in details.items() if k not in ("databases", "modules", "descriptions")}, found, closure)
            for name, rows in tables.items():
                put(name, rows)
            progress.enter("stats")

            def stored(name: str, load: Callable[[], DataFrame]) -> DataFrame:
                rows = load()
                if name == "index_usage" and "indexes" in tables:
                    put(name, snapshot.usage(rows, tables["indexes"]))
                else:
                    put(name, snapshot.keyed({name: rows}, found, closure)[name])
                return rows

            _, warnings = attempted(**{name: partial(stored, name, load) for name, load in optional.items()})
            progress.enter("lineage")
            if lineage:
                edges, issues = lineage(found, store.read("columns", number) if "columns" in written else spark.createDataFrame([], SCHEMAS["columns"]))
                put("column_lineage", edges)
                put("lineage_issues", issues)
            progress.enter("finalize")
            put("warnings", spark.createDataFrame([(w,) for w in warnings], SCHEMAS["warnings"]))
            for name in TABLES:
                if name not in written:
                    put(name, spark.createDataFrame([], SCHEMAS[name]))
        except BaseException as error:
            _untag(store, number)
            store.state(number, connection, "cancelled" if cancelled(error) else "failed", started, clock(), f"{type(error).__name__}: {error}"[:2000])
            raise
        _untag(store, number)
        store.state(number, connection, "succeeded", started, clock())
        return warnings


def _untag(store: Store, number: int) -> None:
    store.spark.removeTag(tag(number))
    store.spark.sparkContext.removeJobTag(tag(number))


def cancel(store: Store, number: int) -> None:
    """Interrupts the scan's jobs; Spark ends the Python workers of tasks that it kills. No-one waits for anything here."""
    store.spark.interruptTag(tag(number))
    store.spark.sparkContext.cancelJobsWithTag(tag(number))
