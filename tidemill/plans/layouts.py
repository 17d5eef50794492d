"""What a table's layout does to queries: the same rows in several layouts, timed in interleaved rounds, with files read."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.session import settings
from tidemill.operators.marts import measured
from tidemill.sources.versioned import Predicate, VersionedTable

#: name: columns to range or interleave by; None: left as written in many small files
VARIANTS: dict[str, list[str] | None] = {"baseline": None, "compacted": [], "zorder_1col": ["PULocationID"], "zorder_2col": ["PULocationID", "tpep_pickup_datetime"], "clustered": ["PULocationID", "tpep_pickup_datetime"]}
SUMMARY = {"trips": "count(*)", "fare": "cast(sum(cast(fare_amount as decimal(18, 2))) as double)", "tip": "cast(sum(cast(tip_amount as decimal(18, 2))) as double)"}


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Files and bytes that the scans of an executed plan selected; call after df.collect()."""
    files = size = 0

    def visit(node) -> None:
        nonlocal files, size
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name.startswith("FileSourceScan"):
            m = node.metrics()
            files += m.apply("numFiles").value() if m.contains("numFiles") else 0
            size += m.apply("filesSize").value() if m.contains("filesSize") else 0
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return {"files": files, "bytes": size}


def stage_metrics(spark: SparkSession, do: Callable[[], Any]) -> list[dict[str, Any]]:
    """What each stage of the jobs that `do` runs took: tasks, seconds in them, rows and bytes shuffled, bytes spilled."""
    sc, group = spark.sparkContext, f"stages-{time.monotonic_ns()}"
    sc.setJobGroup(group, "stage metrics")
    try:
        do()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store, out = sc.statusTracker(), sc._jsc.sc().statusStore(), []
    for stage in sorted({i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}):
        try:
            s = store.lastStageAttempt(stage)
        except Py4JJavaError:  # skipped: its output was there
            continue
        if s.status().toString() == "COMPLETE":
            out.append({"stage": stage, "name": s.name(), "tasks": s.numTasks(), "task_seconds": s.executorRunTime() / 1000, "rows_read": s.inputRecords() + s.shuffleReadRecords(), "shuffled_bytes": s.shuffleWriteBytes(), "spilled_bytes": s.diskBytesSpilled()})
    return out


def join_kinds(df: DataFrame) -> list[str]:
    """Kinds of joins in the plan that would run."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [k for k in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin") if k in text]


def shuffle_sweep(df: DataFrame, partitions: list[int]) -> list[dict[str, float]]:
    """Seconds of one query for several numbers of shuffle partitions, with and without adaptive execution."""
    spark, out = df.sparkSession, []
    for n in partitions:
        for adaptive in (True, False):
            with settings(spark, spark__sql__shuffle__partitions=n, spark__sql__adaptive__enabled=str(adaptive).lower()):
                began = time.perf_counter()
                # a new plan, so that the settings take part
                df.select("*").write.format("noop").mode("overwrite").save()
                out.append({"partitions": n, "adaptive": adaptive, "seconds": round(time.perf_counter() - began, 3)})
    return out


def build(source: DataFrame, root: str, *, baseline_files: int = 200, target_bytes: int = 32 << 20) -> dict[str, VersionedTable]:
    """The same rows in each layout."""
    out = {}
    for name, by in VARIANTS.items():
        t = VersionedTable(source.sparkSession, f"{root}/{name}")
        if not t.exists():
            t.create(source.repartition(baseline_files, F.rand(7)), cluster=by if name == "clustered" else ())
            if name == "clustered":
                t.recluster(target_bytes)
            elif by is not None:
                t.optimize(target_bytes, by=by)
        out[name] = t
    return out


def timed(table: VersionedTable, where: list[Predicate]) -> tuple[float, dict, dict]:
    df = measured(table.read(where=where), [], SUMMARY)
    began = time.perf_counter()
    row = df.collect()[0].asDict()
    return time.perf_counter() - began, row, scan_metrics(df)


def rounds(tables: dict[str, VersionedTable], queries: dict[str, list[Predicate]], n: int = 5) -> dict[str, Any]:
    """One warm-up and n measured rounds, layouts interleaved; medians, and whether all layouts gave the same results."""
    if n < 3:
        raise ValueError("at least 3 rounds are needed for a median")
    times: dict[tuple[str, str], list[float]] = {}
    seen: dict[tuple[str, str], tuple[dict, dict]] = {}
    for i in range(n + 1):
        for q, where in queries.items():
            for name, t in tables.items():
                s, row, scan = timed(t, where)
                seen[q, name] = row, scan
                if i:
                    times.setdefault((q, name), []).append(s)
    same = {q: len({str(seen[q, name][0]) for name in tables}) == 1 for q in queries}
    return {
        "queries": {q: {name: {"median_ms": round(statistics.median(times[q, name]) * 1000, 1), "min_ms": round(min(times[q, name]) * 1000, 1), "max_ms": round(max(times[q, name]) * 1000, 1)} | seen[q, name][1] for name in tables} for q in queries},
        "same_results": same,
    }


def size_sweep(source: DataFrame, root: str, where: list[Predicate], by: list[str], sizes: list[int]) -> list[dict[str, int]]:
    """Files in all and files that a query reads, for several target sizes."""
    out = []
    for size in sizes:
        t = VersionedTable(source.sparkSession, f"{root}/sweep-{size}")
        if not t.exists():
            t.create(source.repartition(8))
            t.optimize(size, by=by)
        out.append({"target_bytes": size, "files": len(t.files()), "selected": len(t.files(where=where))})
    return out


def run(lake, *, n: int = 3, baseline_files: int = 24, target_bytes: int = 64 << 10) -> dict[str, Any]:
    """The benchmark over a lakehouse's trips."""
    source = lake.trips.read().drop("dq_flags")
    tables = build(source, f"{lake.folder.root}/benchmark", baseline_files=baseline_files, target_bytes=target_bytes)
    week = [("tpep_pickup_datetime", ">=", "2025-01-06 00:00:00"), ("tpep_pickup_datetime", "<", "2025-01-13 00:00:00")]
    queries = {"zone": [("PULocationID", "=", 132)], "zone_week": [("PULocationID", "=", 161), *week], "control": [("payment_type", "=", 2)]}
    return rounds(tables, queries, n) | {"tables": {name: t.detail() for name, t in tables.items()}}
