"""Incremental runs as a stream of run announcements.

A landing job writes ``runs/run_id=N`` and, once that folder is whole, one row
(run_id, run_ts) to ``announced``. The stream reads only the announcements, so a
micro-batch always sees whole runs: an id that is absent from a run is removed,
which must not happen because half of the run had landed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from jobloom.operators.scoring import Scorer
from jobloom.plans.hourly import run
from jobloom.session import temporary, written
from jobloom.settings import Settings
from jobloom.sources.deltas import DeltaStore
from jobloom.sources.state import StateStore

# What a run leaves behind; the state is read by the next run.
OUTPUTS = ("state", "fresh", "messages", "sheet_rows", "counters")
ANNOUNCED = "run_id BIGINT, run_ts STRING"
# Announcements read at once; each is a file of one row.
RUNS_PER_BATCH = 100


def process_run(
    spark: SparkSession,
    landing: str,
    store: StateStore | DeltaStore,
    run_id: int,
    run_ts: str,
    settings: Settings = Settings(),
    scorer: Callable[[], Scorer] | None = None,
    complete_sources: Sequence[str] | None = None,
) -> bool:
    """Reconcile one landed run; False, and nothing happens, if it was committed before.

    Detail payloads are read from ``details/run_id=N`` if the run landed any. A run that was
    announced only after a later one can't be told from absences, so it fails.

    Outputs go to folders of the run's own, overwritten on a retry, and the commit
    comes last: a job is announced once however often the run is tried.
    """
    last = store.last_run()
    if last is not None and run_id <= last:
        if not store.committed(run_id):
            raise ValueError(f"run {run_id} was announced after run {last}; its absences can't be told")
        return False
    postings = spark.read.parquet(f"{landing}/runs/run_id={run_id}")
    details = landed_details(spark, landing, run_id)
    with temporary(spark):  # what the run stores for itself goes once its outputs are there
        deltas = store if isinstance(store, DeltaStore) else None
        result = run(
            postings, store.read(), run_ts, details, settings, scorer,
            complete_sources=complete_sources, store=deltas,
        )

        if deltas is not None:
            result.state = written(result.state, "changes")

        def write(name: str) -> str | None:
            table: DataFrame = getattr(result, name)
            if name == "state" and deltas is not None:
                return deltas.write(table, run_id, run_ts)
            table.write.mode("overwrite").parquet(f"{store.root}/{name}/run_id={run_id}")

        # Independent small jobs: side by side they share the cluster.
        with ThreadPoolExecutor(len(OUTPUTS)) as pool:
            done = dict(zip(OUTPUTS, pool.map(write, OUTPUTS), strict=True))
        if deltas is None:
            store.commit(run_id)
        else:
            deltas.commit(run_id, run_ts, done["state"])
    if settings.keep_snapshots is not None:
        store.prune(settings.keep_snapshots)
    return True


def landed_details(spark: SparkSession, landing: str, run_id: int) -> DataFrame | None:
    """The run's detail payloads; None if no such folder landed."""
    try:
        return spark.read.parquet(f"{landing}/details/run_id={run_id}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def sync_stream(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    settings: Settings = Settings(),
    on_run: Callable[[int], None] | None = None,
    scorer: Callable[[], Scorer] | None = None,
    complete_sources: Sequence[str] | None = None,
    store: StateStore | DeltaStore | None = None,
) -> StreamingQuery:
    """Process every announced run, in order of run id, then stop.

    State is kept in ``store``, by default as one snapshot per run below ``root``.
    """
    store = StateStore(spark, root) if store is None else store

    def each(batch: DataFrame, _: int) -> None:
        # One row per new run: a few numbers, not data.
        for row in batch.distinct().orderBy("run_id").collect():
            done = process_run(
                spark, landing, store, row.run_id, row.run_ts, settings, scorer, complete_sources
            )
            if done and on_run is not None:
                on_run(row.run_id)

    announced = spark.readStream.schema(ANNOUNCED).option("maxFilesPerTrigger", RUNS_PER_BATCH).parquet(f"{landing}/announced")
    return (
        announced.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def announce(spark: SparkSession, landing: str, run_id: int, run_ts: str) -> None:
    """Tell the stream that a run's folder is whole."""
    row = spark.createDataFrame([(run_id, run_ts)], ANNOUNCED).coalesce(1)
    row.write.mode("append").parquet(f"{landing}/announced")
