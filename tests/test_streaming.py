"""Streams equal batch runs, survive a restart, and announce once."""

import pytest
from pyspark.sql import functions as F

from jobloom.operators.dedupe import cross_source_dedupe
from jobloom.operators import reconcile as rc
from jobloom.schemas import CANDIDATE_COLS, JOB_STATE, POSTING
from jobloom.session import scratch
from jobloom.settings import Settings
from jobloom.sources.state import StateStore
from jobloom.streaming.harvest import harvest_stream
from jobloom.streaming.sync import announce, process_run, sync_stream

from tests.test_reconcile import postings

PLAIN = Settings(enrich_descriptions=False)


def ts(run_id):
    return f"2026-03-{run_id + 1:02}T00:00:00+00:00"


def land(spark, landing, run_id, rows):
    spark.createDataFrame(rows, POSTING).write.parquet(f"{landing}/runs/run_id={run_id}")
    announce(spark, landing, run_id, ts(run_id))


def test_sync_stream(spark):
    landing, root = scratch(spark, "landing"), scratch(spark, "root")
    batches = [postings(seed, n=60, ids=40) for seed in (11, 12, 13)]
    order = []

    def stream():
        q = sync_stream(spark, landing, root, f"{root}/cp", PLAIN, order.append)
        q.awaitTermination()

    land(spark, landing, 0, batches[0])
    land(spark, landing, 1, batches[1])
    stream()
    land(spark, landing, 2, batches[2])
    stream()
    stream()
    assert order == [0, 1, 2]

    state = spark.createDataFrame([], JOB_STATE)
    for run_id, rows in enumerate(batches):
        kept = cross_source_dedupe(spark.createDataFrame(rows, POSTING))
        state = spark.createDataFrame(rc.next_state(rc.reconcile(kept, state, ts(run_id))).collect(), JOB_STATE)
    store = StateStore(spark, root)
    assert store.last_run() == 2
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, state.collect()), key=str)
    told = spark.read.parquet(f"{root}/fresh")
    assert told.count() == told.select("job_id").distinct().count()


def test_run_is_processed_once(spark):
    landing, root = scratch(spark, "landing"), scratch(spark, "root")
    land(spark, landing, 5, postings(1, n=20))
    store = StateStore(spark, root)
    assert store.last_run() is None and store.read().count() == 0
    # A run that died before its commit is simply done again.
    store.write(spark.createDataFrame([], JOB_STATE), 5)
    assert process_run(spark, landing, store, 5, ts(5), PLAIN)
    first = sorted(map(tuple, store.read().collect()), key=str)
    assert not process_run(spark, landing, store, 5, ts(6), PLAIN)
    assert sorted(map(tuple, store.read().collect()), key=str) == first and first


def test_harvest_stream(spark):
    landing, out = scratch(spark, "texts"), scratch(spark, "found")
    schema = "doc bigint, body string"

    def put(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)

    def stream():
        texts = spark.readStream.schema(schema).parquet(landing)
        harvest_stream(texts, "texts", "doc", out, f"{out}-cp").awaitTermination()

    put([(1, "jobs.lever.co/a jobs.lever.co/b"), (2, "nothing")])
    stream()
    put([(3, "jobs.lever.co/a")])
    stream()
    stream()
    got = spark.read.parquet(out)
    assert got.columns == CANDIDATE_COLS
    rows = got.select("board_key", F.floor(F.col("seq") / 10**12).cast("int").alias("doc")).collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("a", 3), ("b", 1)]


def test_late_runs_fail_and_are_not_reported(spark):
    landing, root = scratch(spark, "landing"), scratch(spark, "root")
    store, order = StateStore(spark, root), []
    for run_id in (0, 1):
        land(spark, landing, run_id, postings(run_id + 30, n=10))
    assert process_run(spark, landing, store, 1, ts(1), PLAIN)
    with pytest.raises(ValueError, match="announced after run 1"):
        process_run(spark, landing, store, 0, ts(0), PLAIN)
    assert not process_run(spark, landing, store, 1, ts(1), PLAIN)
    query = sync_stream(spark, landing, root, f"{root}/cp", PLAIN, order.append)
    with pytest.raises(Exception, match="announced after run 1"):
        query.awaitTermination()
    assert order == []


def test_damaged_commits_are_no_empty_state(spark, tmp_path):
    (tmp_path / "commits").mkdir()
    (tmp_path / "commits" / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        StateStore(spark, str(tmp_path)).last_run()
    assert StateStore(spark, str(tmp_path / "none")).last_run() is None


def test_scratch_goes_and_snapshots_are_kept(spark):
    import os

    from jobloom.session import shared_dir

    landing, root = scratch(spark, "landing"), scratch(spark, "root")
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    store, few = StateStore(spark, root), Settings(enrich_descriptions=False, keep_snapshots=2)
    for run_id in range(4):
        land(spark, landing, run_id, postings(run_id + 40, n=15))
    before = set(os.listdir(folder))
    for run_id in range(4):
        assert process_run(spark, landing, store, run_id, ts(run_id), few)
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} <= {"root"}
    assert sorted(os.listdir(f"{root.removeprefix('file://').removeprefix('file:')}/state")) == ["run_id=2", "run_id=3"]
    assert store.read().count() > 0
