"""A state of deltas equals one of whole snapshots, and shuffles no state."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import reconcile as rc
from jobloom.operators.dedupe import cross_source_dedupe
from jobloom.schemas import JOB_STATE, POSTING, STATE_COLS
from jobloom.session import scratch, written
from jobloom.settings import Settings
from jobloom.sources.deltas import DeltaStore, key_hash
from jobloom.streaming.sync import announce, process_run, sync_stream

from tests.test_plans import plan
from tests.test_reconcile import postings

PLAIN = Settings(enrich_descriptions=False)


def ts(run_id):
    return f"2026-03-{run_id + 1:02}T00:00:00+00:00"


def rows_of(df):
    return sorted((tuple(r[c] for c in STATE_COLS) for r in df.collect()), key=str)


def step(spark, store, batch, run_id, complete=None):
    """One run into ``store``, without the other outputs; the number of rows written."""
    kept = cross_source_dedupe(spark.createDataFrame(batch, POSTING))
    changes = written(rc.changes(kept, store.read(), ts(run_id), store.last_ts(), complete_sources=complete), "changes")
    store.commit(run_id, ts(run_id), store.write(changes, run_id, ts(run_id)))
    return changes.count()


def whole(spark, state, batch, run_id, complete=None):
    kept = cross_source_dedupe(spark.createDataFrame(batch, POSTING))
    after = rc.next_state(rc.reconcile(kept, state, ts(run_id), complete_sources=complete))
    return spark.createDataFrame(after.collect(), JOB_STATE)


def key_set(state):
    return {bytes(r.k) for r in rc.active_keys(state).select(key_hash(F.col("fuzzy_key")).alias("k")).distinct().collect()}


@pytest.mark.parametrize("compact_after", [2, 24])
def test_equals_snapshots(spark, compact_after):
    """Random runs, some with a failed source, over several compactions."""
    store = DeltaStore(spark, scratch(spark, "deltas"), compact_after=compact_after)
    state = spark.createDataFrame([], JOB_STATE)
    assert store.read().count() == 0 and store.last_run() is None and store.active_keys().count() == 0
    for run_id in range(6):
        batch = postings(run_id + 70, n=50, ids=40)
        complete = ["lever"] if run_id in (2, 3) else None
        step(spark, store, batch, run_id, complete)
        state = whole(spark, state, batch, run_id, complete)
        assert rows_of(store.read()) == rows_of(state), run_id
        assert {bytes(r.key) for r in store.active_keys().collect()} == key_set(state), run_id
    assert store.last_run() == 5 and store.version().generation == (0 if compact_after > 6 else 2)


def test_a_run_writes_only_what_it_changed(spark):
    store = DeltaStore(spark, scratch(spark, "deltas"))
    batch = [(i, f"j{i}", f"C{i}", "Intern", f"u{i}", "NYC", "", "lever", "") for i in range(100)]
    assert step(spark, store, batch, 0) == 100
    assert step(spark, store, batch, 1) == 0
    assert {r.last_seen for r in store.read().collect()} == {ts(1)}
    batch[3] = (3, "j3", "C3", "Analyst", "u3", "NYC", "", "lever", "")
    assert step(spark, store, batch[:99], 2) == 2
    by = {r.job_id: r for r in store.read().collect()}
    assert by["j3"].title == "Analyst" and by["j99"].status == "removed" and len(by) == 100
    assert {r.last_seen for r in by.values()} == {ts(2)}
    assert step(spark, store, batch[:99], 3) == 0
    by = {r.job_id: r.last_seen for r in store.read().collect()}
    assert by["j99"] == ts(2) and by["j3"] == ts(3)


def test_state_side_is_not_shuffled(spark):
    """Neither a base with three deltas nor the index goes through an exchange."""
    store = DeltaStore(spark, scratch(spark, "deltas"), buckets=4)
    for run_id in range(2):
        step(spark, store, postings(run_id, n=60), run_id)
    store.compact()
    for run_id in range(2, 5):
        step(spark, store, postings(run_id, n=60), run_id)
    version = store.version()
    assert version.base and len(version.attempts) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(store.read()) and "Exchange" not in plan(store.active_keys())
        batch = written(spark.createDataFrame(postings(9), POSTING).drop("description"), "batch")
        p = plan(rc.changes(batch, store.read(), ts(5), store.last_ts()))
        assert p.count("hashpartitioning(job_id") == 1 and p.count("Bucketed: true") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unnamed_attempts_do_not_count(spark):
    """What a run, or a compaction, has written before it died is never read."""
    store = DeltaStore(spark, scratch(spark, "deltas"))
    step(spark, store, postings(1, n=30), 0)
    before, keys = rows_of(store.read()), key_set(store.read())
    kept = cross_source_dedupe(spark.createDataFrame(postings(2, n=30), POSTING))
    store.write(written(rc.changes(kept, store.read(), ts(1), store.last_ts()), "changes"), 1, ts(1))
    store._append("state", 1, store.rows(store.version()).withColumns({"run_id": F.lit(0).cast("long"), "attempt": F.lit("dead")}))
    assert rows_of(store.read()) == before and {bytes(r.key) for r in store.active_keys().collect()} == keys
    step(spark, store, postings(2, n=30), 1)
    store.compact()
    state = whole(spark, whole(spark, spark.createDataFrame([], JOB_STATE), postings(1, n=30), 0), postings(2, n=30), 1)
    assert rows_of(store.read()) == rows_of(state)


def test_another_session_reads_the_same(spark):
    root = scratch(spark, "deltas")
    store = DeltaStore(spark, root, buckets=3)
    step(spark, store, postings(1, n=30), 0)
    other = spark.newSession()
    spark.sql(f"DROP TABLE {DeltaStore.name('state', root + '/state/generation=0')}")
    again = DeltaStore(other, root, buckets=7)
    assert rows_of(again.read()) == rows_of(store.read()) and again.layout(f"{root}/state/generation=0") == 3


def test_stream_of_runs(spark):
    landing, root = scratch(spark, "landing"), scratch(spark, "root")
    store, state = DeltaStore(spark, root, compact_after=2), spark.createDataFrame([], JOB_STATE)
    rnd = random.Random(5)
    for run_id in range(4):
        batch = postings(rnd.randrange(99), n=50, ids=40)
        spark.createDataFrame(batch, POSTING).write.parquet(f"{landing}/runs/run_id={run_id}")
        announce(spark, landing, run_id, ts(run_id))
        state = whole(spark, state, batch, run_id)
        if run_id % 2:
            sync_stream(spark, landing, root, f"{root}/cp", PLAIN, store=store).awaitTermination()
    assert rows_of(store.read()) == rows_of(state)
    assert not process_run(spark, landing, store, 3, ts(3), PLAIN)
    told = spark.read.parquet(f"{root}/fresh")
    assert told.count() == told.select("job_id").distinct().count()
    counted = spark.read.parquet(f"{root}/counters/run_id=3").first()
    assert counted.new_jobs >= 0 and counted.updated + counted.new_jobs + counted.cross_dropped == counted.total
    store.prune(1)
    assert rows_of(store.read()) == rows_of(state)
