"""Streams over the given tables, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import fragments as s
from contract.fixtures import VIEWS as FIXTURES
from contract.registry import add
from jobloom.operators.reconcile import FLAGS
from jobloom.schemas import CANDIDATE_COLS, STATE_COLS
from jobloom.session import scratch
from jobloom.sources.deltas import DeltaStore
from jobloom.streaming.harvest import harvest_stream
from jobloom.streaming.sync import announce, sync_stream

col = F.col
RUNS = 3


def run_ts(run_id: int) -> str:
    return f"2026-01-0{run_id + 3}T00:00:00+00:00"


def synced(v) -> DeltaStore:
    """Land the postings as three runs, announce them, and stream them into a state of deltas."""
    landing, root = scratch(v.spark, "landing"), scratch(v.spark, "sync")
    runs = v.postings_fx.withColumn("run_id", col("seq") % RUNS)
    runs.write.partitionBy("run_id").parquet(f"{landing}/runs")
    for run_id in range(RUNS):
        announce(v.spark, landing, run_id, run_ts(run_id))
    store = DeltaStore(v.spark, root)
    sync_stream(v.spark, landing, root, f"{root}/checkpoint", store=store).awaitTermination()
    return store


def run_ctes() -> list[tuple[str, str]]:
    """``state_2``: the runs reconciled one after the other; ``fresh_0`` and so on."""
    state = ", ".join(f"'' AS {c}" for c in STATE_COLS)
    ctes = [("state_none", f"SELECT {state} WHERE false")]
    before = "state_none"
    for i in range(RUNS):
        ctes.append((f"run_{i}", f"SELECT * FROM postings_fx WHERE seq % {RUNS} = {i}"))
        names = {"keyed": f"keyed_{i}", "marked": f"marked_{i}", "kept": f"kept_{i}"}
        for name, sql in s.deduped(f"run_{i}"):
            for old, new in names.items():
                sql = sql.replace(f"FROM {old}", f"FROM {new}")
            ctes.append((names[name], sql))
        ctes += s.reconciled(f"kept_{i}", before, run_ts(i), name=f"rec_{i}")
        ctes.append(s.new_jobs(f"rec_{i}", f"new_{i}"))
        ctes.append(s.fresh(before, f"new_{i}", f"fresh_{i}"))
        ctes.append((f"flagged_{i}", f"""
SELECT job_id, {s.sponsorship('t')} AS sponsorship, {s.clearance('t')} AS clearance, {s.grad_years('t')} AS grad_year
FROM (SELECT job_id, {s.flag_text('description')} AS t FROM fresh_{i} WHERE {s.announceable('role_type')}) q"""))
        cols = ", ".join(
            f"coalesce(f.{c}, r.{c}) AS {c}" if c in FLAGS else f"r.{c}" for c in STATE_COLS
        )
        ctes.append((f"state_{i}", f"SELECT {cols} FROM rec_{i} r LEFT JOIN flagged_{i} f ON f.job_id = r.job_id"))
        before = f"state_{i}"
    return ctes


add(
    "st1_incremental_sync",
    lambda v: synced(v).read(),
    "postings_fx",
    f"SELECT {', '.join(STATE_COLS)} FROM state_{RUNS - 1}",
    run_ctes(),
)


def compacted(v) -> DeltaStore:
    """The same runs, their deltas merged into a new base."""
    store = synced(v)
    store.compact()
    return store


add(
    "u1_compacted_state",
    lambda v: compacted(v).read(),
    "postings_fx",
    f"SELECT {', '.join(STATE_COLS)} FROM state_{RUNS - 1}",
    run_ctes(),
)
add(
    "f2_indexed_keys",
    lambda v: synced(v).active_keys().select(F.lower(F.hex("key")).alias("key")),
    "postings_fx",
    f"SELECT DISTINCT md5({s.fuzzy_key()}) AS key FROM state_{RUNS - 1} "
    f"WHERE status = 'active' AND {s.fuzzy_key()} IS NOT NULL",
    run_ctes(),
)
add(
    "st3_announced_once",
    lambda v: v.spark.read.parquet(f"{synced(v).root}/fresh").select(
        col("run_id").cast("bigint"), "job_id", "title", "role_type", "first_seen"
    ),
    "postings_fx",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS run_id, job_id, title, role_type, first_seen FROM fresh_{i}"
        for i in range(RUNS)
    ),
    run_ctes(),
)


def harvested(v):
    """The web texts of the pages table as a stream."""
    pages = v.pages
    stream = v.spark.readStream.schema(pages.schema).parquet(f"{v.sf_dir}/pages*.parquet")
    stream.createOrReplaceTempView("pages")
    texts = v.spark.sql(FIXTURES["crawl_text_fx"][1])
    out = scratch(v.spark, "harvest")
    harvest_stream(texts, "texts", "page_id", out, f"{out}-checkpoint").awaitTermination()
    return v.spark.read.parquet(out).select(*CANDIDATE_COLS)


add(
    "st2_harvest_stream",
    harvested,
    "crawl_text_fx",
    "SELECT ats, board_key, tenant, wd, site, slug, name, 'texts' AS origin, (page_id::HUGEINT * 1000000000000::HUGEINT + pos)::DECIMAL(38,0) AS seq FROM links",
    s.links("crawl_text_fx", "page_id"),
)
