"""What must not grow faster than the input: reads, shuffles, skew and memory."""

import os
import tracemalloc

from pyspark.sql import functions as F

from contract import fixtures
from jobloom import session
from jobloom.functions.text import strip
from jobloom.llm import secret_scan
from jobloom.operators import skew
from jobloom.session import written
from jobloom.sources import details as dt
from jobloom.sources import paging
from jobloom.sources import payloads as pl
from jobloom.sources.registry_files import FIELDS, RegistryFile, RegistryReader, RegistryWriter

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_trim_is_no_pattern(spark):
    df = spark.createDataFrame([("\x1c\u3000 a\u00a0b \x85",), ("ab",), (" ",), (None,), ("\u200ba",)], "x string")
    out = df.select(strip(F.col("x")).alias("y"))
    assert "regexp" not in plan(out)
    assert [r.y for r in out.collect()] == ["a\u00a0b", "ab", "", "", "\u200ba"]


def test_page_numbers_are_worked_out_once(spark):
    made = {}
    for name in ("wd_pages_fx", "sr_pages_fx", "wk_pages_fx"):
        assert "Window" not in plan(fixtures.view(spark, SF, name, made))


def test_tables_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DEALT_BYTES", 1 << 10)
    rows = fixtures.table(spark, SF, "lineitem")
    want = os.path.getsize(f"{SF}/lineitem.parquet") / 1024
    assert rows.rdd.getNumPartitions() >= want > spark.sparkContext.defaultParallelism


def paged(spark, boards, ats):
    """Two pages of each board and one of none; the first has all rows, so the second doesn't count."""
    body = {"workday": '{"total":1,"jobPostings":[{"title":"a"}]}', "smartrecruiters": '{"totalFound":1,"content":[{"id":"a"}]}',
            "workable": '{"total":1,"nextPage":"n","results":[{"shortcode":"a"}]}'}[ats]
    rows = spark.range(boards * 2 + 1).selectExpr(
        f"'{ats}' AS ats", f"IF(id < {boards * 2}, 'b' || (id div 2), NULL) AS board", "id % 2 AS page_no", "200 AS status", f"'{body}' AS body")
    return rows.withColumns({c: F.lit(0) for c in ("term_ord", "board_ord")} | {c: F.lit("x") for c in ("term", "name", "tenant", "wd", "site")})


def test_landed_pages_are_dealt_by_their_count(spark, monkeypatch):
    """Stored bytes are few where boards are alike: their bounds were broadcast, or few tasks sorted all pages with their items."""
    monkeypatch.setattr(paging, "PAGES_A_TASK", 500, raising=False)
    for ats in paging.GROUPS:
        pages = paged(spark, 2000, ats)
        out = pl.kept_pages(pl.landed(pages), ats)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 500
        physical = plan(out).split("== Physical Plan ==")[1]
        assert "Broadcast" not in physical
        assert not any("Sort [" in x and f"{ats}#" in x for x in physical.splitlines()) and "SortMergeJoin" not in physical
        own = pl.kept_pages(pages, ats)
        assert sorted(map(str, out.select(*sorted(out.columns)).collect())) == sorted(map(str, own.select(*sorted(own.columns)).collect()))
        assert f"{ats}#" not in plan(out.select("board", "page_no")).split("== Physical Plan ==")[1]


def test_landed_pages_of_one_task_are_left_to_spark(spark):
    out = pl.kept_pages(pl.landed(paged(spark, 20, "smartrecruiters")), "smartrecruiters")
    assert "REPARTITION_BY_NUM" not in plan(out) and sorted((r.board, r.page_no) for r in out.collect()) == sorted((f"b{i}", 0) for i in range(20))


def test_rows_without_a_key_are_spread(spark):
    fact = spark.range(4000).select(F.lit(None).cast("string").alias("k"), "id")
    unique = spark.createDataFrame([("a", 1)], "k string, v int")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        out = skew.join_unique(fact, unique, ["k"], "left", "id")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_jobs_are_read_once_for_their_details(spark):
    jobs = written(spark.createDataFrame([("j", "lever", "k"), ("i", "lever", None)], "job_id string, source string, detail_key string"), "jobs-to-look-up")
    old = spark.createDataFrame([("lever", "k", 200, "a", 1), ("lever", "k", 200, "b", 2), ("lever", "k", 200, "c", 9)],
                                "source string, detail_key string, status int, body string, landed long")
    counts = dt.key_counts(jobs)
    out = dt.with_newest(jobs, dt.versions(old, None, counts), "1970-01-01T00:00:00.000005+00:00", counts=counts)
    physical = out._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("jobs-to-look-up") == 1
    assert {r.job_id: r.body for r in out.collect()} == {"j": "b", "i": None}


def test_a_registry_file_takes_the_memory_of_one_entry(tmp_path):
    def rows(n):
        for i in range(n):
            yield dict.fromkeys(FIELDS, None) | {"ats": "lever", "board_key": f"b{i}", "slug": "x" * 500, "name": "- a: [\n- b", "ord": i}

    writer = RegistryWriter(str(tmp_path), True)
    RegistryWriter(str(tmp_path / "first"), True).write(rows(1))  # imports and caches
    tracemalloc.start()
    done = writer.write(rows(2000))
    peak = tracemalloc.get_traced_memory()[1]
    writer.commit([done])
    reader = RegistryReader(str(tmp_path))
    (part,) = reader.partitions()
    tracemalloc.reset_peak()
    base = tracemalloc.get_traced_memory()[0]
    count = sum(r == tuple(row[c] for c in FIELDS) for r, row in zip(reader.read(part), rows(2000), strict=True))
    read = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert count == done.rows == 2000 and peak < 1 << 20 and read < 1 << 20


def test_registry_files_kept_by_hand(tmp_path):
    def read(text):
        (tmp_path / "f.yaml").write_text(text)
        return [r[:2] for r in RegistryReader("").read(RegistryFile(str(tmp_path / "f.yaml")))]

    assert read("# x\nother: [1, {companies: [2]}]\ncompanies:\n  - {ats: lever, board_key: a}\n  - ats: ashby\n    board_key: b\nz: 1\n") == [("lever", "a"), ("ashby", "b")]
    assert read("") == read("companies:\n") == read("companies: []\n") == []


def test_only_texts_with_secrets_are_moved(spark):
    texts = ["password = hunter22 and", "nothing here", None, "", "password = short", "AKIA" + "A" * 16, "nothing here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = secret_scan.per_blob(secret_scan.scan(docs).findings)
    hashes = found.select(F.xxhash64("blob").alias("__has")).distinct()
    out = secret_scan.redacted(docs, found, hashes=F.broadcast(hashes))
    assert sorted(map(str, out.collect())) == sorted(map(str, secret_scan.redacted(docs, found).collect()))
    assert "Union" in plan(out) and out.where("doc_id = 0").first().text == "[SECRET] and"


def test_landed_pages_that_count_are_stored_by_system(spark, monkeypatch):
    """Readers no longer deal pages in one plan, where the shuffle files of all systems lie side by side."""
    monkeypatch.setattr(paging, "PAGES_A_TASK", 10)
    pages = [paged(spark, 30, ats) for ats in paging.GROUPS]
    both = pages[0].unionByName(pages[1]).unionByName(pages[2])
    names = []
    out = pl.unified_batch(pl.landed(both), keep=lambda df, name: names.append(name) or session.stored(df, name))
    assert names == [f"kept-{a}" for a in paging.GROUPS] and "REPARTITION_BY_NUM" not in plan(out)
    assert out.count() == 60 and sorted(map(str, out.collect())) == sorted(map(str, pl.unified_batch(both).collect()))


def shuffle_bytes(spark):
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(os.path.join(d, f)) for top in at for d, _, fs in os.walk(top) for f in fs if f.startswith("shuffle_"))


def test_shuffle_files_of_a_stored_table_go(spark):
    import time

    before = shuffle_bytes(spark)
    rows = spark.range(200_000).repartition(4, "id").select("id", F.sha1(F.col("id").cast("string")).alias("x"))
    back = session.stored(rows.groupBy("x").agg(F.min("id").alias("id")), "t")
    for _ in range(50):
        if shuffle_bytes(spark) < before + 100_000:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) < before + 100_000 and back.count() == 200_000
    assert spark.conf.get(session.FREE_SHUFFLES) == "false"
    with session.recorded() as paths:
        session.stored(rows, "u")
    assert len(paths) == 1 and all(f.endswith((".zstd.parquet", "_SUCCESS")) for f in os.listdir(paths[0].removeprefix("file:")) if not f.startswith("."))
