"""Detail versions, the label store, the crawl ledger and registry files."""

import os

import pytest
from pyspark.sql import functions as F

from jobloom.operators import enrich as en
from jobloom.operators.scoring import ambiguous_titles
from jobloom.schemas import BOARD, CANDIDATE
from jobloom.session import scratch
from jobloom.sources import details as dt
from jobloom.sources import harvest
from jobloom.sources import payloads as pl
from jobloom.sources.labels import LabelStore
from jobloom.sources.registry_files import RegistryWriter, current, register

from tests.test_plans import plan

JOB = "seq int, job_id string, source string, apply_url string, description string"
VERSION = "source string, detail_key string, status int, body string, landed string"


def jobs(spark):
    return spark.createDataFrame([
        (1, "g1", "greenhouse", "https://boards.greenhouse.io/acme/jobs/1", ""), (2, "g2", "greenhouse", "https://boards.greenhouse.io/acme/jobs/2", ""),
        (3, "ash_q", "ashby", "https://jobs.ashbyhq.com/acme/q", ""), (4, "ash_r", "ashby", "https://jobs.ashbyhq.com/acme/r", ""),
        (5, "x", "indeed", "https://x/y", "kept")], JOB)


def body(text):
    return '{"content":"%s"}' % text


def at(day):
    return f"2026-01-{day:02}T00:00:00+00:00"


def test_newest_version_as_of_a_time(spark):
    details = spark.createDataFrame([
        ("greenhouse", "acme/jobs/1", 200, body("old"), at(1)), ("greenhouse", "acme/jobs/1", 200, body("new"), at(3)),
        ("greenhouse", "acme/jobs/1", 200, body("later"), at(9)), ("greenhouse", "acme/jobs/2", 200, body("good"), at(1)),
        ("greenhouse", "acme/jobs/2", 500, body("failed"), at(3)), ("greenhouse", "acme/jobs/7", 200, body("other"), at(1))], VERSION)
    boards = spark.createDataFrame([
        ("acme", 200, '{"jobs":[{"id":"q","descriptionPlain":"first"},{"id":"r","descriptionPlain":"","descriptionHtml":"<p>h</p>"}]}', at(1)),
        ("acme", 200, '{"jobs":[{"id":"q","descriptionPlain":"second"},{"id":"z"}]}', at(2)),
        ("none", 200, "not json", at(2))], "slug string, status int, body string, landed string")

    def texts(**kw):
        return {r.seq: r.full_description for r in en.enrich(jobs(spark), **kw).collect()}

    assert texts(details=details, boards=boards, as_of=at(5)) == {1: "new", 2: "good", 3: "second", 4: " h ", 5: "kept"}
    assert texts(details=details, boards=boards, as_of=at(1)) == {1: "old", 2: "good", 3: "first", 4: " h ", 5: "kept"}
    assert texts(boards=boards)[1] == "" and texts(details=details, as_of=at(20))[1] == "later"
    keyed = en.with_detail_key(jobs(spark))
    found = dt.versions(details, boards, keyed)
    assert "acme/jobs/7" not in {r.detail_key for r in found.collect()}
    p = plan(dt.with_newest(keyed, found, at(5)))
    assert "SortAggregate" not in p and "to_json" not in p


def test_ties_go_to_the_version_stored_last(spark):
    details = spark.createDataFrame([("greenhouse", "acme/jobs/1", 200, body(t), at(1)) for t in "abc"], VERSION).coalesce(1)
    got = en.enrich(jobs(spark), details, as_of=at(1)).where("seq = 1").first()
    assert got.full_description == "c"


def test_only_unseen_titles_are_scored(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory():
        def model(titles, texts):
            (calls / os.urandom(8).hex()).write_text("\n".join(titles))
            if "Broken" in titles:
                raise ValueError("no answer")
            return ["?" if t == "Odd" else list(texts)[0] for t in titles]

        return model

    def asked():
        out = sorted(t for f in calls.iterdir() for t in f.read_text().split("\n"))
        for f in calls.iterdir():
            f.unlink()
        return out

    def run(titles, name, version="v1"):
        df = spark.createDataFrame([(t,) for t in titles], "title string").repartition(len(titles))
        return {r.title: r.label for r in LabelStore(spark, root, version).labelled(ambiguous_titles(df), factory, name).collect()}

    root = scratch(spark, "labels")
    first = run(["Painter", "Baker", "Baker", "Odd"], "run 1")
    assert asked() == ["Baker", "Odd", "Painter"] and first["Odd"] is None and first["Baker"]
    second = run(["Painter", "Baker", "Miller"], "run 2")
    assert asked() == ["Miller"] and second["Painter"] == first["Painter"] and second["Miller"]
    assert run(["Odd"], "run 3") == {"Odd": None} and asked() == ["Odd"]
    run(["Baker"], "run 4", "v2")
    assert asked() == ["Baker"]
    assert {r.run for r in LabelStore(spark, root, "v1").read().collect()} == {"run 1", "run 2"}


def test_ledger_counts_named_attempts_only(spark):
    path = scratch(spark, "ledger")
    pairs = spark.createDataFrame([("i", "p"), ("i", "q")], "index_name string, pattern string")
    found = spark.createDataFrame([("lever", "a", None, None, None, "a", None, "index", None)], CANDIDATE)
    assert harvest.done_pairs(spark, path).count() == 0 and harvest.ledger_candidates(spark, path).count() == 0
    found.write.parquet(f"{path}/found/attempt=dead")
    assert harvest.ledger_candidates(spark, path).count() == 0
    pairs.write.parquet(f"{path}/done/attempt=dead")
    assert harvest.pending_pairs(pairs, harvest.done_pairs(spark, path)).count() == 2
    harvest.append_ledger(path, pairs, found)
    assert harvest.ledger_candidates(spark, path).count() == 1
    assert harvest.pending_pairs(pairs, harvest.done_pairs(spark, path)).count() == 0


def boards(spark, n, ats="lever"):
    return spark.createDataFrame([(ats, f"b{i}", None, None, None, f"b{i}", "Näme" if i else None, i) for i in range(n)], BOARD)


def test_registry_files_are_swapped_whole(spark):
    pytest.importorskip("yaml")
    register(spark)
    path = scratch(spark, "registry")

    def read():
        return sorted(map(tuple, spark.read.format("board_registry").load(path).collect()), key=str)

    def write(df):
        df.write.format("board_registry").mode("overwrite").save(path)

    assert read() == []
    write(boards(spark, 5).repartition(3))
    assert read() == sorted(map(tuple, boards(spark, 5).collect()), key=str)
    write(boards(spark, 2, "ashby"))
    assert [r[0] for r in read()] == ["ashby", "ashby"]
    before = read()
    fails = boards(spark, 9).withColumn("name", F.when(F.col("ord") == 7, F.raise_error(F.lit("died"))).otherwise(F.col("name")))
    with pytest.raises(Exception):
        write(fails.repartition(3))
    assert read() == before
    write(boards(spark, 0))
    assert read() == []


def test_registry_version_is_named_by_its_commit(tmp_path):
    pytest.importorskip("yaml")
    writer = RegistryWriter(str(tmp_path), True)
    row = dict.fromkeys(("ats", "board_key", "tenant", "wd", "site", "slug", "name", "ord"))
    kept, again = writer.write(iter([row | {"ats": "lever"}])), writer.write(iter([row | {"ats": "lever"}]))
    assert current(str(tmp_path)) is None
    writer.commit([kept])
    folder = current(str(tmp_path))
    assert [n for n in os.listdir(folder) if not n.startswith(".")] == [kept.file] != [again.file]
    other = RegistryWriter(str(tmp_path), True)
    other.write(iter([row]))
    other.abort([])
    assert current(str(tmp_path)) == folder
    with pytest.raises(ValueError, match="written whole"):
        RegistryWriter(str(tmp_path), False)


def test_landed_pages_are_parsed_once(spark):
    """A reader of a paged system takes landed columns; bodies are parsed as they are landed, once a page."""
    rows = [("smartrecruiters", "b", n, 200, '{"totalFound":9,"content":[{"id":"%d"}]}' % n) for n in range(3)] + [("smartrecruiters", "b", 3, 500, "")]
    pages = spark.createDataFrame(rows, "ats string, board string, page_no long, status int, body string").withColumns(
        {c: F.lit(0) for c in ("term_ord", "board_ord")} | {c: F.lit("x") for c in ("term", "name", "tenant", "wd", "site")})
    parsed = []
    landed = pl.landed(pages, lambda df, name: parsed.append(plan(df)) or dt.written(df, name))
    assert parsed[0].count("from_json(StructField(totalFound") <= 1
    out = pl.read_smartrecruiters(landed)
    assert "from_json" not in plan(out) and sorted(r.job_id for r in out.collect()) == ["sr_0", "sr_1", "sr_2"]
    assert sorted(map(str, out.collect())) == sorted(map(str, pl.read_smartrecruiters(pages).collect()))
