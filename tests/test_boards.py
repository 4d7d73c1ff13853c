"""Board links, candidates, registry growth, coverage."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from jobloom.operators import boards as bo
from jobloom.operators import coverage as co
from jobloom.plans import discovery as di
from jobloom.schemas import BOARD, CANDIDATE, PROBE

LINKS = [
    ("https://Nvidia.WD5.myworkdayjobs.com/en-US/NVIDIAExternalCareerSite/job/1", [("workday", "nvidia/wd5/NVIDIAExternalCareerSite")]),
    ("https://a.wd1.myworkdayjobs.com/en-US", [("workday", "a/wd1/en-US")]),
    ("https://a.wd1.myworkdayjobs.com/wday/cxs/a/S/jobs", []),
    ("a.wd1.myworkdayjobs.com/NoScheme", []),
    ("https://job-boards.greenhouse.io/Tok/jobs/1", [("greenhouse", "tok"), ("greenhouse", "tok")]),
    ("https://job-boards.eu.greenhouse.io/tok", [("greenhouse", "tok")]),
    ("https://boards-api.greenhouse.io/v1/boards/Acme/jobs", [("greenhouse", "acme")]),
    ("https://boards-api.greenhouse.io/v1/boards", []),
    ("https://boards.greenhouse.io/embed/job_board?x=1&for=Emb", [("greenhouse", "emb")]),
    ("jobs.lever.co/A-b_c/x jobs.lever.co/d", [("lever", "a-b_c"), ("lever", "d")]),
    ("https://jobs.ashbyhq.com/Open%20AI...", [("ashby", "open%20ai")]),
    ("https://jobs.ashbyhq.com/api/x", []),
    ("careers.smartrecruiters.com/oneclick-ui/company/Acme/x jobs.smartrecruiters.com/SiteMap", [("smartrecruiters", "acme")]),
    ("https://apply.workable.com/J/ABC https://apply.workable.com/Net-Guru/", [("workable", "net-guru")]),
    ("", []),
    (None, []),
]


def test_links(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINKS)], "i int, body string")
    rows = bo.extract_boards(df).orderBy("i", "pos").collect()
    for i, (text, want) in enumerate(LINKS):
        assert [(r.ats, r.board_key) for r in rows if r.i == i] == want, text


def test_names_and_case(spark):
    df = spark.createDataFrame([(1, "jobs.ashbyhq.com/Caf%C3%A9.. jobs.smartrecruiters.com/AcmeX jobs.lever.co/AB")], "i int, body string")
    rows = {r.ats: r for r in bo.extract_boards(df).collect()}
    assert (rows["ashby"].slug, rows["ashby"].name) == ("Caf%C3%A9", "Café")
    assert (rows["smartrecruiters"].slug, rows["smartrecruiters"].board_key) == ("AcmeX", "acmex")
    assert rows["lever"].name == "ab"


def test_crawl_row_serves_only_its_own_system(spark):
    both = "https://jobs.lever.co/a https://apply.workable.com/b"
    df = spark.createDataFrame([(1, "jobs.lever.co/*", both), (2, "apply.workable.com/*", both), (3, "other", both)],
                               "n bigint, pattern string, url string")
    got = di.crawl_candidates(df, "n").orderBy("seq").collect()
    assert [(int(r.seq) // 10**12, r.ats) for r in got] == [(1, "lever"), (2, "workable")]


ALIVE = [
    ("workday", '{"jobPostings":[{}]}', True), ("workday", '{"jobPostings":[]}', False),
    ("greenhouse", '{"jobs":[1]}', True), ("greenhouse", "{}", False), ("lever", "[1]", True),
    ("lever", "[]", False), ("lever", '{"ok":false}', False), ("ashby", '{"jobs":[{}]}', True),
    ("ashby", "null", False), ("smartrecruiters", '{"totalFound":3}', True),
    ("smartrecruiters", '{"totalFound":0}', False), ("workable", '{"total":1}', True),
    ("workable", "{}", False), ("workable", "oops", False), ("other", '{"total":1}', False),
]


def test_alive(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(ALIVE)], "i int, a string, b string")
    rows = df.select("i", bo.alive(F.col("a"), F.col("b")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in rows] == [w for _, _, w in ALIVE]


def cand(ats, key, seq, name=None, slug=None):
    return (ats, key, None, None, None, slug or key, name or key, "seeds", Decimal(seq))


def test_discover(spark):
    found = spark.createDataFrame([
        cand("ashby", "x", 7, slug="X"), cand("ashby", "x", 3, slug="x1"), cand("ashby", "y", 4),
        cand("lever", "x", 5), cand("lever", "dead", 6), cand("lever", "old", 8),
    ], CANDIDATE)
    reg = spark.createDataFrame([("lever", "old", None, None, None, "old", "Old", 0), ("lever", "older", None, None, None, "older", "O", 1)], BOARD)
    probes = spark.createDataFrame([
        ("ashby", "x", 200, '{"jobs":[1]}'), ("ashby", "y", 500, '{"jobs":[1]}'), ("lever", "x", 200, "[1]"),
        ("lever", "dead", 200, "[]"), ("lever", "old", 200, "[1]"),
    ], PROBE)
    out = di.discover(found, reg, probes)
    assert {(r.ats, r.board_key): r.slug for r in out.distinct.collect()}[("ashby", "x")] == "x1"
    rows = out.registry.orderBy("ats", "ord").collect()
    assert [(r.ats, r.board_key) for r in rows] == [("ashby", "x"), ("lever", "old"), ("lever", "older"), ("lever", "x")]
    assert {r.ats: r.added for r in bo.added_counts(out.survivors).collect()} == {
        "workday": 0, "greenhouse": 0, "lever": 1, "ashby": 1, "smartrecruiters": 0, "workable": 0}
    assert [r.ord for r in rows] == [0, 0, 1, 2]  # numbered on without gaps, whatever their seq
    again = di.discover(found, out.registry, probes)
    assert again.survivors.count() == 0


def test_coverage(spark):
    found = spark.createDataFrame([cand("lever", f"k{i:02}", i) for i in range(40)] + [cand("lever", "k00", 99)], CANDIDATE)
    reg = spark.createDataFrame([("lever", f"k{i:02}", None, None, None, "s", "n", i) for i in range(10)]
                                + [("ashby", "z", None, None, None, "z", "z", 0)], BOARD)
    rows = {r.ats: r for r in co.report(found, reg, 15).collect()}
    assert co.missing_boards(co.funnel_keys(found, reg)).count() == 30
    lever = rows["lever"]
    assert (lever.entries, lever.surfaced, lever.validated, lever.missing, lever.pct) == (10, 40, 10, 30, 25.0)
    assert lever.missing_boards.split("; ") == [f"k{i:02}" for i in range(10, 25)]
    assert (rows["ashby"].surfaced, rows["ashby"].pct, rows["workday"].entries) == (0, 0.0, 0)


def test_workday_keys_print_as_tuples(spark):
    rows = [("workday", "ab/wd1/S", "ab", "wd1", "S", None, "ab", "seeds", Decimal(1)), ("workday", "a/wd1/S", "a", "wd1", "S", None, "a", "seeds", Decimal(2))]
    marked = co.funnel_keys(spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame([], BOARD))
    got = [r.board for r in co.missing_sample(marked, 15).orderBy("place").collect()]
    assert got == ["('a', 'wd1', 'S')", "('ab', 'wd1', 'S')"]


@pytest.mark.parametrize("name", list(bo.ATS))
def test_every_system_has_crawl_patterns(name):
    assert bo.ATS[name].crawl_patterns


def test_percentages_round_half_to_even(spark):
    found = spark.createDataFrame([cand("lever", f"k{i:02}", i) for i in range(16)], CANDIDATE)
    reg = spark.createDataFrame([("lever", "k00", None, None, None, "s", "n", 0)], BOARD)
    assert {r.ats: r.pct for r in co.funnel(co.funnel_keys(found, reg)).collect()}["lever"] == 6.2


def test_discovery_looks_for_first_candidates_once(spark):
    """What it returns reads stored tables; the aggregate ran again for each output before."""
    found = spark.createDataFrame([cand("lever", f"co{i % 7}", i) for i in range(30)], CANDIDATE)
    registry = spark.createDataFrame([], BOARD)
    probes = spark.createDataFrame([("lever", f"co{i}", 200, '[{"id":1}]') for i in range(5)], PROBE)
    out = di.discover(found, registry, probes)
    for df in (out.distinct, out.survivors):
        assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.board_key, int(r.seq)) for r in out.survivors.collect()) == [(f"co{i}", i) for i in range(5)]
    assert out.distinct.count() == 7 and sorted(r.ord for r in out.registry.collect()) == list(range(5))
