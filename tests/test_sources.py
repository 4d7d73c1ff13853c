"""Payload readers, page rules, aggregator listings, harvest text, registry."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from jobloom.settings import Settings
from jobloom.sources import aggregator, harvest, payloads, registry

PAGE = (
    "ats string, board string, name string, tenant string, wd string, site string, "
    "term string, term_ord int, board_ord bigint, page_no bigint, status int, body string"
)


def page(ats, body, board="acme", name=None, term="", term_ord=0, board_ord=0, page_no=0, status=200):
    body = body if isinstance(body, str) else json.dumps(body)
    return (ats, board, name, "acme", "wd5", "Site", term, term_ord, board_ord, page_no, status, body)


def read(spark, ats, *pages, **settings):
    df = spark.createDataFrame(list(pages), PAGE)
    return payloads.READERS[ats](df, Settings(**settings)).orderBy("seq").collect()


def test_workday_ids(spark):
    items = [
        {"bulletFields": [" JR1 ", "x"], "title": " A ", "externalPath": "/job/a_R1", "postedOn": "Posted Today"},
        {"bulletFields": [""], "externalPath": "/job/b_x_R2 "},
        {"bulletFields": [None], "externalPath": "/job/c_R3"},
        {"bulletFields": ["   "], "externalPath": "/job/d_R4"},
        {"externalPath": "/job/none"},
        {"externalPath": "/job/e_"},
        {"bulletFields": ["JR1"], "title": "twin"},
    ]
    rows = read(spark, "workday", page("workday", {"total": 9, "jobPostings": items}))
    assert [r.job_id for r in rows] == ["JR1", "R2", "R3"]
    first = rows[0]
    assert first.title == "A" and first.posted_on == "Posted Today" and first.source == "workday"
    assert first.apply_url == "https://acme.wd5.myworkdayjobs.com/Site/job/a_R1"
    assert first.company == "acme" and first.location == ""


def test_workday_first_term_wins_per_board(spark):
    def one(term_ord, title, board="acme", board_ord=0):
        body = {"total": 1, "jobPostings": [{"bulletFields": ["J"], "title": title}]}
        return page("workday", body, board=board, board_ord=board_ord, term=f"t{term_ord}", term_ord=term_ord)

    rows = read(spark, "workday", one(1, "second"), one(0, "first"), one(0, "other", "b2", 1))
    assert [r.title for r in rows] == ["first", "other"]


def test_greenhouse(spark):
    jobs = [
        {"id": 5, "title": None, "absolute_url": "u", "updated_at": "2026-01-02T03:04:05Z", "location": {"name": " NYC "}},
        {"id": 0}, {"id": None}, {"title": "no id"}, {"id": 6, "location": None},
    ]
    rows = read(spark, "greenhouse", page("greenhouse", {"jobs": jobs}, name="Acme"))
    assert [(r.job_id, r.company, r.title, r.location, r.posted_on) for r in rows] == [
        ("gh_5", "Acme", "", "NYC", "2026-01-02"), ("gh_6", "Acme", "", "", ""),
    ]
    assert not read(spark, "greenhouse", page("greenhouse", {"jobs": jobs}, status=404))
    assert not read(spark, "greenhouse", page("greenhouse", "<html>"))
    assert not read(spark, "greenhouse", page("greenhouse", {"other": 1}))


def test_lever(spark):
    items = [
        {"id": "a", "text": "T", "createdAt": 1700000000000, "categories": {"location": "X", "allLocations": ["P", "Q"]}},
        {"id": "b", "createdAt": 0, "categories": {"location": " X ", "allLocations": []}},
        {"id": " ", "text": "drop"}, {"id": "c", "createdAt": None, "categories": None},
    ]
    rows = read(spark, "lever", page("lever", items))
    assert [(r.job_id, r.location, r.posted_on) for r in rows] == [
        ("lv_a", "P", "2023-11-14"), ("lv_b", "X", ""), ("lv_c", "", ""),
    ]
    assert not read(spark, "lever", page("lever", {"ok": False}))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_dates_do_not_follow_the_session_zone(spark, zone):
    items = [{"id": str(i), "createdAt": ms} for i, ms in enumerate(
        [1700000000000, 1699920000000, 1700006399999, -1, 10**17, 1])]
    rows = [(i, "indeed", "a", None, f"u{i}", None, None, None, None, None, d, None)
            for i, d in enumerate(["2025-12-31", "2025-12-30"])]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r.posted_on for r in read(spark, "lever", page("lever", items))]
        kept = aggregator.source_filters(spark.createDataFrame(rows, LISTING), "2026-01-03T00:00:00+00:00")
        seqs = [r.seq for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2023-11-14", "2023-11-14", "2023-11-14", "1969-12-31", "", "1970-01-01"]
    assert seqs == [0]


def test_ashby(spark):
    jobs = [{"id": "q", "title": " A ", "publishedAt": "2026-05-06T00:00:00Z"},
            {"id": "r", "jobUrl": "https://x", "location": None}, {"id": ""}]
    rows = read(spark, "ashby", page("ashby", {"jobs": jobs}, board="Acme Co"))
    assert [(r.job_id, r.apply_url, r.posted_on) for r in rows] == [
        ("ash_q", "https://jobs.ashbyhq.com/Acme Co/q", "2026-05-06"), ("ash_r", "https://x", ""),
    ]


def test_smartrecruiters_and_workable_locations(spark):
    content = [{"id": "1", "location": {"city": "Berlin", "region": None, "country": "de"}},
               {"id": "2", "location": None}, {"id": "3", "location": {"city": "", "country": "us"}}]
    rows = read(spark, "smartrecruiters", page("smartrecruiters", {"totalFound": 3, "content": content}, board="Acme"))
    assert [r.location for r in rows] == ["Berlin, DE", "", "US"]
    assert rows[0].apply_url == "https://jobs.smartrecruiters.com/Acme/1"
    results = [{"shortcode": "A", "location": {"display": " X, Y ", "city": "no"}},
               {"shortcode": "B", "location": {"city": "Rome", "region": "", "country": "Italy"}}, {"shortcode": None}]
    rows = read(spark, "workable", page("workable", {"total": 2, "results": results}))
    assert [(r.job_id, r.location) for r in rows] == [("wk_A", "X, Y"), ("wk_B", "Rome, Italy")]
    assert rows[0].apply_url == "https://apply.workable.com/acme/j/A/"


def random_pages(ats, seed):
    rnd = random.Random(seed)
    pages = []
    for board in range(25):
        for no in range(rnd.randrange(1, 7)):
            size = rnd.choice([0, 1, 2, 2, 3])
            body = {}
            if rnd.random() < 0.8:
                body["total" if ats != "smartrecruiters" else "totalFound"] = rnd.choice([1, 3, 6, 40, 100])
            if ats == "workday":
                body["jobPostings"] = [{"bulletFields": [f"{no}-{i}"]} for i in range(size)]
            elif ats == "smartrecruiters":
                body["content"] = [{"id": rnd.choice(["x", None])} for _ in range(size)]
            else:
                body["results"] = [{"shortcode": rnd.choice(["x", "", None])} for _ in range(size)]
                if rnd.random() < 0.8:
                    body["nextPage"] = rnd.choice(["tok", "tok", "tok", None, ""])
            status = rnd.choice([200] * 9 + [500])
            pages.append(page(ats, rnd.choice([body] * 9 + ["{oops"]), board=f"b{board}", page_no=no, status=status))
    return pages


def loop_pages(ats, pages, cap):
    """Fetch page after page and stop as a client would."""
    kept, boards = set(), {}
    for p in pages:
        boards.setdefault(p[1], {})[p[9]] = p
    for board, by_no in boards.items():
        so_far = 0
        for no in range(cap):
            if no not in by_no:
                break
            p = by_no[no]
            try:
                body = json.loads(p[11])
            except ValueError:
                body = None
            if p[10] != 200 or body is None:
                break
            if ats == "workday":
                if not body["jobPostings"]:
                    break
                kept.add((board, no))
                if (no + 1) * 20 >= body.get("total", 0):
                    break
            elif ats == "smartrecruiters":
                if body["content"]:
                    kept.add((board, no))
                so_far += len(body["content"])
                if not body["content"] or so_far >= body.get("totalFound", 0):
                    break
            else:
                if body["results"]:
                    kept.add((board, no))
                so_far += len([r for r in body["results"] if r["shortcode"]])
                if not body["results"] or not body.get("nextPage") or so_far >= body.get("total", 0):
                    break
    return kept


@pytest.mark.parametrize("ats", ["workday", "smartrecruiters", "workable"])
@pytest.mark.parametrize("seed", [1, 2])
def test_page_rules_equal_a_client(spark, ats, seed):
    pages = random_pages(ats, seed)
    df = spark.createDataFrame(pages, PAGE).repartition(3)
    # Pages without items give no rows, whether they are let through or not.
    rows = payloads.scan(df, ats, Settings(max_pages_per_term=4))
    got = {(r.board, r.page_no) for r in rows.collect()}
    cap = {"workday": 4, "smartrecruiters": 10**6, "workable": 10**6}[ats]
    assert got == loop_pages(ats, pages, cap)


def test_batch_order_and_union(spark):
    pages = spark.createDataFrame([
        page("lever", [{"id": "l"}]), page("greenhouse", {"jobs": [{"id": 2}, {"id": 1}]}, board_ord=1),
        page("greenhouse", {"jobs": [{"id": 9}]}, board="g0"), page("workday", {"total": 1, "jobPostings": [{"bulletFields": ["w"]}]}),
    ], PAGE)
    rows = [(5, "indeed", "t", "indeed", "https://e/1", None, None, None, None, None, None, None)]
    listings = spark.createDataFrame(rows, LISTING)
    batch = payloads.unified_batch(pages, aggregator.read_listings(listings))
    ids = [r.job_id for r in batch.orderBy("seq").collect()]
    assert ids[:5] == ["w", "gh_9", "gh_2", "gh_1", "lv_l"] and ids[5].startswith("indeed_")
    counts = {r.ats: r.postings for r in payloads.ats_counts(payloads.read_boards(pages)).collect()}
    assert counts == {"workday": 1, "greenhouse": 3, "lever": 1, "ashby": 0, "smartrecruiters": 0, "workable": 0}


LISTING = (
    "seq bigint, scanned_site string, term string, site string, job_url string, job_url_direct string, "
    "apply_url string, company string, title string, location string, date_posted string, description string"
)


def test_listings(spark):
    rows = [
        (1, "indeed", "a", "NaN", " https://e/1 ", None, "x", "nan", "T", None, "NaT", "None"),
        (2, "indeed", "b", "indeed", "https://e/1", None, "x", "later", "T", None, "", ""),
        (3, "indeed", "a", None, "nan", None, "https://e/2", "C", "T", "L", "2026-01-01", "D"),
        (4, "indeed", "a", None, None, None, "none", "C", "T", "L", "", ""),
        (5, "glassdoor", "a", None, "https://e/1", None, None, "C", "T", "L", "", ""),
    ]
    got = aggregator.read_listings(spark.createDataFrame(rows, LISTING)).orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 3, 5]
    assert got[0].company == "" and got[0].posted_on == "" and got[0].apply_url == "https://e/1"
    assert got[1].apply_url == "https://e/2" and got[2].source == "glassdoor"
    urls = aggregator.listing_urls(spark.createDataFrame(rows, LISTING))
    assert urls.count() == 8


def test_source_filters(spark):
    rows = [(i, "indeed", "a", None, f"u{i}", None, None, None, None, None, d, None)
            for i, d in enumerate(["2026-01-01", "2025-12-01", None, "bad", "2026-01-02", "2026-01-03"])]
    df = spark.createDataFrame(rows, LISTING)
    got = aggregator.source_filters(df, "2026-01-03T00:00:00+00:00", 72, 3)
    assert sorted(r.seq for r in got.collect()) == [0, 2, 3]
    assert sorted(r.seq for r in aggregator.source_filters(df, "2026-01-03T00:00:00+00:00").collect()) == [0, 2, 3, 4, 5]
    late = aggregator.source_filters(df, "2026-01-05T01:00:00+02:00", 72)  # 23:00 of the 4th in UTC
    assert sorted(r.seq for r in late.collect()) == [2, 3, 4, 5]
    assert aggregator.source_filters(df, "2026-01-03", sites=["glassdoor"]).count() == 0
    assert aggregator.source_filters(df, "2026-01-03", terms=["a"], sites=["indeed"]).count() == 5


def test_index_urls(spark):
    lines = ['{"url": "https://a"}', "", "   ", "{bad", '{"status": 1}', '{"url": null}']
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert sorted(r.url for r in harvest.index_urls(df).collect()) == ["", "", "https://a"]


def test_seeds_and_whole_texts(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_text("# note\n\nhttps://jobs.lever.co/a\n  # more\n x # kept\n")
    assert [r.value for r in harvest.read_seeds(spark, str(path)).collect()] == ["", "https://jobs.lever.co/a", " x # kept"]
    whole = harvest.read_texts(spark, str(path)).collect()
    assert len(whole) == 1 and "more" in whole[0].body


def test_crawl_plan(spark):
    idx = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "list_ord bigint, index_name string")
    assert [r.index_name for r in harvest.newest_indexes(idx, 2).orderBy("list_ord").collect()] == ["a", "b"]
    assert harvest.newest_indexes(idx).count() == 3 and harvest.newest_indexes(idx.limit(0)).count() == 0
    counts = spark.createDataFrame([("a", "p", 0), ("a", "q", 2), ("b", "p", 9), ("b", "q", None)],
                                   "index_name string, pattern string, num_pages bigint")
    plan = harvest.pages_to_fetch(counts, 3).groupBy("index_name", "pattern").agg(F.max("page").alias("m"))
    assert {(r[0], r[1]): r.m for r in plan.collect()} == {("a", "q"): 1, ("b", "p"): 2}
    assert harvest.pages_to_fetch(counts).count() == 11
    assert harvest.answered(counts).count() == 3


def test_ledger(spark, tmp_path):
    from jobloom.schemas import CANDIDATE

    pairs = spark.createDataFrame([("i", "p"), ("i", "q")], "index_name string, pattern string")
    found = spark.createDataFrame([("lever", "a", None, None, None, "a", "a", "index", Decimal(1))], CANDIDATE)
    path = str(tmp_path / "ledger")
    harvest.append_ledger(path, pairs.where("pattern = 'p'"), found)
    left = harvest.pending_pairs(pairs, harvest.done_pairs(spark, path))
    assert [tuple(r) for r in left.collect()] == [("i", "q")]
    assert harvest.ledger_candidates(spark, path).count() == 1


def test_registry_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "w.yaml").write_text("companies:\n- {tenant: t, wd: wd1, site: S, name: N}\n")
    (tmp_path / "a.yaml").write_text("companies:\n- slug: OpenX\n- slug: b\n  name: B\n")
    (tmp_path / "l.yaml").write_text("")
    files = {"workday": "w", "ashby": "a", "lever": "l", "greenhouse": "none"}
    boards = registry.read_yaml(spark, {k: str(tmp_path / f"{f}.yaml") for k, f in files.items()})
    rows = {(r.ats, r.board_key): (r.name, r.ord) for r in boards.collect()}
    assert rows == {("workday", "t/wd1/S"): ("N", 0), ("ashby", "openx"): (None, 0), ("ashby", "b"): ("B", 1)}
    assert registry.of_systems(boards, ["Ashby"]).count() == 2
    assert registry.of_systems(boards, []).count() == 3
    with pytest.raises(ValueError, match="nope"):
        registry.of_systems(boards, ["ashby", "nope"])
    shown = boards.select(payloads.display_name(F.col("name"), F.col("tenant"), F.col("slug")).alias("d"))
    assert sorted(r.d for r in shown.collect()) == ["B", "N", "OpenX"]


def test_pages_of_registered_boards(spark):
    from jobloom.schemas import BOARD

    boards = spark.createDataFrame([("ashby", "openx", None, None, None, "OpenX", "Open", 4)], BOARD)
    pages = spark.createDataFrame([("ashby", "openx", "{}"), ("ashby", "gone", "{}")], "ats string, board_key string, body string")
    row = payloads.of_boards(pages, boards).collect()
    assert len(row) == 1 and row[0].board == "OpenX" and row[0].board_ord == 4


def test_the_string_zero_is_an_id(spark):
    ashby = page("ashby", {"jobs": [{"id": "0", "title": "A"}, {"id": "", "title": "B"}, {"title": "C"}]})
    assert [r.job_id for r in read(spark, "ashby", ashby)] == ["ash_0"]
    smart = page("smartrecruiters", {"totalFound": 1, "content": [{"id": "0", "name": "A"}]})
    assert [r.job_id for r in read(spark, "smartrecruiters", smart)] == ["sr_0"]
    green = page("greenhouse", {"jobs": [{"id": 0, "title": "A"}, {"id": 1, "title": "B"}]})
    assert [r.job_id for r in read(spark, "greenhouse", green)] == ["gh_1"]


def test_stop_rules_shuffle_no_payload(spark):
    pages = spark.createDataFrame([page("smartrecruiters", {"totalFound": 1, "content": []})], PAGE)
    from jobloom.sources import paging

    plan = paging.smartrecruiters_until(pages)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange" not in line or "body" not in line
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert windows and not any("body" in x or "_doc" in x for x in windows)


def test_unlanded_bodies_are_parsed_once(spark):
    """One scan and one parse per system before the one shuffle; there were a scan and up to three parses more."""
    pages = spark.sql(
        "SELECT 'smartrecruiters' AS ats, b AS board, b AS name, '' AS tenant, '' AS wd, '' AS site, '' AS term, 0 AS term_ord, 1L AS board_ord,"
        " id AS page_no, IF(id = 7, 500, 200) AS status, '{\"totalFound\":5,\"content\":[{\"id\":\"a\"},{\"id\":\"\"}]}' AS body"
        " FROM range(20) LATERAL VIEW explode(array('x', 'y', NULL)) t AS b").repartition(3)
    rows = payloads.scan(pages, "smartrecruiters")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("hashpartitioning(board") == 1 and "Join" not in plan
    landed = payloads.scan(payloads.landed(pages), "smartrecruiters")

    def of(df):
        return sorted((r.board, r.page_no, r.pos, r.p.id) for r in df.collect())

    assert of(rows) == of(landed) == [(b, n, k, "a" if k == 0 else "") for b in "xy" for n in range(3) for k in range(2)]
