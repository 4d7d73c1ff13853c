"""Enrichment, announcement messages, the sheet, and whole runs."""


from jobloom.operators import enrich as en
from jobloom.operators import publish as pu
from jobloom.plans import hourly
from jobloom.schemas import DETAIL, JOB_STATE, POSTING
from jobloom.settings import Settings

NOW = "2026-02-01T00:00:00+00:00"
JOB = ("seq bigint, job_id string, company string, title string, apply_url string, location string, "
       "role_type string, posted_on string, source string, first_seen string, sponsorship string, "
       "clearance string, grad_year string")


def job(seq, role="intern", location="NYC", **kw):
    row = dict(seq=seq, job_id=f"j{seq}", company="C", title=f"T{seq}", apply_url=f"u{seq}", location=location,
               role_type=role, posted_on="", source="lever", first_seen=NOW, sponsorship="", clearance="", grad_year="")
    return tuple((row | kw).values())


def test_card(spark):
    jobs = [job(1, company="", location=None, title="x" * 300, sponsorship="no", clearance="yes", grad_year="2026"),
            job(2, role="other", posted_on="2026-01-01", sponsorship="yes")]
    cards = [r.c for r in spark.createDataFrame(jobs, JOB).select("seq", pu.card(256).alias("c")).orderBy("seq").collect()]
    assert len(cards[0].title) == 256 and cards[0].color == 0x2ECC71
    assert [(f.name, f.value) for f in cards[0].fields] == [
        ("Company", "—"), ("Role", "intern"), ("Location", "—"), ("Sponsorship", "❌ Not offered"),
        ("Clearance", "🔒 Required"), ("Grad year", "2026")]
    assert cards[1].color == 0x95A5A6
    assert [f.name for f in cards[1].fields] == ["Company", "Role", "Location", "Posted", "Sponsorship"]
    assert all(f.inline for f in cards[1].fields)


def test_messages(spark):
    jobs = [job(i * 1000) for i in range(23)] + [job(1, role="mid"), job(2, location="London, UK")]
    df = spark.createDataFrame(jobs, JOB).repartition(5)
    rows = pu.messages(df).orderBy("message_no").collect()
    assert [len(r.cards) for r in rows] == [10, 10, 3]
    assert [c.title for r in rows for c in r.cards] == [f"T{i * 1000}" for i in range(23)]
    counts = pu.announce_counts(df).first()
    assert (counts.posted, counts.filtered_out) == (23, 2)


def test_sheet_append_and_order(spark):
    cols = "append_seq bigint, job_id string, role_type string, first_seen string"
    sheet = spark.createDataFrame([(0, "a", "mid", "2026-01-01"), (1, "", "mid", "2026-01-01")], cols)
    new = [(2, "a", "intern", "2026-01-02"), (3, "b", "intern", "2026-01-02"), (4, "b", "intern", "2026-01-03"),
           (5, "", "new_grad", "2026-01-02"), (6, None, "odd", "2026-01-09"), (7, "c", "intern", "2026-01-02")]
    payload = spark.createDataFrame(new, cols)
    for hot_rows in (1, 10**6):
        added = pu.sheet_append(sheet, payload, hot_rows=hot_rows)
        assert sorted(r.append_seq for r in added.collect()) == [3, 4, 5, 6, 7]
    got = pu.sheet_sorted(sheet.unionByName(added)).collect()
    assert [r.append_seq for r in got] == [4, 3, 7, 5, 0, 1, 6]


def test_descriptions(spark):
    jobs = [
        (1, "w", "workday", "https://a.wd1.myworkdayjobs.com/S/job/1", ""),
        (2, "g", "greenhouse", "https://boards.greenhouse.io/acme/jobs/7", ""),
        (3, "lv_u", "lever", "https://jobs.lever.co/acme/u", None),
        (4, "ash_q", "ashby", "https://jobs.ashbyhq.com/acme/q", ""),
        (5, "ash_r", "ashby", "https://jobs.ashbyhq.com/acme/r", ""),
        (6, "s", "smartrecruiters", "https://x/y", ""),
        (7, "i", "indeed", "https://x/y", "scraped <b>raw</b>"),
        (8, "g2", "greenhouse", "https://boards.greenhouse.io/acme/jobs/8", ""),
        (9, "g3", "greenhouse", "https://boards.greenhouse.io/acme/jobs/9", "kept &amp; raw"),
        (10, "lv_v", "lever", "https://jobs.lever.co/acme/v", ""),
    ]
    details = spark.createDataFrame([
        ("workday", "a.wd1.myworkdayjobs.com/wday/cxs/a/S/job/1", 200, '{"jobPostingInfo":{"jobDescription":"<p>a &amp; b</p>"}}'),
        ("greenhouse", "acme/jobs/7", 200, '{"content":"&lt;p&gt;x&lt;/p&gt;"}'),
        ("greenhouse", "acme/jobs/8", 500, '{"content":"no"}'),
        ("greenhouse", "acme/jobs/9", 200, '{"content":"no"}'),
        ("lever", "acme/u", 200, '{"descriptionPlain":"d","additionalPlain":null,"lists":[{"content":"<li>x &lt;3</li>"},{"content":""},{}]}'),
        ("lever", "acme/v", 200, "oops"),
    ], DETAIL)
    boards = spark.createDataFrame([
        ("acme", 200, '{"jobs":[{"id":"q","descriptionPlain":"plain","descriptionHtml":"<p>h</p>"},{"id":"r","descriptionPlain":"","descriptionHtml":"<p>h</p>"},{"descriptionPlain":"z"}]}'),
    ], "slug string, status int, body string")
    df = spark.createDataFrame(jobs, "seq int, job_id string, source string, apply_url string, description string")
    everything = details.unionByName(en.ashby_details(boards)).unionByName(details)
    got = {r.seq: r.full_description for r in en.enrich(df, everything).collect()}
    # "x <3</li>": the entity is unescaped first, so "<3</li>" goes as one tag.
    assert got == {1: " a & b ", 2: " x ", 3: "d\n x  ", 4: "plain", 5: " h ", 6: "",
                   7: "scraped <b>raw</b>", 8: "", 9: "kept &amp; raw", 10: ""}
    alone = {r.seq: r.full_description for r in en.enrich(df).collect()}
    assert alone[7] and alone[1] == "" and len(alone) == 10


def test_run(spark):
    rows = [
        (1, "a", "Acme", "Software Intern", "u1", "Austin, TX", "", "lever", ""),
        (2, "b", "Acme Inc.", "Intern, Software", "u2", "Austin", "", "indeed", "x"),
        (3, "c", "Beta", "New Grad", "u3", "Austin", "", "indeed", "Unable to sponsor. Class of 2026"),
        (4, "d", "Gamma", "Painter", "u4", "Austin", "", "lever", ""),
        (5, "e", "Known", "Intern", "u5", "Austin", "", "lever", ""),
        (6, "f", "Delta", "Campus Hire", "u6", "London, UK", "", "lever", ""),
        (7, "c", "Beta", "New Grad II", "u7", "Austin", "", "indeed", "other"),
    ]
    state = [
        ("k", "Known LLC", "intern", "u", "Austin", "mid", "", "lever", "", "", "", "o", "o", "active"),
        ("d", "Gamma", "Painter", "u", "Austin", "mid", "", "lever", "", "", "", "o", "o", "removed"),
    ]
    p, s = spark.createDataFrame(rows, POSTING), spark.createDataFrame(state, JOB_STATE)
    out = hourly.run(p, s, NOW, settings=Settings(exclude_no_sponsorship=True))
    after = {r.job_id: r for r in out.state.collect()}
    assert {k: r.status for k, r in after.items()} == {"a": "active", "c": "active", "d": "active", "e": "active", "f": "active", "k": "removed"}
    assert (after["c"].sponsorship, after["c"].grad_year, after["c"].title) == ("no", "2026", "New Grad II")
    assert sorted(r.job_id for r in out.new_jobs.collect()) == ["a", "c", "e", "f"]
    assert sorted(r.job_id for r in out.fresh.collect()) == ["a", "c", "f"]
    assert [c.title for r in out.messages.collect() for c in r.cards] == ["Software Intern"]
    assert sorted(r.job_id for r in out.sheet_rows.collect()) == ["a", "f"]
    c = out.counters.first()
    assert c.asDict() == dict(total=7, cross_dropped=1, new_jobs=4, updated=2, removed=1, suppressed=1, excluded=1)
    told = hourly.announceable_jobs(p, s, NOW)
    assert sorted(r.job_id for r in told.collect()) == ["a", "c"]


def test_run_with_scorer(spark):
    def factory():
        return lambda titles, texts: [texts[0]] * len(titles)

    rows = [(1, "d", "Gamma", "Painter", "u4", "Austin", "", "lever", ""), (2, "e", "G", "Staff", "u", "", "", "lever", "")]
    out = hourly.run(spark.createDataFrame(rows, POSTING), spark.createDataFrame([], JOB_STATE), NOW, scorer=factory,
                     settings=Settings(enrich_descriptions=False))
    assert {r.job_id: r.role_type for r in out.state.collect()} == {"d": "intern", "e": "senior"}


def test_sheet_rows(spark):
    row = pu.sheet_rows(spark.createDataFrame([job(1, location=None)], JOB)).first()
    assert row.location == "" and list(row.asDict()) == list(pu.SHEET_COLS)


def test_written_messages_and_sheet(spark, tmp_path):
    import json

    df = spark.createDataFrame([job(i, sponsorship="yes") for i in range(12)], JOB)
    pu.write_messages(pu.messages(df), str(tmp_path / "m"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(len(m["embeds"]) for m in lines) == [2, 10]
    card = max(lines, key=lambda m: len(m["embeds"]))["embeds"][0]
    assert card["title"] == "T0" and card["url"] == "u0" and card["color"] == 0x2ECC71
    assert card["fields"][0] == {"name": "Company", "value": "C", "inline": True}

    sheet = df.withColumnRenamed("seq", "append_seq")
    pu.write_sheet(sheet, str(tmp_path / "s"))
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert back.columns == list(pu.SHEET_COLS) and back.count() == 12


def test_landed_run_stores_the_batch_once(spark):
    """Pages of a registry to messages; the union of all readers is handed over once."""
    import json

    from jobloom.schemas import BOARD, JOB_STATE

    registry = spark.createDataFrame([("lever", "acme", None, None, None, "acme", "Acme", 3)], BOARD)
    body = json.dumps([{"id": "1", "text": "Software Intern", "categories": {"location": "Austin, TX"}}])
    kind = "ats string, board_key string, term string, term_ord int, page_no bigint, status int, body string"
    pages = spark.createDataFrame([("lever", "acme", "", 0, 0, 200, body), ("lever", "other", "", 0, 0, 200, body)], kind)
    stored = []

    def keep(df, name):
        stored.append(name)
        return spark.createDataFrame(df.collect(), df.schema)

    out = hourly.run_landed(registry, pages, None, spark.createDataFrame([], JOB_STATE), NOW, keep=keep)
    assert [r.job_id for r in out.fresh.collect()] == ["lv_1"] and stored.count("postings") == 1
    assert out.messages.count() == 1 and out.state.first().company == "Acme"


def test_landed_run_drops_what_it_no_longer_reads(spark):
    """One copy of the jobs is left beside the reconciled ones; all tables of the run stayed before."""
    import json
    import os

    from jobloom import session
    from jobloom.schemas import BOARD, JOB_STATE

    registry = spark.createDataFrame([("lever", "acme", None, None, None, "acme", "Acme", 3), ("smartrecruiters", "b", None, None, None, "b", "B", 4)], BOARD)
    bodies = {"acme": [{"id": "1", "text": "Software Intern", "categories": {"location": "Austin, TX"}}], "b": {"totalFound": 1, "content": [{"id": "2", "name": "Intern"}]}}
    kind = "ats string, board_key string, term string, term_ord int, page_no bigint, status int, body string"
    pages = spark.createDataFrame([(a, b, "", 0, 0, 200, json.dumps(bodies[b])) for a, b in (("lever", "acme"), ("smartrecruiters", "b"))], kind)
    with session.recorded() as made:
        out = hourly.run_landed(registry, pages, None, spark.createDataFrame([], JOB_STATE), NOW)
    left = sorted(os.path.basename(p)[:-33] for p in made if os.path.exists(p.removeprefix("file:")))
    assert left == ["flagged", "fresh-flagged", "positions", "reconciled", "totals"]
    assert sorted(r.job_id for r in out.fresh.collect()) == sorted(r.job_id for r in out.new_jobs.collect()) == ["lv_1", "sr_2"]
    assert out.state.count() == out.sheet_rows.count() == 2 and out.messages.count() == 1
    assert out.counters.first().asDict() == {"total": 2, "cross_dropped": 0, "new_jobs": 2, "updated": 0, "removed": 0, "suppressed": 0, "excluded": 0}
