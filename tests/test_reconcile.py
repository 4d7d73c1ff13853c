"""State reconciliation against a plain loop over the batch."""

import random

import pytest

from jobloom.operators import reconcile as rc
from jobloom.operators import scoring
from jobloom.schemas import JOB_STATE, POSTING, STATE_COLS

NOW = "2026-02-01T00:00:00+00:00"
OLD = "2026-01-01T00:00:00+00:00"


def role_of(title):
    return "intern" if "Intern" in title else "senior" if "Staff" in title else "mid"


def postings(seed, n=200, ids=60):
    rnd = random.Random(seed)
    return [
        (seq, f"j{rnd.randrange(ids)}", f"C{rnd.randrange(5)}",
         rnd.choice(["Intern", "Staff Engineer", "Analyst"]), f"u{seq}",
         rnd.choice([None, "", "NYC"]), f"d{seq}", rnd.choice(["lever", "indeed"]), f"text {seq}")
        for seq in range(n)
    ]


def prior(seed, ids=90):
    rnd = random.Random(seed)
    return [
        (f"j{i}", "Old", "Analyst", "u", None, "mid", "", "lever", "no", "", "", OLD, OLD,
         rnd.choice(["active", "removed"]))
        for i in range(30, ids)
    ]


def loop(batch, state):
    """The same reconciliation, one posting after the other."""
    rows = {r[0]: dict(zip(STATE_COLS, r)) for r in state}
    last_title = {p[1]: p[3] for p in batch}
    new, updated, seen = {}, 0, set()
    for seq, jid, company, title, url, loc, day, source, _ in batch:
        seen.add(jid)
        if jid in rows:
            rows[jid].update(last_seen=NOW, status="active", title=title, apply_url=url, location=loc)
            updated += 1
        else:
            rows[jid] = dict(
                job_id=jid, company=company, title=title, apply_url=url, location=loc,
                role_type=role_of(last_title[jid]), posted_on=day, source=source, sponsorship="",
                clearance="", grad_year="", first_seen=NOW, last_seen=NOW, status="active",
            )
            new[jid] = (seq, title)
    gone = [j for j, r in rows.items() if r["status"] == "active" and j not in seen]
    for j in gone:
        rows[j].update(status="removed", last_seen=NOW)
    return rows, new, updated, len(gone)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reconcile_equals_loop(spark, seed):
    batch, state = postings(seed), prior(seed)
    b = spark.createDataFrame(batch, POSTING).repartition(5)
    s = spark.createDataFrame(state, JOB_STATE)
    rec = rc.reconcile(b, s, NOW).cache()
    rows, new, updated, removed = loop(batch, state)
    got = {r.job_id: r.asDict() for r in rc.next_state(rec).collect()}
    assert got == rows
    assert {r.job_id: (r.seq, r.title) for r in rc.new_jobs(rec).collect()} == new
    counts = rc.change_counts(rec).first()
    assert (counts.new_jobs, counts.updated, counts.removed) == (len(new), updated, removed)


def test_rerun_changes_nothing(spark):
    b = spark.createDataFrame(postings(4), POSTING)
    first = rc.next_state(rc.reconcile(b, spark.createDataFrame([], JOB_STATE), OLD))
    again = rc.reconcile(b, first, NOW)
    counts = rc.change_counts(again).first()
    assert (counts.new_jobs, counts.removed) == (0, 0) and counts.updated == 200


def test_empty_batch_removes_all_active(spark):
    s = spark.createDataFrame(prior(5), JOB_STATE)
    rec = rc.reconcile(spark.createDataFrame([], POSTING), s, NOW)
    assert rc.next_state(rec).where("status = 'active'").count() == 0
    counts = rc.change_counts(rec).first()
    assert (counts.new_jobs, counts.updated) == (0, 0)


def test_complete_sources_guard(spark):
    s = spark.createDataFrame(prior(5), JOB_STATE)
    rec = rc.reconcile(spark.createDataFrame([], POSTING), s, NOW, complete_sources=["greenhouse"])
    assert rc.change_counts(rec).first().removed == 0


def test_without_descriptions(spark):
    b = spark.createDataFrame(postings(6), POSTING)
    empty = spark.createDataFrame([], JOB_STATE)
    slim = rc.new_jobs(rc.reconcile(b.drop("description"), empty, NOW))
    assert "description" not in slim.columns
    full = rc.new_jobs(rc.reconcile(b, empty, NOW))
    joined = rc.with_descriptions(slim, b).select(*full.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, full.collect()))


def test_upgrade_state(spark):
    old = spark.createDataFrame([("a", "c", "t", "u", None, "mid", OLD, OLD, "active")],
        "job_id string, company string, title string, apply_url string, location string, "
        "role_type string, first_seen string, last_seen string, status string")
    row = rc.upgrade_state(old).first()
    assert row.asDict()["source"] == "workday" and row.posted_on == "" and row.grad_year == ""
    assert list(row.asDict()) == STATE_COLS


def test_relistings(spark):
    state = [
        ("a", "Acme", "Intern", "u", "NYC", "mid", "", "lever", "", "", "", OLD, OLD, "active"),
        ("b", "Beta", "Intern", "u", "NYC", "mid", "", "lever", "", "", "", OLD, OLD, "removed"),
    ]
    jobs = [("n1", "Acme Inc.", "intern", "NYC, NY"), ("n2", "Beta", "Intern", "NYC"),
            ("n3", "Inc", "Intern", "NYC"), ("n4", "New", "Intern", "NYC"), ("n5", "New", "Intern", "NYC")]
    df = spark.createDataFrame(jobs, "job_id string, company string, title string, location string")
    keys = rc.active_keys(spark.createDataFrame(state, JOB_STATE))
    for hot_rows in (1, 10**6):
        kept = rc.without_relistings(df, keys, hot_rows=hot_rows)
        assert sorted(r.job_id for r in kept.collect()) == ["n2", "n3", "n4", "n5"]


def test_merge_flags(spark):
    s = spark.createDataFrame(prior(5), JOB_STATE)
    flagged = spark.createDataFrame([("j30", "", "yes", "2026")],
        "job_id string, sponsorship string, clearance string, grad_year string")
    rows = {r.job_id: r for r in rc.merge_flags(s, flagged).collect()}
    assert (rows["j30"].sponsorship, rows["j30"].clearance, rows["j30"].grad_year) == ("", "yes", "2026")
    assert rows["j31"].sponsorship == "no" and len(rows) == s.count()


def test_scored_roles(spark):
    def factory():
        def model(titles, texts):
            if "Crash" in titles:
                raise RuntimeError("model failed")
            return [texts[0] if "Analyst" in t else "off the list" for t in titles]
        return model

    b = spark.createDataFrame(
        [(1, "a", "C", "Staff", "", "", "", "lever", ""), (2, "a", "C", "Analyst", "", "", "", "lever", ""),
         (3, "b", "C", "Painter", "", "", "", "lever", ""), (4, "c", "C", "Staff", "", "", "", "lever", "")],
        POSTING)
    rec = rc.reconcile(b, spark.createDataFrame([], JOB_STATE), NOW)
    labels = scoring.score_titles(rc.undecided(rec).select("title").distinct(), factory)
    roles = {r.job_id: r.role_type for r in rc.with_scored_roles(rec, labels).collect()}
    assert roles == {"a": "intern", "b": "mid", "c": "senior"}
    crash = scoring.score_titles(spark.createDataFrame([("Crash",)], "title string"), factory)
    assert crash.first().label is None

    def broken():
        raise RuntimeError("no model")

    assert scoring.score_titles(spark.createDataFrame([("A",)], "title string"), broken).first().label is None


def test_unseen(spark):
    b = spark.createDataFrame(postings(8), POSTING)
    s = spark.createDataFrame(prior(8), JOB_STATE)
    known = {r[0] for r in prior(8)}
    want = sorted(p[0] for p in postings(8) if p[1] not in known)
    for hot_rows in (1, 10**6):
        assert sorted(r.seq for r in rc.unseen(b, s, hot_rows=hot_rows).collect()) == want
