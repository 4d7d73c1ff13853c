"""Edge tables for text functions, classification and flags."""

import pytest
from pyspark.sql import functions as F

from jobloom.functions import flags, keys, roles, text

NBSP = " "


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""), ("", ""), ("  a b \t\n", "a b"), (f"{NBSP}a{NBSP}", "a"),
        ("\x1ca\x1f", "a"), ("a\n", "a"), (" x　", "x"),
    ],
)
def test_strip(apply, raw, want):
    assert apply(text.strip, [raw]) == [want]


def test_tokens(apply):
    got = apply(text.tokens, ["Intern, Software (2026)", "  ", None, "İstanbul", "C++/C#"])
    assert got == [["intern", "software", "2026"], [], [], ["i", "stanbul"], ["c", "c"]]


@pytest.mark.parametrize(
    "company, title, location, want",
    [
        ("Acme, Inc.", "Intern, Software (2026)", "San Francisco, CA", "acme|2026 intern software|san francisco"),
        ("ACME Co., Ltd.", "Software Intern - 2026", "San Francisco, California, US", "acme|2026 intern software|san francisco"),
        ("Zinc", "A", None, "zinc|a|"),
        ("Inc", "A", "", None),
        ("Inc. LLC", "A", "", None),
        ("Acme Inc Labs", "A", "", "acme inc labs|a|"),
        ("Acme", " - ", "x", None),
        (None, "A", "x", None),
        ("Acme", None, "x", None),
        ("a|b", "A", "x", "a b|a|x"),
    ],
)
def test_fuzzy_key(spark, company, title, location, want):
    df = spark.createDataFrame([(company, title, location)], "c string, t string, l string")
    assert df.select(text.fuzzy_key(F.col("c"), F.col("t"), F.col("l"))).first()[0] == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a &amp; b", "a & b"),
        ("&lt;b&gt;x&lt;/b&gt;", " x "),
        ("it&rsquo;s&nbsp;ok", f"it’s{NBSP}ok"),
        ("a < b > c", "a   c"),
        ("&amp;lt;p&amp;gt;", "&lt;p&gt;"),
        ("&notanentity; &#65;&#x42", "¬anentity; AB"),
        ("<p>no entity</p>", " no entity "),
        ("<>", "<>"),
        (None, ""),
    ],
)
def test_strip_html(apply, raw, want):
    assert apply(text.strip_html, [raw]) == [want]


def test_strip_html_each(apply):
    lists = [["<li>a&amp;b</li>", None, ""], None, [], ["<b>x</b>"]]
    want = [[" a&b ", "", ""], None, [], [" x "]]
    assert apply(text.strip_html_each, lists, "array<string>") == want


def test_percent_decode(apply):
    raws = ["Caf%C3%A9", "a%zzb%20c", "100%", "%", "a+b", "plain", "%2"]
    assert apply(text.percent_decode, raws) == ["Café", "a%zzb c", "100%", "%", "a+b", "plain", "%2"]
    assert "�" in apply(text.percent_decode, ["x%FFy"])[0]


def test_flag_text(apply):
    raws = [f"One{NBSP} Two \n\n  * Three\r\nFour", None, "\n"]
    assert apply(text.flag_text, raws) == ["one two. * three. four", "", "."]


ROLES = [
    ("Software Engineer Intern", "intern"),
    ("Lead, Internship Programs", "intern"),
    ("Co-op Student", "intern"),
    ("Coop", "intern"),
    ("Summer Analyst", "intern"),
    ("Software Interns", None),
    ("Manager, Campus Recruiting", "new_grad"),
    ("New Graduates Program", None),
    ("NEWGRAD Engineer", "new_grad"),
    ("Entry---Level", "new_grad"),
    ("Associate Engineer", "new_grad"),
    ("Sr. Engineer", "senior"),
    ("Engineer III", "senior"),
    ("V-Ray Artist", "senior"),
    ("Engineer II", "mid"),
    ("Engineer, 10+ years", "senior"),
    ("Engineer, 5+ years", None),
    ("ingénieur", None),
    ("éintern", None),
    ("Data Analyst", None),
    ("", None),
]


def test_keyword_role(apply):
    assert apply(roles.keyword_role, [t for t, _ in ROLES]) == [r for _, r in ROLES]


def test_default_role(apply):
    assert apply(roles.role, ["Data Analyst", None, "Staff"]) == ["mid", "mid", "senior"]


@pytest.mark.parametrize(
    "location, want",
    [
        (None, True), ("", True), ("Austin, TX", True), ("Remote", True),
        ("Indianapolis, Indiana", False), ("Milwaukee, WI", False), ("Santa Fe, New Mexico", False),
        ("London, UK", False), ("Remote - Non US", False), ("Lima, Peru", True),
    ],
)
def test_in_us(apply, location, want):
    assert apply(roles.in_us, [location]) == [want]


FLAG_ROWS = [
    ("", "", "", ""),
    (None, "", "", ""),
    ("We do not offer visa sponsorship", "no", "", ""),
    ("We can not ever possibly sponsor", "no", "", ""),
    ("Visa sponsorship available", "yes", "", ""),
    ("Sponsorship is not available. Will sponsor", "no", "", ""),
    ("Must be a U.S. citizen", "no", "", ""),
    ("Citizenship matters", "", "", ""),
    ("Students, science", "", "yes", ""),
    ("Technology. Security clearance", "", "yes", ""),
    ("Technology roles with security clearance", "", "", ""),
    ("Active TS / SCI", "", "", ""),
    ("Active TS/SCI", "", "yes", ""),
    ("Clearance is not required. Top secret", "", "", ""),
    ("Graduating 2027 or 2026. Founded 2025", "", "", "2026, 2027"),
    ("Class of 2023, 2024, 2032, 2033", "", "", "2024, 2032"),
    ("Graduation\n2026", "", "", ""),
    ("graduates 20266", "", "", ""),
    ("unable to\nsponsor", "", "", ""),
]


def test_flags(spark):
    rows = [(i, r[0]) for i, r in enumerate(FLAG_ROWS)]
    df = spark.createDataFrame(rows, "i int, d string")
    got = flags.with_flags(df, "d").orderBy("i").collect()
    for row, want in zip(got, FLAG_ROWS):
        assert (row.sponsorship, row.clearance, row.grad_year) == want[1:], want


def test_surrogate_id(spark):
    import hashlib

    url = "https://example.org/é"
    df = spark.createDataFrame([("indeed", url)], "s string, u string")
    got = df.select(keys.surrogate_id(F.col("s"), F.col("u"))).first()[0]
    assert got == "indeed_" + hashlib.sha1(url.encode()).hexdigest()[:12]


@pytest.mark.parametrize(
    "source, job_id, url, want",
    [
        ("workday", "R1", "https://Nvidia.wd5.myworkdayjobs.com/Site/job/US/Intern_R1?x=1#y",
         "nvidia.wd5.myworkdayjobs.com/wday/cxs/nvidia/Site/job/US/Intern_R1"),
        ("workday", "R1", "https://nvidia.wd5.myworkdayjobs.com/Site", None),
        ("workday", "R1", "", None),
        ("greenhouse", "gh_1", "https://boards.eu.greenhouse.io/acme/jobs/12?gh=1", "acme/jobs/12"),
        ("greenhouse", "gh_1", "https://acme.com/jobs/12", None),
        ("lever", "lv_u", "https://jobs.lever.co/acme/u-1/apply", "acme/u-1"),
        ("lever", "lv_u", "https://jobs.lever.co/acme/", None),
        ("ashby", "ash_q1", "https://jobs.ashbyhq.com/Acme/q1", "Acme/q1"),
        ("ashby", "ash_q1", "https://jobs.ashbyhq.com/", None),
        ("indeed", "x", "https://x/y/z", None),
    ],
)
def test_detail_key(spark, source, job_id, url, want):
    df = spark.createDataFrame([(source, job_id, url)], "s string, j string, u string")
    assert df.select(keys.detail_key(F.col("s"), F.col("j"), F.col("u"))).first()[0] == want


def test_batch_seq_sorts_like_its_parts(spark):
    import itertools

    parts = list(itertools.product((0, 6), (0, 1 << 19), (0, 15), (0, 1 << 33), (0, 65536)))
    df = spark.createDataFrame(parts, "a int, b int, c int, d bigint, e int")
    seq = keys.batch_seq(*[F.col(c) for c in "abcde"])
    rows = df.select("*", seq.alias("s")).orderBy("s").collect()
    assert [tuple(r)[:5] for r in rows] == sorted(parts)
    assert rows[0].s == 0 and rows[-1].s > 0


def test_batch_seq_refuses_overflow(spark):
    df = spark.createDataFrame([(0, 0, 10_000, 0, 0)], "a int, b int, c int, d int, e int")
    with pytest.raises(Exception, match="out of range"):
        df.select(keys.batch_seq(*[F.col(c) for c in "abcde"])).collect()
