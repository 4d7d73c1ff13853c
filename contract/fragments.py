"""SQL expressions of the semantics, for DuckDB."""

from __future__ import annotations

from jobloom.functions import flags as fl
from jobloom.functions import roles as ro
from jobloom.functions import text as tx
from jobloom.operators import boards as bo


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def fuzzy_key(company: str = "company", title: str = "title", location: str = "location") -> str:
    suffixes = "|".join(tx.LEGAL_SUFFIXES)
    c = f"regexp_replace({words(company)}, '(?:(?:^| )(?:{suffixes}))+$', '')"
    t = f"array_to_string(list_sort(string_split({words(title)}, ' ')), ' ')"
    city = words(f"split_part(coalesce({location}, ''), ',', 1)")
    return f"(nullif({c}, '') || '|' || nullif({t}, '') || '|' || {city})"


def keyword_role(t: str = "title") -> str:
    cases = " ".join(
        f"WHEN regexp_matches(coalesce({t}, ''), {quoted('(?i)' + rule)}) THEN '{label}'"
        for rule, label in ro.ROLE_RULES
    )
    return f"(CASE {cases} END)"


def role(t: str = "title") -> str:
    return f"coalesce({keyword_role(t)}, 'mid')"


def announceable(r: str) -> str:
    return f"({r} IN ('intern', 'new_grad'))"


def in_us(loc: str = "location") -> str:
    hits = " OR ".join(
        f"contains(lower(coalesce({loc}, '')), {quoted(k)})" for k in ro.NON_US_KEYWORDS
    )
    return f"(NOT ({hits}))"


def flag_text(x: str) -> str:
    lines = rf"regexp_replace(lower(coalesce({x}, '')), '\s*\n+\s*', '. ', 'g')"
    return rf"trim(regexp_replace({lines}, '\s+', ' ', 'g'))"


def any_of(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in patterns) + ")"


def sponsorship(t: str) -> str:
    return (
        f"(CASE WHEN {any_of(t, fl.NO_SPONSOR)} THEN 'no' "
        f"WHEN {any_of(t, fl.YES_SPONSOR)} THEN 'yes' ELSE '' END)"
    )


def clearance(t: str) -> str:
    return (
        f"(CASE WHEN NOT {any_of(t, fl.NO_CLEARANCE)} AND {any_of(t, fl.CLEARANCE)} "
        "THEN 'yes' ELSE '' END)"
    )


def grad_years(t: str) -> str:
    sentences = (
        f"list_filter(string_split({t}, '.'), lambda s: regexp_matches(s, {quoted(fl.GRAD_WORDS)}))"
    )
    years = (
        f"flatten(list_transform({sentences}, "
        f"lambda s: regexp_extract_all(s, {quoted(fl.GRAD_YEAR)}, 1)))"
    )
    kept = f"list_filter({years}, lambda y: CAST(y AS INTEGER) BETWEEN 2024 AND 2032)"
    return f"coalesce(array_to_string(list_sort(list_distinct({kept})), ', '), '')"


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def board_key(p: str = "") -> str:
    return (
        f"(CASE WHEN {p}ats = 'workday' THEN {p}tenant || '/' || {p}wd || '/' || {p}site "
        f"WHEN {p}ats IN ('ashby', 'smartrecruiters') THEN lower({p}slug) ELSE {p}slug END)"
    )


def links(texts: str, doc: str, body: str = "body") -> list[tuple[str, str]]:
    """CTEs that end in ``links``: every board link of ``texts`` with its ``pos``."""
    rules = [("workday", bo.WORKDAY_URL, 0)]
    rules += [("greenhouse", p, 1) for p in bo.GREENHOUSE_URLS]
    rules += [
        ("lever", bo.LEVER_URL, 1), ("ashby", bo.ASHBY_URL, 1),
        ("smartrecruiters", bo.SMARTRECRUITERS_URL, 1), ("workable", bo.WORKABLE_URL, 1),
    ]
    arms = []
    for i, (ats, pattern, group) in enumerate(rules):
        rx = quoted("(?i)" + pattern)
        first = next(j for j, r in enumerate(rules) if r[0] == ats)
        arms.append(
            f"SELECT {doc}, {i} AS r, {i - first} AS rule, '{ats}' AS ats, "
            f"unnest(range(len(m))) AS i, unnest(m) AS x FROM "
            f"(SELECT {doc}, regexp_extract_all({body}, {rx}, {group}) AS m FROM {texts}) q"
        )
    wd = quoted("(?i)" + bo.WORKDAY_URL)
    parts = f"""
SELECT {doc}, r, rule, ats, i,
  CASE WHEN ats = 'workday' THEN lower(regexp_extract(x, {wd}, 1)) END AS tenant,
  CASE WHEN ats = 'workday' THEN lower(regexp_extract(x, {wd}, 2)) END AS wd,
  CASE WHEN ats = 'workday' THEN regexp_extract(x, {wd}, 3) END AS site,
  CASE WHEN ats = 'workday' THEN NULL WHEN ats = 'smartrecruiters' THEN x
       WHEN ats = 'ashby' THEN regexp_replace(x, '[.]+$', '') ELSE lower(x) END AS slug
FROM matches"""
    bad = " AND ".join(
        f"NOT (ats = '{ats}' AND lower(coalesce(site, slug)) IN ({listed(values)}))"
        for ats, values in bo.NOT_BOARDS.items() if values
    )
    out = f"""
SELECT {doc}, ROW_NUMBER() OVER (PARTITION BY {doc} ORDER BY r, i) - 1 AS pos, rule, ats,
  {board_key()} AS board_key, tenant, wd, site, slug,
  CASE ats WHEN 'workday' THEN tenant WHEN 'ashby' THEN url_decode(slug) ELSE slug END AS name
FROM parts WHERE {bad}"""
    return [("matches", "\nUNION ALL\n".join(arms)), ("parts", parts), ("links", out)]


def deduped(postings: str = "postings_fx") -> list[tuple[str, str]]:
    """CTEs that end in ``kept``: the batch after cross-source dedupe."""
    return [
        ("keyed", f"SELECT *, {fuzzy_key()} AS fkey FROM {postings}"),
        ("marked", """
SELECT *, fkey IS NOT NULL AND source <> first_value(source) OVER (PARTITION BY fkey ORDER BY seq) AS dropped
FROM keyed"""),
        ("kept", "SELECT * FROM marked WHERE NOT dropped"),
    ]


def reconciled(
    batch: str, state: str, now: str, role_sql: str | None = None, name: str = "rec"
) -> list[tuple[str, str]]:
    """CTEs that end in ``name``: one row per id of batch or state."""
    role_sql = role_sql or role("l.title")
    ranked = f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq) AS up,
  ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq DESC) AS down,
  COUNT(*) OVER (PARTITION BY job_id) AS n
FROM {batch}"""
    rec = f"""
SELECT coalesce(f.job_id, s.job_id) AS job_id,
  CASE WHEN s.job_id IS NULL THEN 'new' WHEN f.job_id IS NOT NULL THEN 'updated'
       WHEN s.status = 'active' THEN 'removed' ELSE 'kept' END AS change,
  coalesce(f.n, 0) AS n,
  CASE WHEN s.job_id IS NULL THEN f.company ELSE s.company END AS company,
  CASE WHEN f.job_id IS NULL THEN s.title ELSE l.title END AS title,
  CASE WHEN f.job_id IS NULL THEN s.apply_url ELSE l.apply_url END AS apply_url,
  CASE WHEN f.job_id IS NULL THEN s.location ELSE l.location END AS location,
  CASE WHEN s.job_id IS NULL THEN {role_sql} ELSE s.role_type END AS role_type,
  CASE WHEN s.job_id IS NULL THEN f.posted_on ELSE s.posted_on END AS posted_on,
  CASE WHEN s.job_id IS NULL THEN f.source ELSE s.source END AS source,
  coalesce(s.sponsorship, '') AS sponsorship, coalesce(s.clearance, '') AS clearance,
  coalesce(s.grad_year, '') AS grad_year,
  CASE WHEN s.job_id IS NULL THEN '{now}' ELSE s.first_seen END AS first_seen,
  CASE WHEN f.job_id IS NOT NULL OR s.status = 'active' THEN '{now}' ELSE s.last_seen END AS last_seen,
  CASE WHEN f.job_id IS NOT NULL THEN 'active' ELSE 'removed' END AS status,
  f.seq AS f_seq, f.title AS f_title, f.apply_url AS f_apply_url, f.location AS f_location,
  f.description AS f_description
FROM (SELECT * FROM {name}_ranked WHERE up = 1) f
JOIN (SELECT * FROM {name}_ranked WHERE down = 1) l ON f.job_id = l.job_id
FULL JOIN {state} s ON s.job_id = f.job_id"""
    return [(f"{name}_ranked", ranked), (name, rec)]


def new_jobs(rec: str = "rec", name: str = "new_jobs") -> tuple[str, str]:
    return name, f"""
SELECT f_seq AS seq, job_id, company, f_title AS title, f_apply_url AS apply_url,
  f_location AS location, posted_on, f_description AS description, role_type, source,
  first_seen, '' AS sponsorship, '' AS clearance, '' AS grad_year
FROM {rec} WHERE change = 'new'"""


def fresh(
    state: str, jobs: str = "new_jobs", name: str = "fresh", key: str | None = None
) -> tuple[str, str]:
    key_j, key_s = (key, key) if key else (fuzzy_key(), fuzzy_key())
    return name, f"""
SELECT * FROM (SELECT *, {key_j} AS fkey FROM {jobs}) j
WHERE NOT EXISTS (SELECT 1 FROM (SELECT {key_s} AS pkey FROM {state} WHERE status = 'active') p
                  WHERE p.pkey = j.fkey)"""


def flagged(jobs: str, text: str) -> list[tuple[str, str]]:
    """CTEs that end in ``flagged``: ``jobs`` with the flags of column ``text``."""
    return [
        ("cleaned", f"SELECT * EXCLUDE (sponsorship, clearance, grad_year), {flag_text(text)} AS t FROM {jobs}"),
        ("flagged", f"SELECT *, {sponsorship('t')} AS sponsorship, {clearance('t')} AS clearance, "
                    f"{grad_years('t')} AS grad_year FROM cleaned"),
    ]
