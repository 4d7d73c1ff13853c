"""Dedupe, reconciliation, suppression, enrichment and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import fragments as s
from contract.registry import NOW, add
from contract.source_queries import LISTING_CTES, MIXED, UNIFIED, mixed_ctes, mixed_pages
from contract.text_queries import DETAIL_KEY
from jobloom.functions import flags as fl
from jobloom.functions import roles as ro
from jobloom.operators import dedupe as de
from jobloom.operators import enrich as en
from jobloom.operators import publish as pu
from jobloom.operators import reconcile as rc
from jobloom.operators import scoring as sc
from jobloom.operators.ranking import global_row_number
from jobloom.plans import hourly
from jobloom.schemas import STATE_COLS
from jobloom.session import scratch, written
from jobloom.settings import Settings
from jobloom.sources import details as dt
from jobloom.sources.labels import LabelStore, title_hash

col = F.col
STATE = ", ".join(STATE_COLS)
FLAGS = list(rc.FLAGS)
BOTH = "postings_fx prior_jobs_fx"
REC = s.deduped() + s.reconciled("kept", "prior_jobs_fx", NOW)
FRESH = REC + [s.new_jobs(), s.fresh("prior_jobs_fx")]


def reconciled(v):
    return rc.reconcile(de.cross_source_dedupe(v.postings_fx), v.prior_jobs_fx, NOW)


def fresh(v):
    new_jobs = written(rc.new_jobs(reconciled(v)), "new_jobs")
    return rc.without_relistings(new_jobs, rc.active_keys(v.prior_jobs_fx))


ANNOUNCE = f"role_type IN ('intern', 'new_grad') AND {s.in_us()}"
add(
    "flagship_new_announceable_jobs",
    lambda v: hourly.announceable_jobs(v.postings_fx, v.prior_jobs_fx, NOW).select(
        "seq", "job_id", "company", "title", "location", "role_type", "source", "first_seen"
    ),
    BOTH,
    "SELECT seq, job_id, company, title, location, role_type, source, first_seen "
    f"FROM fresh WHERE {ANNOUNCE}",
    FRESH,
)

# --- a whole run from landed pages -------------------------------------------


def landed_run(v):
    """Boards and pages of the mixed payloads, and the listings, to the run's new jobs."""
    mixed = mixed_pages(v)
    boards = mixed.select(
        "ats", col("board").alias("board_key"), "tenant", "wd", "site",
        F.lit(None).cast("string").alias("slug"), "name", col("board_ord").alias("ord"),
    ).distinct()
    pages = mixed.select(
        "ats", col("board").alias("board_key"), "term", "term_ord", "page_no", "status", "body"
    )
    every = Settings(hours_old=24 * 366 * 60)
    return hourly.run_landed(boards, pages, v.listings_fx, v.prior_jobs_fx, NOW, settings=every)


RUN_COLS = ["kind", "place", "job_id", "title", "role_type", "source", "first_seen", *rc.FLAGS]


def published(v):
    """A whole run: its new jobs with their flags, the messages with their cards' titles, and the sheet's rows."""
    out = landed_run(v)
    none = {c: F.lit(None).cast("string") for c in RUN_COLS}
    jobs = out.fresh.withColumns({"kind": F.lit("job"), "place": col("seq").cast("string")}).select(*RUN_COLS)
    titles = F.array_join(F.transform("cards", lambda c: c["title"]), "|")
    cards = out.messages.select(*[
        {**none, "kind": F.lit("message"), "place": col("message_no").cast("string"), "title": titles}[c].alias(c) for c in RUN_COLS])
    sheet = out.sheet_rows.select(*[
        {**none, "kind": F.lit("sheet"), **{x: col(x) for x in ("job_id", "title", "role_type", *rc.FLAGS)}}[c].alias(c) for c in RUN_COLS])
    return jobs.unionByName(cards).unionByName(sheet)


RUN_FLAGS = ", ".join(f"coalesce(f.{x}, '') AS {x}" for x in rc.FLAGS)
add(
    "run_landed_pages",
    published,
    MIXED + " listings_fx prior_jobs_fx",
    f"""
SELECT 'job' AS kind, seq::VARCHAR AS place, job_id, title, role_type, source, first_seen, {", ".join(rc.FLAGS)} FROM done
UNION ALL
SELECT 'message', ((pos - 1) // 10)::VARCHAR, NULL, string_agg(title, '|' ORDER BY pos), NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY seq) AS pos FROM done WHERE {ANNOUNCE}) q GROUP BY (pos - 1) // 10
UNION ALL
SELECT 'sheet', NULL, coalesce(job_id, ''), coalesce(title, ''), role_type, NULL, NULL, {", ".join(rc.FLAGS)} FROM done""",
    mixed_ctes() + LISTING_CTES + [("whole", UNIFIED)] + s.deduped("whole")
    + s.reconciled("kept", "prior_jobs_fx", NOW) + [s.new_jobs(), s.fresh("prior_jobs_fx")]
    + s.flagged(f"(SELECT * FROM fresh WHERE {s.announceable('role_type')}) f", "description")
    + [("done", f"SELECT r.* EXCLUDE ({', '.join(rc.FLAGS)}), {RUN_FLAGS} FROM fresh r LEFT JOIN flagged f ON f.job_id = r.job_id")],
)

# --- dedupe ------------------------------------------------------------------

add(
    "w1_cross_source_dedupe",
    lambda v: de.cross_source_marked(v.postings_fx).select("seq", "fuzzy_key", "dropped"),
    "postings_fx",
    "SELECT seq, fkey AS fuzzy_key, coalesce(dropped, false) AS dropped FROM marked",
    s.deduped(),
)
add(
    "w2_first_and_last",
    lambda v: rc.batch_by_id(v.postings_fx).select(
        "job_id", "n", col("first.seq").alias("first_seq"), col("first.title").alias("first_title"),
        col("first.location").alias("first_location"), col("last.title").alias("last_title"),
        col("last.apply_url").alias("last_url"), col("last.location").alias("last_location"),
    ),
    "postings_fx",
    """
SELECT job_id, COUNT(*) AS n, MIN(seq) AS first_seq, arg_min_null(title, seq) AS first_title,
  arg_min_null(location, seq) AS first_location, arg_max_null(title, seq) AS last_title,
  arg_max_null(apply_url, seq) AS last_url, arg_max_null(location, seq) AS last_location
FROM postings_fx GROUP BY job_id""",
)
add(
    "w4_chunks",
    lambda v: global_row_number(v.postings_fx.select("seq"), "seq", "pos").select(
        "seq", "pos", F.floor((col("pos") - 1) / 10).alias("message_no")
    ),
    "postings_fx",
    "SELECT seq, pos, (pos - 1) // 10 AS message_no "
    "FROM (SELECT seq, ROW_NUMBER() OVER (ORDER BY seq) AS pos FROM postings_fx) q",
)

# --- state -------------------------------------------------------------------

add(
    "s9_known_ids",
    lambda v: rc.known_ids(v.prior_jobs_fx).join(
        v.prior_jobs_fx.select("job_id", (col("status") == "active").alias("is_active")), "job_id"
    ),
    BOTH,
    "SELECT job_id, status = 'active' AS is_active FROM prior_jobs_fx",
)
add(
    "s9_active_keys",
    lambda v: rc.active_keys(v.prior_jobs_fx).distinct(),
    BOTH,
    f"SELECT DISTINCT {s.fuzzy_key()} AS fuzzy_key FROM prior_jobs_fx "
    f"WHERE status = 'active' AND {s.fuzzy_key()} IS NOT NULL",
)
add(
    "s11_upgraded_state",
    lambda v: rc.upgrade_state(v.prior_jobs_fx.drop("source", "sponsorship", "grad_year")),
    BOTH,
    "SELECT job_id, company, title, apply_url, location, role_type, posted_on, 'workday' AS source, "
    "'' AS sponsorship, clearance, '' AS grad_year, first_seen, last_seen, status FROM prior_jobs_fx",
)
add(
    "f1_never_seen",
    lambda v: rc.unseen(v.postings_fx, v.prior_jobs_fx).select("seq", "job_id"),
    BOTH,
    "SELECT seq, job_id FROM postings_fx WHERE job_id NOT IN (SELECT job_id FROM prior_jobs_fx)",
)
add(
    "j1_anti_join_ids",
    lambda v: rc.unseen(v.postings_fx, v.prior_jobs_fx)
    .groupBy("job_id").agg(F.count(F.lit(1)).alias("n")),
    BOTH,
    "SELECT job_id, COUNT(*) AS n FROM postings_fx p WHERE NOT EXISTS "
    "(SELECT 1 FROM prior_jobs_fx s WHERE s.job_id = p.job_id) GROUP BY job_id",
)
add(
    "f2_fresh_jobs",
    lambda v: fresh(v).select("seq", "job_id", "company", "title", "location"),
    BOTH, "SELECT seq, job_id, company, title, location FROM fresh", FRESH,
)
add(
    "j2_anti_join_keys",
    lambda v: rc.without_relistings(
        v.postings_fx.drop("description"), rc.active_keys(v.prior_jobs_fx), spread="seq", keep=written
    ).select("seq"),
    BOTH,
    "SELECT seq FROM fresh",
    [s.fresh("prior_jobs_fx", jobs="postings_fx")],
)
add(
    "j3_reconcile_changes",
    lambda v: reconciled(v).select("job_id", "change", "n"),
    BOTH, "SELECT job_id, change, n FROM rec", REC,
)
add(
    "o5_active_minus_seen",
    lambda v: reconciled(v).where(col("change") == "removed").select("job_id", "last_seen"),
    BOTH,
    f"SELECT job_id, '{NOW}' AS last_seen FROM prior_jobs_fx WHERE status = 'active' "
    "AND job_id NOT IN (SELECT job_id FROM kept)",
    s.deduped(),
)
add(
    "u1_next_state",
    lambda v: rc.next_state(reconciled(v)),
    BOTH, f"SELECT {STATE} FROM rec", REC,
)
NEW_COLS = [
    "seq", "job_id", "company", "title", "apply_url", "location", "posted_on", "role_type",
    "source", "first_seen",
]
add(
    "u1_new_jobs",
    lambda v: rc.new_jobs(reconciled(v)).select(*NEW_COLS, "description"),
    BOTH, f"SELECT {', '.join(NEW_COLS)}, description FROM new_jobs", REC + [s.new_jobs()],
)
COUNTS = """
SELECT COUNT(*) FILTER (change = 'new') AS new_jobs,
  CAST(coalesce(SUM(CASE change WHEN 'new' THEN n - 1 WHEN 'updated' THEN n END), 0) AS BIGINT) AS updated,
  COUNT(*) FILTER (change = 'removed') AS removed
FROM rec"""
add("u1_change_counts", lambda v: rc.change_counts(reconciled(v)), BOTH, COUNTS, REC)
add(
    "x16_run_timestamp",
    lambda v: rc.next_state(reconciled(v)).groupBy("first_seen", "last_seen").agg(
        F.count(F.lit(1)).alias("n")
    ),
    BOTH,
    "SELECT first_seen, last_seen, COUNT(*) AS n FROM rec GROUP BY first_seen, last_seen",
    REC,
)
add(
    "g1_injected_role",
    lambda v: rc.next_state(
        rc.reconcile(
            v.postings_fx, v.prior_jobs_fx, NOW,
            role_for=lambda title: F.when(F.length(title) > 20, "senior").otherwise("intern"),
        )
    ).select("job_id", "role_type"),
    BOTH,
    "SELECT job_id, role_type FROM rec",
    s.reconciled(
        "postings_fx", "prior_jobs_fx", NOW,
        role_sql="(CASE WHEN length(l.title) > 20 THEN 'senior' ELSE 'intern' END)",
    ),
)
add(
    "g2_injected_key",
    lambda v: rc.without_relistings(
        v.postings_fx,
        rc.active_keys(v.prior_jobs_fx, key_fn=lambda c, t, l: F.concat_ws("#", c, l)),
        spread="seq",
        key_fn=lambda c, t, l: F.concat_ws("#", c, l),
    ).select("seq"),
    BOTH,
    "SELECT seq FROM fresh",
    [s.fresh("prior_jobs_fx", jobs="postings_fx", key="concat_ws('#', company, location)")],
)

# --- scorer ------------------------------------------------------------------


LABEL = "CASE length(title) % 5 WHEN 0 THEN 'intern' WHEN 1 THEN 'new_grad' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' END"


def stub():
    """A stand-in for a model: picks a label by the length of the title.

    It is made here, so that workers get it by value.
    """
    def factory():
        return lambda titles, texts: [(list(texts) + ["?"])[len(t) % 5] for t in titles]

    return factory


def said(v):
    return v.conversations.select(
        col("text").alias("title"), (col("conv_id") * 1000 + col("turn")).alias("seq")
    )


SAID = ("said", "SELECT text AS title, conv_id * 1000 + turn AS seq FROM conversations")
add(
    "a8_ambiguous_titles",
    lambda v: sc.ambiguous_titles(said(v)),
    "",
    f"SELECT DISTINCT title FROM said WHERE {s.keyword_role()} IS NULL",
    [SAID],
)
add(
    "g4_scored_titles",
    lambda v: sc.score_titles(sc.ambiguous_titles(said(v)), stub()),
    "",
    f"SELECT DISTINCT title, {LABEL} AS label FROM said WHERE {s.keyword_role()} IS NULL",
    [SAID],
)
add(
    "g4_scored_roles",
    lambda v: sc.join_labels(said(v), sc.score_titles(sc.ambiguous_titles(said(v)), stub())).select(
        "seq", ro.role(col("title"), col("label")).alias("role_type")
    ),
    "",
    f"SELECT seq, coalesce({s.keyword_role()}, {LABEL}, 'mid') AS role_type FROM said",
    [SAID],
)


def label_runs(v):
    """Two runs over one label store: the second scores only titles that the first did not have."""
    store = LabelStore(v.spark, scratch(v.spark, "labels"), "stub-1")
    store.labelled(sc.ambiguous_titles(said(v).where("seq % 2 = 0")), stub(), "run 1")
    titles = sc.ambiguous_titles(said(v))
    store.labelled(titles, stub(), "run 2")
    return titles.withColumn("title_hash", title_hash(col("title"))).join(store.read(), "title_hash").select("title", "label", "run")


add(
    "g4_label_store",
    label_runs,
    "",
    f"SELECT title, {LABEL} AS label, CASE WHEN bool_or(seq % 2 = 0) THEN 'run 1' ELSE 'run 2' END AS run "
    f"FROM said WHERE {s.keyword_role()} IS NULL AND {LABEL} IS NOT NULL GROUP BY title",
    [SAID],
)
add(
    "j6_label_join",
    lambda v: sc.join_labels(
        v.postings_fx, v.title_labels_fx.where(ro.keyword_role(col("title")).isNull())
    ).select("seq", ro.role(col("title"), col("label")).alias("role_type")),
    "title_labels_fx",
    f"SELECT seq, coalesce({s.keyword_role('p.title')}, l.label, 'mid') AS role_type "
    "FROM postings_fx p JOIN title_labels_fx l ON l.title = p.title",
)

add(
    "g4_scored_state",
    lambda v: rc.next_state(
        rc.with_scored_roles(
            written(reconciled(v), "reconciled"),
            v.title_labels_fx.select("title", "label"),
        )
    ).select("job_id", "role_type"),
    BOTH + " title_labels_fx",
    f"SELECT job_id, CASE WHEN change = 'new' AND {s.keyword_role()} IS NULL THEN coalesce("
    "(SELECT label FROM title_labels_fx t WHERE t.title = rec.title), 'mid') ELSE role_type END "
    "AS role_type FROM rec",
    REC,
)

# --- enrichment --------------------------------------------------------------


def enriched(v):
    """Jobs enriched from the details and boards landed up to NOW."""
    return en.enrich(plain_jobs(v), v.detail_versions_fx, boards=v.ashby_boards_fx, as_of=NOW)


TEXT = s.strip_tags("coalesce({}, '')")
ASHBY = ("ashby", """
SELECT slug || '/' || json_extract_string(p, '$.id') AS detail_key,
  coalesce(json_extract_string(p, '$.descriptionPlain'), '') AS plain,
  coalesce(json_extract_string(p, '$.descriptionHtml'), '') AS html
FROM (SELECT slug, unnest(CAST(json_extract(body, '$.jobs') AS JSON[])) AS p
      FROM ashby_boards_fx WHERE status = 200) q
WHERE json_extract_string(p, '$.id') IS NOT NULL""")
DETAILED = [
    ("newest_details", f"""
SELECT source, detail_key, body FROM detail_versions_fx WHERE status = 200 AND landed <= '{NOW}'
QUALIFY ROW_NUMBER() OVER (PARTITION BY source, detail_key ORDER BY landed DESC) = 1"""),
    ("keyed_jobs", f"SELECT *, {DETAIL_KEY} AS detail_key FROM jobs_fx"),
    ASHBY,
    ("detailed", f"""
SELECT k.*, d.body, a.plain, a.html FROM keyed_jobs k
LEFT JOIN newest_details d ON d.source = k.source AND d.detail_key = k.detail_key
LEFT JOIN ashby a ON k.source = 'ashby' AND a.detail_key = k.detail_key"""),
    ("described", f"""
SELECT * EXCLUDE (landed, body, plain, html), CASE
  WHEN description <> '' THEN description
  WHEN source = 'workday' THEN {TEXT.format("json_extract_string(body, '$.jobPostingInfo.jobDescription')")}
  WHEN source = 'greenhouse' THEN {TEXT.format("json_extract_string(body, '$.content')")}
  WHEN source = 'ashby' THEN coalesce(nullif(plain, ''), {TEXT.format("html")})
  WHEN source = 'lever' THEN array_to_string(list_filter(list_concat(
    [coalesce(json_extract_string(body, '$.descriptionPlain'), ''), coalesce(json_extract_string(body, '$.additionalPlain'), '')],
    coalesce(list_transform(json_extract_string(body, '$.lists[*].content'), lambda x: {TEXT.format("x")}), [])),
    lambda y: y <> ''), chr(10))
  ELSE '' END AS full_description FROM detailed"""),
]
JOBS = "jobs_fx detail_versions_fx ashby_boards_fx"


def plain_jobs(v):
    return v.jobs_fx.drop("landed")


def looked_up(v):
    keyed = en.with_detail_key(plain_jobs(v))
    counts = dt.key_counts(keyed)
    return dt.with_newest(keyed, dt.versions(v.detail_versions_fx, v.ashby_boards_fx, counts), NOW, counts=counts)


add(
    "j7_detail_lookup",
    lambda v: looked_up(v).select(
        "seq", "detail_key", F.when(col("source") == "ashby", col("plain")).otherwise(col("body")).alias("body"),
    ),
    JOBS,
    "SELECT seq, detail_key, CASE WHEN source = 'ashby' THEN plain ELSE body END AS body FROM detailed",
    DETAILED,
)


def wanted_board_jobs(v):
    wanted = en.with_detail_key(plain_jobs(v)).where("source = 'ashby' AND detail_key IS NOT NULL").select("detail_key").distinct()
    return dt.board_jobs(v.ashby_boards_fx, wanted).join(wanted, "detail_key", "left_semi")


add(
    "j8_ashby_lookup",
    lambda v: wanted_board_jobs(v).select(
        "detail_key", F.coalesce("plain", F.lit("")).alias("plain"), F.coalesce("html", F.lit("")).alias("html"),
    ),
    "jobs_fx detail_versions_fx ashby_boards_fx",
    "SELECT detail_key, plain, html FROM ashby WHERE detail_key IN (SELECT detail_key FROM keyed_jobs WHERE source = 'ashby')",
    DETAILED[:3],
)
add(
    "x13_descriptions",
    lambda v: enriched(v).select("seq", "full_description"),
    JOBS, "SELECT seq, full_description FROM described", DETAILED,
)
ENRICHED = DETAILED + [
    ("cleaned", f"SELECT *, {s.flag_text('full_description')} AS t FROM described"),
    ("flagged", f"SELECT *, {s.sponsorship('t')} AS sponsorship, {s.clearance('t')} AS clearance, "
                f"{s.grad_years('t')} AS grad_year FROM cleaned"),
]
add(
    "x13_enriched_flags",
    lambda v: enriched(v).select("seq", *FLAGS),
    JOBS, f"SELECT seq, {', '.join(FLAGS)} FROM flagged", ENRICHED,
)
add(
    "a3_flag_counts",
    lambda v: en.flag_counts(enriched(v)),
    JOBS,
    "SELECT " + ", ".join(f"COUNT(*) FILTER ({f} <> '') AS {f}" for f in FLAGS) + " FROM flagged",
    ENRICHED,
)
add(
    "f5_without_no_sponsorship",
    lambda v: en.without_no_sponsorship(enriched(v)).select(
        "seq", "sponsorship"
    ),
    JOBS, "SELECT seq, sponsorship FROM flagged WHERE sponsorship <> 'no'", ENRICHED,
)


def enriched_state(v):
    rec = written(reconciled(v), "reconciled")
    left = rc.without_relistings(rc.new_jobs(rec), rc.active_keys(v.prior_jobs_fx))
    flagged = fl.with_flags(en.targets(left).drop(*FLAGS), "description")
    return rc.flagged_state(rec, flagged)


FRESH_FLAGS = FRESH + s.flagged(f"(SELECT * FROM fresh WHERE {s.announceable('role_type')}) f", "description")
add(
    "j9_flag_write_back",
    lambda v: rc.merge_flags(
        v.prior_jobs_fx, fl.with_flags(de.first_per_key(v.postings_fx, ["job_id"]), "description")
    ).select("job_id", *FLAGS),
    BOTH,
    "SELECT p.job_id, " + ", ".join(f"coalesce(f.{x}, p.{x}) AS {x}" for x in FLAGS)
    + " FROM prior_jobs_fx p LEFT JOIN flagged f ON f.job_id = p.job_id",
    s.flagged(
        "(SELECT *, '' AS sponsorship, '' AS clearance, '' AS grad_year FROM postings_fx "
        "QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq) = 1) f",
        "description",
    ),
)
add(
    "u2_enriched_state",
    enriched_state,
    BOTH,
    f"SELECT {', '.join('r.' + c if c not in FLAGS else f'coalesce(f.{c}, r.{c}) AS {c}' for c in STATE_COLS)} "
    "FROM rec r LEFT JOIN flagged f ON f.job_id = r.job_id",
    FRESH_FLAGS,
)

# --- counters and publishing -------------------------------------------------


def run_counters(v):
    marked = written(de.cross_source_marked(v.postings_fx), "batch")
    rec = written(rc.reconcile(marked.where(~col("dropped")), v.prior_jobs_fx, NOW), "reconciled")
    left = written(
        rc.without_relistings(rc.new_jobs(rec), rc.active_keys(v.prior_jobs_fx)), "fresh"
    )
    flagged = fl.with_flags(left.drop(*FLAGS), "description")
    told = flagged.where(~ro.announceable(col("role_type")) | (col("sponsorship") != "no"))
    return hourly.counters(marked, rec, left, told)


add(
    "a1_run_counters",
    run_counters,
    BOTH,
    f"""
SELECT (SELECT COUNT(*) FROM postings_fx) AS total,
  (SELECT COUNT(*) FROM marked WHERE dropped) AS cross_dropped, c.*,
  c.new_jobs - (SELECT COUNT(*) FROM fresh) AS suppressed,
  (SELECT COUNT(*) FROM flagged WHERE sponsorship = 'no') AS excluded
FROM ({COUNTS}) c""",
    FRESH_FLAGS,
)
add(
    "a9_announce_counts",
    lambda v: pu.announce_counts(fresh(v)),
    BOTH,
    f"SELECT COUNT(*) FILTER ({ANNOUNCE}) AS posted, COUNT(*) FILTER (NOT ({ANNOUNCE})) AS filtered_out "
    "FROM fresh",
    FRESH,
)
add(
    "n10_sheet_rows",
    lambda v: pu.sheet_rows(fresh(v)),
    BOTH,
    "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in pu.SHEET_COLS) + " FROM fresh",
    FRESH,
)

CARD = f"""
SELECT seq, title, apply_url AS url,
  CASE role_type WHEN 'intern' THEN {0x2ECC71} WHEN 'new_grad' THEN {0x3498DB}
    WHEN 'mid' THEN {0xF1C40F} WHEN 'senior' THEN {0xE74C3C} ELSE {0x95A5A6} END AS color,
  array_to_string(list_filter([
    'Company=' || coalesce(nullif(company, ''), '—'), 'Role=' || role_type,
    'Location=' || coalesce(nullif(location, ''), '—'), 'Posted=' || nullif(posted_on, ''),
    'Sponsorship=' || CASE sponsorship WHEN 'no' THEN '❌ Not offered' WHEN 'yes' THEN '✅ Offered' END,
    CASE WHEN clearance <> '' THEN 'Clearance=🔒 Required' END,
    'Grad year=' || nullif(grad_year, '')], lambda x: x IS NOT NULL), '; ') AS fields
FROM {{jobs}}"""


def fields_text(fields):
    return F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit("="), f["value"])), "; ")


def flagged_postings(v):
    roled = v.postings_fx.withColumn("role_type", ro.role(col("title")))
    return fl.with_flags(roled, "description")


FLAGGED_POSTINGS = s.flagged(
    f"(SELECT *, {s.role()} AS role_type, '' AS sponsorship, '' AS clearance, '' AS grad_year FROM postings_fx) p",
    "description",
)
add(
    "n11_cards",
    lambda v: flagged_postings(v).select("seq", pu.card().alias("c")).select(
        "seq", "c.title", "c.url", "c.color", fields_text(col("c.fields")).alias("fields")
    ),
    "postings_fx", CARD.format(jobs="flagged"), FLAGGED_POSTINGS,
)
add(
    "u4_messages",
    lambda v: pu.messages(flagged_postings(v)).select(
        "message_no",
        F.size("cards").cast("bigint").alias("n_cards"),
        F.array_join(F.transform("cards", lambda c: F.concat_ws("~", c["title"], c["url"])), "|").alias("cards"),
        F.array_join(F.transform("cards", lambda c: fields_text(c["fields"])), "|").alias("fields"),
    ),
    "postings_fx",
    """
SELECT message_no, COUNT(*) AS n_cards, string_agg(title || '~' || url, '|' ORDER BY pos) AS cards,
  string_agg(fields, '|' ORDER BY pos) AS fields
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY seq) AS pos, (ROW_NUMBER() OVER (ORDER BY seq) - 1) // 10 AS message_no FROM cards) q
GROUP BY message_no""",
    FLAGGED_POSTINGS + [
        ("told", f"SELECT * FROM flagged WHERE {ANNOUNCE}"),
        ("cards", CARD.format(jobs="told")),
    ],
)
SHEETS = "sheet_fx sheet_payload_fx"
APPENDED = [
    ("appended", """
SELECT * FROM sheet_payload_fx p WHERE coalesce(p.job_id, '') = ''
  OR NOT EXISTS (SELECT 1 FROM sheet_fx s WHERE s.job_id = p.job_id)"""),
]
SHEET_COLS = ", ".join(pu.SHEET_COLS)
RANK = (
    "CASE role_type WHEN 'intern' THEN 0 WHEN 'new_grad' THEN 1 WHEN 'mid' THEN 2 "
    "WHEN 'senior' THEN 3 ELSE 99 END"
)
add(
    "j10_sheet_append",
    lambda v: pu.sheet_append(v.sheet_fx, v.sheet_payload_fx).select("append_seq", *pu.SHEET_COLS),
    SHEETS, f"SELECT append_seq, {SHEET_COLS} FROM appended", APPENDED,
)
add(
    "t1_sheet_order",
    lambda v: pu.sheet_positions(v.sheet_payload_fx).select(
        "append_seq", "first_seen", "role_type", ro.role_rank(col("role_type")).alias("role_rank"),
        "position",
    ),
    SHEETS,
    f"SELECT append_seq, first_seen, role_type, {RANK} AS role_rank, "
    f"ROW_NUMBER() OVER (ORDER BY {RANK}, first_seen DESC, append_seq) AS position FROM sheet_payload_fx",
)
add(
    "u5_sheet",
    lambda v: pu.sheet_positions(
        v.sheet_fx.unionByName(pu.sheet_append(v.sheet_fx, v.sheet_payload_fx))
    ).select("append_seq", "position", *pu.SHEET_COLS),
    SHEETS,
    f"SELECT append_seq, {SHEET_COLS}, ROW_NUMBER() OVER (ORDER BY {RANK}, first_seen DESC, append_seq) AS position "
    f"FROM (SELECT append_seq, {SHEET_COLS} FROM sheet_fx UNION ALL SELECT append_seq, {SHEET_COLS} FROM appended) u",
    APPENDED,
)


def message_files(v):
    """Titles on the lines that the message sink wrote, read back as text."""
    path = scratch(v.spark, "messages")
    pu.write_messages(pu.messages(flagged_postings(v)), path)
    embeds = F.from_json("value", "struct<embeds:array<struct<title:string, url:string>>>")["embeds"]
    return v.spark.read.text(path).select(F.explode(embeds).alias("e")).select("e.title", "e.url")


add(
    "u4_message_files",
    message_files,
    "postings_fx",
    "SELECT title, url FROM cards",
    FLAGGED_POSTINGS + [
        ("told", f"SELECT * FROM flagged WHERE {ANNOUNCE}"),
        ("cards", CARD.format(jobs="told")),
    ],
)


def sheet_files(v):
    """The sheet as the CSV sink wrote it, read back; empty cells are empty texts."""
    path = scratch(v.spark, "sheet")
    pu.write_sheet(v.sheet_fx.unionByName(pu.sheet_append(v.sheet_fx, v.sheet_payload_fx)), path)
    rows = v.spark.read.options(**pu.SHEET_FORMAT).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "role_type", "apply_url", "job_id")])


add(
    "u5_sheet_files",
    sheet_files,
    SHEETS,
    "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("title", "role_type", "apply_url", "job_id"))
    + " FROM (SELECT * FROM sheet_fx UNION ALL SELECT * FROM appended) u",
    APPENDED,
)
