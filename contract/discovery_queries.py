"""Board harvest, registry growth and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import fragments as s
from contract.registry import add
from contract.source_queries import mixed_ctes
from jobloom.operators import boards as bo
from jobloom.operators import coverage as co
from jobloom.plans import discovery as di
from jobloom.schemas import BOARD_COLS, CANDIDATE_COLS
from jobloom.session import scratch, written
from jobloom.sources import harvest as ha
from jobloom.sources import payloads as pl
from jobloom.sources.registry import with_board_key
from jobloom.sources.registry_files import register

col = F.col
SYSTEMS = ", ".join(f"('{a}')" for a in bo.ATS)
CAND = ", ".join(CANDIDATE_COLS)
BOARD = ", ".join(BOARD_COLS)

# The harvest: web texts first, then the URL index.
FIRST_LINE = 1 << 40


def from_texts(v):
    return di.candidates(v.crawl_text_fx, "texts", "page_id")


def from_index(v):
    urls = ha.index_urls(v.url_lines_fx).withColumn("doc", col("line_no") + FIRST_LINE)
    return di.candidates(urls, "index", "doc", body="url")


def found(v):
    return bo.union_candidates([from_texts(v), from_index(v)])


def registry(v):
    return with_board_key(v.boards_fx)


VIEWS = "crawl_text_fx url_lines_fx boards_fx probes_fx"
FOUND = [
    ("harvest", f"""
SELECT 'texts' AS origin, page_id AS doc, body FROM crawl_text_fx
UNION ALL
SELECT 'index', line_no + {FIRST_LINE}, coalesce(json_extract_string(value, '$.url'), '')
FROM url_lines_fx WHERE json_valid(value)"""),
    *s.links("harvest", "doc"),
    ("found", """
SELECT ats, board_key, tenant, wd, site, slug, name,
  CASE WHEN doc >= 1099511627776 THEN 'index' ELSE 'texts' END AS origin, (doc::HUGEINT * 1000000000000::HUGEINT + pos)::DECIMAL(38,0) AS seq
FROM links"""),
    ("uniq", "SELECT * FROM found QUALIFY ROW_NUMBER() OVER (PARTITION BY ats, board_key ORDER BY seq) = 1"),
    ("registry", f"SELECT ats, {s.board_key()} AS board_key, tenant, wd, site, slug, name, ord FROM boards_fx"),
    ("todo", "SELECT * FROM uniq u WHERE NOT EXISTS (SELECT 1 FROM registry r "
             "WHERE r.ats = u.ats AND r.board_key = u.board_key)"),
    ("live", """
SELECT ats, board_key FROM probes_fx WHERE status = 200 AND CASE ats
  WHEN 'workday' THEN coalesce(json_array_length(body, '$.jobPostings'), 0) > 0
  WHEN 'greenhouse' THEN coalesce(json_array_length(body, '$.jobs'), 0) > 0
  WHEN 'ashby' THEN coalesce(json_array_length(body, '$.jobs'), 0) > 0
  WHEN 'lever' THEN json_type(body) = 'ARRAY' AND json_array_length(body) > 0
  WHEN 'smartrecruiters' THEN coalesce(CAST(json_extract_string(body, '$.totalFound') AS BIGINT), 0) <> 0
  ELSE coalesce(CAST(json_extract_string(body, '$.total') AS BIGINT), 0) <> 0 END"""),
    ("survivors", "SELECT * FROM todo t WHERE EXISTS (SELECT 1 FROM live l "
                  "WHERE l.ats = t.ats AND l.board_key = t.board_key)"),
    ("merged", f"""
SELECT {BOARD} FROM registry
UNION ALL
SELECT s.ats, board_key, tenant, wd, site, slug, name, coalesce(e.last, -1) + ROW_NUMBER() OVER (PARTITION BY s.ats ORDER BY seq, board_key)
FROM survivors s LEFT JOIN (SELECT ats, MAX(ord) AS last FROM registry GROUP BY ats) e ON e.ats = s.ats"""),
    ("both_sides", """
SELECT coalesce(u.ats, r.ats) AS ats, coalesce(u.board_key, r.board_key) AS board_key,
  u.tenant, u.wd, u.site, u.ats IS NOT NULL AS surfaced, r.ats IS NOT NULL AS validated
FROM uniq u FULL JOIN (SELECT DISTINCT ats, board_key FROM registry) r
  ON r.ats = u.ats AND r.board_key = u.board_key"""),
    ("funnel", f"""
SELECT n.ats, COUNT(*) FILTER (surfaced) AS surfaced, COUNT(*) FILTER (surfaced AND validated) AS validated,
  COUNT(*) FILTER (surfaced AND NOT validated) AS missing,
  CASE WHEN COUNT(*) FILTER (surfaced) > 0 THEN
    round_even(100.0 * COUNT(*) FILTER (surfaced AND validated) / COUNT(*) FILTER (surfaced), 1) ELSE 0.0 END AS pct
FROM (VALUES {SYSTEMS}) n(ats) LEFT JOIN both_sides b ON b.ats = n.ats GROUP BY n.ats"""),
    ("sampled", """
SELECT * FROM (SELECT ats, board, ROW_NUMBER() OVER (PARTITION BY ats ORDER BY board) AS place FROM (
  SELECT ats, CASE WHEN ats = 'workday' THEN '(''' || tenant || ''', ''' || wd || ''', ''' || site || ''')'
    ELSE board_key END AS board FROM both_sides WHERE surfaced AND NOT validated) q) p WHERE place <= 15"""),
]

add(
    "o2_union_candidates",
    lambda v: found(v),
    VIEWS, f"SELECT {CAND} FROM found", FOUND,
)
add(
    "a11_distinct_candidates",
    lambda v: bo.distinct_candidates(found(v)),
    VIEWS, f"SELECT {CAND} FROM uniq", FOUND,
)
add(
    "a4_candidate_counts",
    lambda v: co.entry_counts(found(v)),
    VIEWS,
    f"SELECT n.ats, COUNT(f.ats) AS entries, COUNT(DISTINCT f.board_key) AS unique_keys "
    f"FROM (VALUES {SYSTEMS}) n(ats) LEFT JOIN found f ON f.ats = n.ats GROUP BY n.ats",
    FOUND,
)
add(
    "a5_registry_counts",
    lambda v: co.entry_counts(registry(v).unionByName(registry(v))),
    "boards_fx",
    f"SELECT n.ats, COUNT(f.ats) AS entries, COUNT(DISTINCT f.board_key) AS unique_keys "
    f"FROM (VALUES {SYSTEMS}) n(ats) LEFT JOIN (SELECT ats, {s.board_key()} AS board_key FROM "
    "(SELECT * FROM boards_fx UNION ALL SELECT * FROM boards_fx) b) f ON f.ats = n.ats GROUP BY n.ats",
)
add(
    "f10_live_boards",
    lambda v: bo.live_probes(v.probes_fx).select("ats", "board_key"),
    VIEWS, "SELECT ats, board_key FROM live", FOUND,
)
add(
    "j4_validated",
    lambda v: bo.validated(bo.distinct_candidates(found(v)), v.probes_fx),
    VIEWS,
    f"SELECT {CAND} FROM uniq u WHERE EXISTS (SELECT 1 FROM live l WHERE l.ats = u.ats AND l.board_key = u.board_key)",
    FOUND,
)
add(
    "j5_not_registered",
    lambda v: bo.not_registered(bo.distinct_candidates(found(v)), registry(v)),
    VIEWS, f"SELECT {CAND} FROM todo", FOUND,
)
add(
    "j11_funnel_join",
    lambda v: co.funnel_keys(found(v), registry(v)).select(
        "ats", "board_key", "surfaced", "validated"
    ),
    VIEWS, "SELECT ats, board_key, surfaced, validated FROM both_sides", FOUND,
)
add(
    "o3_surfaced_and_registered",
    lambda v: co.registered(found(v), registry(v)),
    VIEWS, "SELECT ats, board_key FROM found INTERSECT SELECT ats, board_key FROM registry", FOUND,
)
add(
    "o4_surfaced_not_registered",
    lambda v: co.unregistered(found(v), registry(v)),
    VIEWS, "SELECT ats, board_key FROM found EXCEPT SELECT ats, board_key FROM registry", FOUND,
)
add(
    "a6_coverage_funnel",
    lambda v: co.funnel(co.funnel_keys(found(v), registry(v))),
    VIEWS, "SELECT ats, surfaced, validated, missing, pct FROM funnel", FOUND,
)
add(
    "t2_missing_sample",
    lambda v: co.missing_sample(co.funnel_keys(found(v), registry(v)), 15).withColumn(
        "place", col("place").cast("bigint")
    ),
    VIEWS, "SELECT ats, board, place FROM sampled", FOUND,
)
add(
    "u6_coverage_report",
    lambda v: co.report(found(v), registry(v), 15),
    VIEWS,
    f"""
SELECT f.ats, coalesce(r.entries, 0) AS entries, coalesce(r.unique_keys, 0) AS unique_keys, f.surfaced,
  f.validated, f.missing, f.pct, coalesce(m.missing_boards, '') AS missing_boards
FROM funnel f
LEFT JOIN (SELECT ats, COUNT(*) AS entries, COUNT(DISTINCT board_key) AS unique_keys FROM registry GROUP BY ats) r ON r.ats = f.ats
LEFT JOIN (SELECT ats, string_agg(board, '; ' ORDER BY place) AS missing_boards FROM sampled GROUP BY ats) m ON m.ats = f.ats""",
    FOUND,
)


def discovered(v):
    return di.discover(found(v), registry(v), v.probes_fx)


add(
    "a7_boards_added",
    lambda v: bo.added_counts(discovered(v).survivors),
    VIEWS,
    f"SELECT n.ats, COUNT(s.ats) AS added FROM (VALUES {SYSTEMS}) n(ats) "
    "LEFT JOIN survivors s ON s.ats = n.ats GROUP BY n.ats",
    FOUND,
)
add(
    "o6_registry_merge",
    lambda v: discovered(v).registry,
    VIEWS, f"SELECT {BOARD} FROM merged", FOUND,
)


def registry_round_trip(v):
    """The merged registry written as registry files and read back."""
    register(v.spark)
    path = scratch(v.spark, "registry-files")
    discovered(v).registry.write.format("board_registry").mode("overwrite").save(path)
    return v.spark.read.format("board_registry").load(path)


add(
    "u3_registry_sink",
    registry_round_trip,
    VIEWS, f"SELECT {BOARD} FROM merged", FOUND,
)
add(
    "g3_added_system",
    lambda v: bo.extract_boards(
        v.crawl_text_fx,
        among={
            "teamtailor": bo.Ats(
                "teamtailor",
                bo.slug_links("teamtailor", "example.", (r"([a-z0-9.-]+)\.example\.(?:com|net|org)",)),
                bo.listed("$.jobs"),
                (),
            )
        },
    ).select("page_id", F.col("pos").cast("bigint").alias("pos"), "ats", "slug"),
    "crawl_text_fx",
    r"""
SELECT page_id, unnest(range(len(m))) AS pos, 'teamtailor' AS ats, lower(unnest(m)) AS slug
FROM (SELECT page_id, regexp_extract_all(body, '(?i)([a-z0-9.-]+)\.example\.(?:com|net|org)', 1) AS m FROM crawl_text_fx) q""",
)


def crawl(v):
    """Index lines as (index, pattern) pairs, and what the pairs of a table find."""
    lines = v.url_lines_fx.withColumns({
        "index_name": F.concat(F.lit("CRAWL-"), (col("line_no") % 3).cast("string")),
        "pattern": F.concat(F.lit("pattern-"), (col("line_no") % 7).cast("string")),
    })
    pairs = lines.select("index_name", "pattern").distinct()

    def harvest(of_pairs):
        own = ha.index_urls(lines.join(of_pairs, ["index_name", "pattern"]))
        return di.candidates(own, "index", "line_no", body="url")

    return pairs, harvest


def resumed(v):
    """A crawl cut off after some pairs: the ledger keeps those pairs' candidates,
    and only the pending pairs' lines are read again."""
    pairs, harvest = crawl(v)
    path = scratch(v.spark, "ledger")
    done = pairs.where(col("pattern") < "pattern-4")
    ha.append_ledger(path, done, harvest(done))
    pending = ha.pending_pairs(pairs, ha.done_pairs(v.spark, path))
    ha.append_ledger(path, pending, harvest(pending))
    return ha.ledger_candidates(v.spark, path)


INDEX_LINKS = [
    ("index_lines", "SELECT line_no, coalesce(json_extract_string(value, '$.url'), '') AS body "
              "FROM url_lines_fx WHERE json_valid(value)"),
    *s.links("index_lines", "line_no"),
]
add(
    "u7_harvest_ledger",
    resumed,
    "url_lines_fx",
    f"SELECT ats, board_key, tenant, wd, site, slug, name, 'index' AS origin, (line_no::HUGEINT * 1000000000000::HUGEINT + pos)::DECIMAL(38,0) AS seq FROM links",
    INDEX_LINKS,
)


def crashed(v):
    """A crawl that died between its two writes, and one that died before its manifest row; then it ran again."""
    pairs, harvest = crawl(v)
    path = scratch(v.spark, "ledger")
    harvest(pairs.where(col("pattern") < "pattern-3")).write.parquet(f"{path}/found/attempt=died-early")
    harvest(pairs).write.parquet(f"{path}/found/attempt=died-late")
    pairs.write.parquet(f"{path}/done/attempt=died-late")
    for _ in range(2):  # the second time nothing is pending
        pending = ha.pending_pairs(pairs, ha.done_pairs(v.spark, path))
        ha.append_ledger(path, pending, harvest(pending))
    return co.entry_counts(ha.ledger_candidates(v.spark, path))


add(
    "u7_crashed_ledger",
    crashed,
    "url_lines_fx",
    f"SELECT a.ats, COUNT(l.board_key) AS entries, COUNT(DISTINCT l.board_key) AS unique_keys "
    f"FROM (VALUES {SYSTEMS}) a(ats) LEFT JOIN links l ON l.ats = a.ats GROUP BY a.ats",
    INDEX_LINKS,
)


PATTERNS = [(p, a.name) for a in bo.ATS.values() for p in a.crawl_patterns]


def patterned(v):
    """URL-index rows, each fetched under one of the crawl patterns."""
    names = F.array(*[F.lit(p) for p, _ in PATTERNS])
    urls = ha.index_urls(v.url_lines_fx)
    return urls.withColumn("pattern", F.get(names, (col("line_no") % len(PATTERNS)).cast("int")))


add(
    "s16_crawl_candidates",
    lambda v: di.crawl_candidates(patterned(v), "line_no"),
    "url_lines_fx",
    f"""
SELECT ats, board_key, tenant, wd, site, slug, name, 'index' AS origin,
  (line_no::HUGEINT * 1000000000000::HUGEINT + ROW_NUMBER() OVER (PARTITION BY line_no ORDER BY pos) - 1)::DECIMAL(38,0) AS seq
FROM links WHERE ats = list_extract([{', '.join(f"'{a}'" for _, a in PATTERNS)}], CAST(line_no % {len(PATTERNS)} + 1 AS INTEGER))""",
    [
        ("index_lines", "SELECT line_no, coalesce(json_extract_string(value, '$.url'), '') AS body "
                  "FROM url_lines_fx WHERE json_valid(value)"),
        *s.links("index_lines", "line_no"),
    ],
)


def registered_pages(v):
    """Probe bodies read as landed pages of the registered boards."""
    pages = v.probes_fx.withColumns({
        "term": F.lit(""), "term_ord": F.lit(0), "page_no": F.lit(0).cast("bigint"),
    })
    return pl.of_boards(pages, registry(v))


add(
    "s8_registered_pages",
    lambda v: registered_pages(v).select("ats", "board_key", "board", "board_ord", "name"),
    "boards_fx probes_fx",
    f"""
SELECT b.ats, b.board_key, coalesce(b.slug, b.board_key) AS board, b.ord AS board_ord, b.name
FROM (SELECT *, {s.board_key()} AS board_key FROM boards_fx) b
JOIN probes_fx p ON p.ats = b.ats AND p.board_key = b.board_key""",
)


def merged_batch(v):
    """The registry after a merge, and the postings on the pages of its boards, new ones too."""
    merged = di.discover(found(v), registry(v), v.probes_fx).registry
    pages = v.probes_fx.withColumns({
        "term": F.lit(""), "term_ord": F.lit(0), "page_no": F.lit(0).cast("bigint"),
    })
    return pl.read_boards(pl.of_boards(pages, merged)).select("ats", "board", "job_id", "seq")


add(
    "o6_batch_of_merged_registry",
    merged_batch,
    VIEWS,
    "SELECT ats, board, job_id, seq FROM batch",
    [
        *FOUND,
        ("merged_pages", """
SELECT m.ats, coalesce(m.slug, m.board_key) AS board, m.name, m.tenant, m.wd, m.site, '' AS term, 0 AS term_ord,
  m.ord AS board_ord, 0::BIGINT AS page_no, p.status, p.body
FROM merged m JOIN probes_fx p ON p.ats = m.ats AND p.board_key = m.board_key"""),
        *mixed_ctes("merged_pages"),
    ],
)


# --- all sources in one plan -------------------------------------------------


def harvested_whole(v):
    """Seeds, published texts, listings and a crawl that was cut off once and went on from its ledger."""
    lines = v.url_lines_fx.withColumns({
        "index_name": F.concat(F.lit("CRAWL-"), (col("line_no") % 3).cast("string")),
        "pattern": F.concat(F.lit("pattern-"), (col("line_no") % 7).cast("string")),
    })
    seeds = v.seeds_fx.withColumn("line_no", F.regexp_extract("value", "seed([0-9]+)", 1).cast("bigint"))
    ledger = scratch(v.spark, "ledger")
    di.harvest(index=lines.where(col("pattern") < "pattern-4"), ledger=ledger)
    lists = v.crawl_text_fx.withColumnRenamed("page_id", "doc_id")
    return written(di.harvest(seeds, lists, v.listings_fx, lines, ledger), "candidates")


URLS = ("job_url_direct", "job_url", "apply_url")
WHOLE_VIEWS = VIEWS + " seeds_fx listings_fx"
WHOLE = [
    ("harvest", f"""
SELECT CAST(regexp_extract(value, 'seed([0-9]+)', 1) AS BIGINT) AS doc, value AS body FROM seeds_fx WHERE NOT starts_with(ltrim(value), '#')
UNION ALL SELECT page_id + {di.ROOM}, body FROM crawl_text_fx
""" + "".join(f"UNION ALL SELECT seq * 3 + {i} + {2 * di.ROOM}, {c} FROM listings_fx WHERE {c} IS NOT NULL\n" for i, c in enumerate(URLS)) + f"""
UNION ALL SELECT line_no + {3 * di.ROOM}, coalesce(json_extract_string(value, '$.url'), '') FROM url_lines_fx WHERE json_valid(value)"""),
    *s.links("harvest", "doc"),
    ("found", f"""
SELECT ats, board_key, tenant, wd, site, slug, name,
  CASE doc // {di.ROOM} WHEN 0 THEN 'seeds' WHEN 1 THEN 'lists' WHEN 2 THEN 'listings' ELSE 'index' END AS origin,
  (doc::HUGEINT * 1000000000000::HUGEINT + pos)::DECIMAL(38,0) AS seq
FROM links"""),
    *FOUND[FOUND.index(next(x for x in FOUND if x[0] == "uniq")):],
]
add(
    "discover_all_sources",
    lambda v: di.discover(harvested_whole(v), registry(v), v.probes_fx).survivors.select(*CANDIDATE_COLS),
    WHOLE_VIEWS, f"SELECT {CAND} FROM survivors", WHOLE,
)
add(
    "u6_coverage_all_sources",
    lambda v: co.report(harvested_whole(v), registry(v), 15),
    WHOLE_VIEWS,
    """
SELECT f.ats, coalesce(r.entries, 0) AS entries, coalesce(r.unique_keys, 0) AS unique_keys, f.surfaced,
  f.validated, f.missing, f.pct, coalesce(m.missing_boards, '') AS missing_boards
FROM funnel f
LEFT JOIN (SELECT ats, COUNT(*) AS entries, COUNT(DISTINCT board_key) AS unique_keys FROM registry GROUP BY ats) r ON r.ats = f.ats
LEFT JOIN (SELECT ats, string_agg(board, '; ' ORDER BY place) AS missing_boards FROM sampled GROUP BY ats) m ON m.ats = f.ats""",
    WHOLE,
)
