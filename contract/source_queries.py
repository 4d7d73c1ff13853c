"""Scans (S), page sequences (P), normalizers (N) and their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import fragments as s
from contract.registry import add
from jobloom.functions.keys import batch_seq
from jobloom.operators import boards as bo
from jobloom.operators.dedupe import first_per_key
from jobloom.schemas import POSTING_COLS
from jobloom.settings import Settings
from jobloom.sources import aggregator as ag
from jobloom.sources import harvest as ha
from jobloom.sources import payloads as pl
from jobloom.sources import registry as rg
from jobloom.sources.registry_files import register
from jobloom.session import scratch

col = F.col
POSTING = ", ".join(POSTING_COLS)

PAGED = {"workday": "wd_pages_fx", "smartrecruiters": "sr_pages_fx", "workable": "wk_pages_fx"}
LIST_PATH = {
    "workday": "$.jobPostings", "greenhouse": "$.jobs", "lever": "$", "ashby": "$.jobs",
    "smartrecruiters": "$.content", "workable": "$.results",
}
RANK = {a: i for i, a in enumerate(LIST_PATH)}


def valid(body: str = "body") -> str:
    return f"CASE WHEN json_valid({body}) THEN CAST({body} AS JSON) END"


def batch_order(source, board, term, page, pos) -> str:
    """Decimal digits: 1 for the source, 13 for the board, 4, 10 and 10 for the rest."""
    return (
        f"((((({source}::HUGEINT * 10000000000000::HUGEINT + {board}) * 10000::HUGEINT + {term}) "
        f"* 10000000000::HUGEINT + {page}) * 10000000000::HUGEINT) + {pos})::DECIMAL(38,0)"
    )


def usable_ctes(view: str, ats: str) -> list[tuple[str, str]]:
    """``ok``: pages of one system that answered 200 with JSON, with their items."""
    return [
        ("docs", f"SELECT * EXCLUDE (body), {valid()} AS doc FROM {view} WHERE ats = '{ats}'"),
        ("sized", f"""
SELECT *, status = 200 AND doc IS NOT NULL AS ok,
  CAST(coalesce(json_array_length(doc, '{LIST_PATH[ats]}'), 0) AS BIGINT) AS items FROM docs"""),
    ]


def kept_ctes(view: str, ats: str) -> list[tuple[str, str]]:
    """``pages_kept``: the pages the system's stop rule lets through."""
    ctes = usable_ctes(view, ats)
    if ats == "workday":
        ctes += [
            ("ruled", """
SELECT *, NOT ok OR items = 0 AS failed,
  (page_no + 1) * 20 >= coalesce(CAST(json_extract_string(doc, '$.total') AS BIGINT), 0) AS last
FROM sized"""),
        ]
        group = "board, term"
    elif ats == "smartrecruiters":
        ctes += [
            ("ruled", """
SELECT *, NOT ok AS failed, items = 0 OR
  SUM(items) OVER (PARTITION BY board ORDER BY page_no) >=
    coalesce(CAST(json_extract_string(doc, '$.totalFound') AS BIGINT), 0) AS last
FROM sized"""),
        ]
        group = "board"
    elif ats == "workable":
        ctes += [
            ("counted", """
SELECT *, len(list_filter(json_extract_string(doc, '$.results[*].shortcode'), lambda x: x <> '')) AS codes
FROM sized"""),
            ("ruled", """
SELECT *, NOT ok AS failed, items = 0 OR coalesce(json_extract_string(doc, '$.nextPage'), '') = '' OR
  coalesce(SUM(codes) OVER (PARTITION BY board ORDER BY page_no), 0) >=
    coalesce(CAST(json_extract_string(doc, '$.total') AS BIGINT), 0) AS last
FROM counted"""),
        ]
        group = "board"
    else:
        return ctes + [("pages_kept", "SELECT * FROM sized WHERE ok")]
    ctes.append(("pages_kept", f"""
SELECT * FROM ruled r WHERE NOT failed AND NOT EXISTS (
  SELECT 1 FROM ruled e WHERE {' AND '.join(f'e.{g} = r.{g}' for g in group.split(', '))}
  AND e.page_no < r.page_no AND (e.failed OR e.last))"""))
    return ctes


def item_ctes(view: str, ats: str) -> list[tuple[str, str]]:
    """``items``: one row per item ``p`` of the kept pages, with pos and seq."""
    path = LIST_PATH[ats]
    return kept_ctes(view, ats) + [
        ("exploded", f"""
SELECT *, unnest(range(items)) AS pos,
  unnest(CAST(json_extract(doc, '{path}') AS JSON[])) AS p
FROM pages_kept WHERE items > 0"""),
        ("items", f"""
SELECT *, {batch_order(RANK[ats], 'board_ord', 'term_ord', 'page_no', 'pos')} AS seq
FROM exploded"""),
    ]


def j(path: str) -> str:
    return f"json_extract_string(p, '{path}')"


def t(path: str) -> str:
    return f"coalesce({j(path)}, '')"


def joined(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), ', ')"


LOC = "$.location"
COLUMNS = {
    "workday": {
        "job_id": (
            f"(CASE WHEN {t('$.bulletFields[0]')} <> '' THEN {s.strip(j('$.bulletFields[0]'))} "
            f"WHEN contains({t('$.externalPath')}, '_') THEN {s.strip(f"split_part({t('$.externalPath')}, '_', -1)")} "
            "ELSE '' END)"
        ),
        "title": s.strip(j("$.title")),
        "apply_url": f"'https://' || tenant || '.' || wd || '.myworkdayjobs.com/' || site || {t('$.externalPath')}",
        "location": s.strip(j("$.locationsText")),
        "posted_on": s.strip(j("$.postedOn")),
    },
    "greenhouse": {
        "job_id": f"(CASE WHEN {t('$.id')} NOT IN ('', '0') THEN 'gh_' || {j('$.id')} ELSE '' END)",
        "title": s.strip(j("$.title")),
        "apply_url": t("$.absolute_url"),
        "location": s.strip(j("$.location.name")),
        "posted_on": f"substr({t('$.updated_at')}, 1, 10)",
    },
    "lever": {
        "job_id": f"(CASE WHEN {s.strip(j('$.id'))} <> '' THEN 'lv_' || {s.strip(j('$.id'))} ELSE '' END)",
        "title": s.strip(j("$.text")),
        "apply_url": t("$.hostedUrl"),
        "location": s.strip(f"coalesce({j('$.categories.allLocations[0]')}, {j('$.categories.location')})"),
        "posted_on": (
            f"(CASE WHEN coalesce(CAST({j('$.createdAt')} AS BIGINT), 0) <> 0 THEN "
            f"strftime(epoch_ms(CAST({j('$.createdAt')} AS BIGINT)), '%Y-%m-%d') ELSE '' END)"
        ),
    },
    "ashby": {
        "job_id": f"(CASE WHEN {t('$.id')} <> '' THEN 'ash_' || {j('$.id')} ELSE '' END)",
        "title": s.strip(j("$.title")),
        "apply_url": f"coalesce(nullif({j('$.jobUrl')}, ''), 'https://jobs.ashbyhq.com/' || board || '/' || {j('$.id')})",
        "location": s.strip(j("$.location")),
        "posted_on": f"substr({t('$.publishedAt')}, 1, 10)",
    },
    "smartrecruiters": {
        "job_id": f"(CASE WHEN {t('$.id')} <> '' THEN 'sr_' || {j('$.id')} ELSE '' END)",
        "title": s.strip(j("$.name")),
        "apply_url": f"'https://jobs.smartrecruiters.com/' || board || '/' || {j('$.id')}",
        "location": joined(t(LOC + ".city"), t(LOC + ".region"), f"upper({t(LOC + '.country')})"),
        "posted_on": f"substr({t('$.releasedDate')}, 1, 10)",
    },
    "workable": {
        "job_id": f"(CASE WHEN {t('$.shortcode')} <> '' THEN 'wk_' || {j('$.shortcode')} ELSE '' END)",
        "title": s.strip(j("$.title")),
        "apply_url": f"'https://apply.workable.com/' || board || '/j/' || {j('$.shortcode')} || '/'",
        "location": (
            f"(CASE WHEN {t(LOC + '.display')} <> '' THEN {s.strip(j(LOC + '.display'))} ELSE "
            f"{joined(t(LOC + '.city'), t(LOC + '.region'), t(LOC + '.country'))} END)"
        ),
        "posted_on": f"substr({t('$.published')}, 1, 10)",
    },
}


def posting_ctes(view: str, ats: str) -> list[tuple[str, str]]:
    """``postings``: POSTING rows of one system (with board)."""
    cols = ", ".join(f"{expr} AS {name}" for name, expr in COLUMNS[ats].items())
    ctes = item_ctes(view, ats) + [
        ("mapped", f"SELECT seq, board, name AS company, '{ats}' AS source, '' AS description, {cols} FROM items"),
    ]
    first = ""
    if ats == "workday":
        first = " QUALIFY ROW_NUMBER() OVER (PARTITION BY board, job_id ORDER BY seq) = 1"
    return ctes + [("postings", f"SELECT * FROM mapped WHERE job_id <> ''{first}")]


READ_VIEW = {a: PAGED.get(a, "payloads_fx") for a in LIST_PATH}
SCAN_ID = {
    "workday": ("externalPath", "title"), "greenhouse": ("id", "title"), "lever": ("id", "text"),
    "ashby": ("id", "title"), "smartrecruiters": ("id", "name"), "workable": ("shortcode", "title"),
}


def landed_view(v, name, ats):
    """Paged systems are read from landed pages, the others in one go."""
    pages = getattr(v, name)
    return pl.landed(pages) if ats in PAGED else pages


for number, ats in enumerate(LIST_PATH, 1):
    raw_id, raw_title = SCAN_ID[ats]
    add(
        f"s{number}_{ats}_scan",
        lambda v, ats=ats, a=raw_id, b=raw_title: pl.scan(landed_view(v, READ_VIEW[ats], ats), ats).select(
            "board", "page_no", col("pos").cast("bigint").alias("pos"), "seq",
            col(f"p.{a}").alias("raw_id"), col(f"p.{b}").alias("raw_title"),
        ),
        READ_VIEW[ats],
        f"SELECT board, page_no, pos, seq, {j('$.' + raw_id)} AS raw_id, "
        f"{j('$.' + raw_title)} AS raw_title FROM items",
        item_ctes(READ_VIEW[ats], ats),
    )
    add(
        f"n{number}_{ats}_postings",
        lambda v, ats=ats: pl.READERS[ats](v.payloads_fx, Settings()).select(*POSTING_COLS),
        "payloads_fx",
        f"SELECT {POSTING} FROM postings",
        posting_ctes("payloads_fx", ats),
    )

for number, (ats, pages) in enumerate(PAGED.items(), 1):
    add(
        f"p{number}_{ats}_pages",
        lambda v, ats=ats, pages=pages: pl.kept_pages(landed_view(v, pages, ats), ats).select(
            "board", "term", "page_no"
        ),
        pages,
        "SELECT board, term, page_no FROM pages_kept",
        kept_ctes(pages, ats),
    )


def all_kept(v):
    return pl.union_all([
        pl.paging.usable(
            v.payloads_fx.where(col("ats") == a).withColumn("doc", pl.parse(a, col("body")))
        ).select("ats", "board", "page_no")
        for a in LIST_PATH
    ])


add(
    "p4_usable_pages",
    all_kept,
    "payloads_fx",
    "SELECT ats, board, page_no FROM payloads_fx WHERE status = 200 AND json_valid(body)",
)

# --- the unified batch -------------------------------------------------------


def mixed_pages(v):
    """Single-page payloads and the three paged sets as one table of landed pages."""
    return pl.union_all([v.payloads_fx, v.wd_pages_fx, v.sr_pages_fx, v.wk_pages_fx])


MIXED = "payloads_fx wd_pages_fx sr_pages_fx wk_pages_fx"


def mixed_ctes(views: str = MIXED) -> list[tuple[str, str]]:
    """``batch``: postings of all systems over the mixed pages, with ats and board."""
    ctes = [("mixed", " UNION ALL ".join(
        f"SELECT * FROM (SELECT ats, board, name, tenant, wd, site, term, term_ord, board_ord, "
        f"page_no, status, body FROM {x})" for x in views.split()))]
    for ats in LIST_PATH:
        own = posting_ctes("mixed", ats)
        names = [n for n, _ in own]
        for n, sql in own:
            for other in names:
                sql = replace_name(sql, other, f"{ats}_{other}")
            ctes.append((f"{ats}_{n}", sql))
    arms = " UNION ALL ".join(
        f"SELECT '{a}' AS ats, board, {POSTING} FROM {a}_postings" for a in LIST_PATH
    )
    return ctes + [("batch", arms)]


def replace_name(sql: str, name: str, new: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {new}", sql)


# --- aggregator listings -----------------------------------------------------


def cell(x: str) -> str:
    y = s.strip(x)
    return f"(CASE WHEN lower({y}) IN ('nan', 'nat', 'none') THEN '' ELSE {y} END)"


LISTING_CTES = [
    ("located", f"""
SELECT *, coalesce(nullif({cell('job_url')}, ''), {cell('apply_url')}) AS url,
  coalesce(nullif({cell('site')}, ''), scanned_site) AS src FROM listings_fx"""),
    ("listed", f"""
SELECT seq, src || '_' || substr(sha1(url), 1, 12) AS job_id, {cell('company')} AS company,
  {cell('title')} AS title, url AS apply_url, {cell('location')} AS location,
  {cell('date_posted')} AS posted_on, src AS source, {cell('description')} AS description
FROM located WHERE url <> ''"""),
    ("listings", "SELECT * FROM listed QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq) = 1"),
]
add(
    "s7_aggregator_scan",
    lambda v: ag.read_listings(v.listings_fx),
    "listings_fx", f"SELECT {POSTING} FROM listings", LISTING_CTES,
)
add(
    "n7_aggregator_postings",
    lambda v: ag.normalize(v.listings_fx),
    "listings_fx", f"SELECT {POSTING} FROM listed", LISTING_CTES,
)
add(
    "a10_first_per_id",
    lambda v: first_per_key(v.postings_fx, ["job_id"]),
    "postings_fx",
    f"SELECT {POSTING} FROM postings_fx QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq) = 1",
)

UNIFIED = (
    f"SELECT {POSTING} FROM batch UNION ALL SELECT {POSTING} FROM "
    "(SELECT * REPLACE ((60000000000000000000000000000000000000::HUGEINT + seq)::DECIMAL(38,0) AS seq) FROM listings)"
)
add(
    "n8_unified_batch",
    lambda v: pl.unified_batch(pl.landed(mixed_pages(v)), ag.read_listings(v.listings_fx)),
    MIXED + " listings_fx", UNIFIED, mixed_ctes() + LISTING_CTES,
)
add(
    "o1_union_sources",
    lambda v: pl.unified_batch(pl.landed(mixed_pages(v)), ag.read_listings(v.listings_fx))
    .groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")),
    MIXED + " listings_fx",
    f"SELECT source, COUNT(*) AS n, MIN(seq) AS first_seq FROM ({UNIFIED}) u GROUP BY source",
    mixed_ctes() + LISTING_CTES,
)
add(
    "a2_board_counts",
    lambda v: pl.board_counts(pl.read_boards(mixed_pages(v))),
    MIXED,
    "SELECT ats, board, COUNT(*) AS postings FROM batch GROUP BY ats, board",
    mixed_ctes(),
)
add(
    "a2_ats_counts",
    lambda v: pl.ats_counts(pl.read_boards(mixed_pages(v))),
    MIXED,
    "SELECT n.ats, COUNT(b.ats) AS postings FROM (VALUES "
    + ", ".join(f"('{a}')" for a in LIST_PATH)
    + ") n(ats) LEFT JOIN batch b ON b.ats = n.ats GROUP BY n.ats",
    mixed_ctes(),
)
add(
    "n9_display_name",
    lambda v: v.boards_fx.select(
        "ord", pl.display_name(col("name"), col("tenant"), col("slug")).alias("shown")
    ),
    "boards_fx",
    "SELECT ord, coalesce(nullif(name, ''), nullif(tenant, ''), nullif(slug, ''), '?') AS shown "
    "FROM boards_fx",
)


def kept_and_dropped(v):
    """Items and postings per system: what the id rule drops."""
    pages = v.payloads_fx
    items = pl.union_all([
        pl.scan(pages, a).select(F.lit(a).alias("ats"), F.lit(0).alias("kept")) for a in LIST_PATH
    ])
    kept = pl.read_boards(pages).select("ats", F.lit(1).alias("kept"))
    return items.unionByName(kept).groupBy("ats").agg(
        F.count_if(col("kept") == 0).alias("items"), F.count_if(col("kept") == 1).alias("kept")
    )


def f7_ctes() -> list[tuple[str, str]]:
    out = []
    for ats in LIST_PATH:
        own = posting_ctes("payloads_fx", ats)
        names = [n for n, _ in own]
        for n, sql in own:
            for other in names:
                sql = replace_name(sql, other, f"{ats}_{other}")
            out.append((f"{ats}_{n}", sql))
    return out


add(
    "f7_rows_without_id",
    kept_and_dropped,
    "payloads_fx",
    " UNION ALL ".join(
        f"SELECT '{a}' AS ats, (SELECT COUNT(*) FROM {a}_items) AS items, "
        f"(SELECT COUNT(*) FROM {a}_postings) AS kept" for a in LIST_PATH
    ),
    f7_ctes(),
)
add(
    "f8_source_filters",
    lambda v: ag.source_filters(v.listings_fx, "1998-06-01T02:00:00+02:00", 24 * 365).select(
        "seq", "scanned_site", "term"
    ),
    "listings_fx",
    f"""
SELECT seq, scanned_site, term FROM listings_fx
WHERE try_cast({cell('date_posted')} AS TIMESTAMP) IS NULL
   OR try_cast({cell('date_posted')} AS TIMESTAMP) >= TIMESTAMP '1997-06-01 00:00:00'""",
)
add(
    "t3_page_caps",
    lambda v: pl.kept_pages(v.wd_pages_fx, "workday", Settings(max_pages_per_term=2)).select(
        "board", "term", "page_no"
    ),
    "wd_pages_fx",
    "SELECT board, term, page_no FROM pages_kept WHERE page_no < 2",
    kept_ctes("wd_pages_fx", "workday"),
)
add(
    "w3_running_offsets",
    lambda v: pl.running_offsets(v.sr_pages_fx).select("board", "page_no", "rows_so_far"),
    "sr_pages_fx",
    "SELECT board, page_no, CAST(SUM(items) OVER (PARTITION BY board ORDER BY page_no) AS BIGINT) "
    "AS rows_so_far FROM sized",
    usable_ctes("sr_pages_fx", "smartrecruiters"),
)

# --- registry and harvest text -----------------------------------------------



def registry_files(v):
    """The registry read from files, after a first version was replaced by a second."""
    register(v.spark)
    path = scratch(v.spark, "registry-files")
    boards = rg.with_board_key(v.boards_fx)
    for version in (boards.where("ats = 'lever'"), boards):
        version.write.format("board_registry").mode("overwrite").save(path)
    return v.spark.read.format("board_registry").load(path)


add(
    "s8_registry",
    registry_files,
    "boards_fx",
    f"SELECT ats, {s.board_key()} AS board_key, tenant, wd, site, slug, name, ord FROM boards_fx",
)
add(
    "f9_system_subset",
    lambda v: rg.of_systems(rg.with_board_key(v.boards_fx), ["Greenhouse", "ashby "]),
    "boards_fx",
    f"SELECT ats, {s.board_key()} AS board_key, tenant, wd, site, slug, name, ord FROM boards_fx "
    "WHERE ats IN ('greenhouse', 'ashby')",
)


def seeds_from_files(v):
    path = scratch(v.spark, "seeds")
    v.seeds_fx.write.text(path)
    return ha.read_seeds(v.spark, path)


add(
    "s10_seed_lines",
    seeds_from_files,
    "seeds_fx",
    r"SELECT value FROM seeds_fx WHERE NOT starts_with(ltrim(value), '#')",
)


def files_read_whole(v):
    """Texts written as files, read back one row per file, and their links."""
    path = scratch(v.spark, "texts")
    v.crawl_text_fx.select("body").write.text(path, lineSep="\n\n")
    texts = ha.read_texts(v.spark, path)
    return bo.extract_boards(texts).groupBy("ats", "board_key").agg(F.count(F.lit(1)).alias("n"))


add(
    "s12_whole_texts",
    files_read_whole,
    "crawl_text_fx",
    "SELECT ats, board_key, COUNT(*) AS n FROM links GROUP BY ats, board_key",
    s.links("crawl_text_fx", "page_id"),
)
add(
    "s13_listing_urls",
    lambda v: ag.listing_urls(v.listings_fx).withColumnRenamed("column", "col_name"),
    "listings_fx",
    " UNION ALL ".join(
        f"SELECT seq, '{c}' AS col_name, {c} AS url FROM listings_fx WHERE {c} IS NOT NULL"
        for c in ag.URL_COLS
    ),
)
add(
    "s14_index_urls",
    lambda v: ha.index_urls(v.url_lines_fx).select("line_no", "url"),
    "url_lines_fx",
    "SELECT line_no, coalesce(json_extract_string(value, '$.url'), '') AS url FROM url_lines_fx "
    "WHERE json_valid(value)",
)


def crawl_plan(v):
    pairs = v.crawl_pairs_fx
    newest = ha.newest_indexes(pairs.select("index_name", "list_ord").distinct())
    return ha.pages_to_fetch(pairs.join(newest, ["index_name", "list_ord"]))


add(
    "s15_crawl_plan",
    crawl_plan,
    "crawl_pairs_fx",
    """
SELECT index_name, pattern, CAST(unnest(range(num_pages)) AS INTEGER) AS page
FROM crawl_pairs_fx""",
)
add(
    "s16_pending_pairs",
    lambda v: ha.pending_pairs(
        v.crawl_pairs_fx, v.crawl_pairs_fx.where(col("num_pages") > 85)
    ).select("index_name", "pattern"),
    "crawl_pairs_fx",
    "SELECT index_name, pattern FROM crawl_pairs_fx WHERE num_pages <= 85",
)
add(
    "x_batch_order",
    lambda v: v.wd_pages_fx.select(
        "board", "term", "page_no",
        batch_seq(F.lit(0), col("board_ord"), col("term_ord"), col("page_no"), F.lit(0)).alias("seq"),
    ),
    "wd_pages_fx",
    f"SELECT board, term, page_no, {batch_order(0, 'board_ord', 'term_ord', 'page_no', 0)} AS seq "
    "FROM wd_pages_fx",
)
