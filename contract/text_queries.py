"""Column functions (X) and the row predicates (F3-F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import fragments as s
from contract.registry import add
from jobloom.functions import flags as fl
from jobloom.functions import keys as ke
from jobloom.functions import roles as ro
from jobloom.functions import text as tx
from jobloom.operators import boards as bo
from jobloom.operators.dedupe import with_key
from jobloom.sources.registry import with_board_key

col = F.col

add(
    "x1_tokens",
    lambda v: v.documents.select(
        "doc_id",
        F.size(tx.tokens(col("text"))).alias("n_tokens"),
        F.md5(F.array_join(tx.tokens(col("text")), " ")).alias("tokens_md5"),
    ),
    sql=f"""
SELECT doc_id, CAST(CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END AS INTEGER) AS n_tokens,
       md5(w) AS tokens_md5
FROM (SELECT doc_id, {s.words('text')} AS w FROM documents) q""",
)
add(
    "x2_fuzzy_key",
    lambda v: with_key(v.postings_fx).select("seq", "fuzzy_key"),
    "postings_fx",
    f"SELECT seq, {s.fuzzy_key()} AS fuzzy_key FROM postings_fx",
)

add(
    "x3_surrogate_id",
    lambda v: v.listings_fx.select(
        "seq", ke.surrogate_id(col("scanned_site"), tx.text(col("job_url"))).alias("job_id")
    ),
    "listings_fx",
    "SELECT seq, scanned_site || '_' || substr(sha1(coalesce(job_url, '')), 1, 12) AS job_id "
    "FROM listings_fx",
)
add(
    "x4_keyword_role",
    lambda v: v.postings_fx.select("seq", ro.keyword_role(col("title")).alias("label")),
    "postings_fx",
    f"SELECT seq, {s.keyword_role()} AS label FROM postings_fx",
)
add(
    "x4_keyword_role_documents",
    lambda v: v.documents.select("doc_id", ro.keyword_role(col("text")).alias("label")),
    sql=f"SELECT doc_id, {s.keyword_role('text')} AS label FROM documents",
)
add(
    "x5_role",
    lambda v: v.postings_fx.select("seq", ro.role(col("title")).alias("role_type")),
    "postings_fx",
    f"SELECT seq, {s.role()} AS role_type FROM postings_fx",
)

# The entities that occur in the pages, longest names first and '&' last.
ENTITIES = (("&middot;?", "·"), ("&copy;?", "©"), ("&quot;?", '"'), ("&amp;?", "&"))
unescaped = "html"
for entity, char in ENTITIES:
    unescaped = f"regexp_replace({unescaped}, '{entity}', '{char}', 'g')"
add(
    "x6_html_text",
    lambda v: v.pages.select(
        "page_id", F.md5(tx.strip_html(col("html"))).alias("text_md5")
    ),
    sql=f"SELECT page_id, md5({s.strip_tags(unescaped)}) AS text_md5 FROM pages",
)
add(
    "x7_flag_text",
    lambda v: v.documents.select("doc_id", F.md5(tx.flag_text(col("text"))).alias("text_md5")),
    sql=f"SELECT doc_id, md5({s.flag_text('text')}) AS text_md5 FROM documents",
)

FLAG_SQL = {
    "x8_sponsorship": ("sponsorship", s.sponsorship("t")),
    "x9_clearance": ("clearance", s.clearance("t")),
    "x10_grad_years": ("grad_year", s.grad_years("t")),
}
for name, (flag, expr) in FLAG_SQL.items():
    add(
        name,
        lambda v, flag=flag: fl.with_flags(v.postings_fx, "description").select("seq", flag),
        "postings_fx",
        f"SELECT seq, {expr} AS {flag} "
        f"FROM (SELECT seq, {s.flag_text('description')} AS t FROM postings_fx) q",
    )
    add(
        f"{name}_documents",
        lambda v, flag=flag: fl.with_flags(v.documents, "text").select("doc_id", flag),
        sql=f"SELECT doc_id, {expr} AS {flag} "
        f"FROM (SELECT doc_id, {s.flag_text('text')} AS t FROM documents) q",
    )

LINK_COLS = "pos, rule, ats, board_key, tenant, wd, site, slug, name"
LINKS = [c.strip() for c in LINK_COLS.split(",")]


def link_rows(texts, doc, body="body"):
    found = bo.extract_boards(texts.select(doc, body), body)
    return found.withColumn("pos", col("pos").cast("bigint")).select(doc, *LINKS)


add(
    "x11_board_links",
    lambda v: link_rows(v.crawl_text_fx, "page_id"),
    "crawl_text_fx",
    f"SELECT page_id, {LINK_COLS} FROM links",
    s.links("crawl_text_fx", "page_id"),
)

PATH = r"regexp_extract(apply_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
DETAIL_KEY = rf"""(CASE source
  WHEN 'workday' THEN CASE WHEN regexp_matches({PATH}, '^/[^/]+/.+') THEN
    lower(regexp_extract(apply_url, '^https?://([^/?#]+)', 1)) || '/wday/cxs/' ||
    lower(regexp_extract(apply_url, '^https?://([^./?#]+)', 1)) || {PATH} END
  WHEN 'greenhouse' THEN nullif(regexp_extract(apply_url, 'greenhouse\.io/([A-Za-z0-9_-]+/jobs/\d+)', 1), '')
  WHEN 'lever' THEN nullif(regexp_extract({PATH}, '^/([^/]+/[^/]+)', 1), '')
  WHEN 'ashby' THEN regexp_extract({PATH}, '^/([^/]+)', 1) || '/' || regexp_replace(job_id, '^ash_', '')
END)"""
add(
    "x12_detail_key",
    lambda v: v.jobs_fx.select(
        "seq", ke.detail_key(col("source"), col("job_id"), col("apply_url")).alias("detail_key")
    ),
    "jobs_fx",
    f"SELECT seq, {DETAIL_KEY} AS detail_key FROM jobs_fx",
)
add(
    "x14_slug_cleanup",
    lambda v: link_rows(v.url_lines_fx, "line_no", "value")
    .where(col("ats") == "ashby")
    .select("line_no", "slug", "name"),
    "url_lines_fx",
    r"""
SELECT line_no, slug, url_decode(slug) AS name FROM (
  SELECT line_no, regexp_replace(regexp_extract(value, 'jobs\.ashbyhq\.com/([A-Za-z0-9_.%-]+)', 1), '[.]+$', '') AS slug
  FROM url_lines_fx) q WHERE slug <> ''""",
)
add(
    "x15_board_key",
    lambda v: with_board_key(v.boards_fx).select("ord", "ats", "board_key"),
    "boards_fx",
    f"SELECT ord, ats, {s.board_key()} AS board_key FROM boards_fx",
)
add(
    "x17_strip",
    lambda v: v.listings_fx.select(
        "seq", *[tx.strip(col(c)).alias(c) for c in ("site", "job_url", "title")]
    ),
    "listings_fx",
    f"SELECT seq, {s.strip('site')} AS site, {s.strip('job_url')} AS job_url, "
    f"{s.strip('title')} AS title FROM listings_fx",
)

add(
    "f3_announce_role",
    lambda v: v.postings_fx.withColumn("role_type", ro.role(col("title")))
    .where(ro.announceable(col("role_type")))
    .select("seq", "role_type"),
    "postings_fx",
    f"SELECT seq, {s.role()} AS role_type FROM postings_fx WHERE {s.announceable(s.role())}",
)
add(
    "f4_us_location",
    lambda v: v.postings_fx.select("seq", ro.in_us(col("location")).alias("in_us")),
    "postings_fx",
    f"SELECT seq, {s.in_us()} AS in_us FROM postings_fx",
)
add(
    "f6_bad_tokens",
    lambda v: link_rows(v.bad_links_fx, "doc_id"),
    "bad_links_fx",
    f"SELECT doc_id, {LINK_COLS} FROM links",
    s.links("bad_links_fx", "doc_id"),
)
add(
    "t4_sorted_tokens",
    lambda v: v.documents.select(
        "doc_id", F.md5(tx.title_part(col("text"))).alias("sorted_md5")
    ),
    sql=f"SELECT doc_id, md5(array_to_string(list_sort(string_split({s.words('text')}, ' ')), ' ')) "
    "AS sorted_md5 FROM documents",
)
