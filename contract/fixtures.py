"""Input views over the given tables; the same SQL runs in Spark and DuckDB.

``FIXTURES.md`` tells what each view stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.session import folder_bytes, stored

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (tuple(needs.split()), sql.strip())


_view("postings_fx", "orders", """
WITH titles(ti, title) AS (VALUES
 (0,'Software Engineer Intern'),(1,'Intern, Software Engineer'),(2,'New Grad Software Engineer'),
 (3,'Senior Data Engineer'),(4,'Software Engineer II'),(5,'Software Engineer III'),
 (6,'Manager, Campus Recruiting'),(7,'Data Analyst'),(8,'Associate Developer'),
 (9,'Summer Analyst - Risk'),(10,'Sr. Platform Engineer'),(11,'Backend Engineer, 10+ years'),
 (12,'Backend Engineer, 5+ years'),(13,'Software Interns (Summer)'),(14,'Lead, Internship Programs'),(15,'   ')),
locs(li, location) AS (VALUES
 (0,'Austin, TX'),(1,'San Francisco, CA'),(2,'San Francisco, California, US'),(3,'Indianapolis, Indiana'),
 (4,'Milwaukee, WI'),(5,'London, United Kingdom'),(6,''),(7,'Remote'),(8,'Toronto, Canada'),(9,'Santa Fe, New Mexico'),(10,CAST(NULL AS STRING))),
srcs(si, source, pfx) AS (VALUES
 (0,'workday',''),(1,'greenhouse','gh_'),(2,'lever','lv_'),(3,'ashby','ash_'),
 (4,'smartrecruiters','sr_'),(5,'workable','wk_'),(6,'indeed','indeed_')),
sfx(xi, suffix) AS (VALUES (0,''),(1,', Inc.'),(2,' LLC'),(3,' Co., Ltd.')),
descs(di, description) AS (VALUES
 (0,'We are unable to provide visa sponsorship.'),(1,'Visa sponsorship available. Graduating in 2026 or 2027.'),
 (2,'Active TS/SCI clearance required.'),(3,'No security clearance needed.'),
 (4,'Students, science and math.'),(5,''),(6,'Founded 2025. Class of 2026'),(7,'Must be a U.S. citizen'),
 (8,'Technology roles with security clearance'))
SELECT o.o_orderkey AS seq,
       s.pfx || CAST(o.o_orderkey % 197 AS STRING) AS job_id,
       'Customer ' || CAST(o.o_custkey % 100 AS STRING) || x.suffix AS company,
       t.title AS title,
       'https://example.org/' || s.source || '/' || CAST(o.o_orderkey % 197 AS STRING) AS apply_url,
       l.location AS location,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS posted_on,
       s.source AS source,
       d.description AS description
FROM orders o
JOIN srcs s ON s.si = o.o_orderkey % 7
JOIN titles t ON t.ti = CAST(FLOOR(o.o_orderkey / 7) AS BIGINT) % 16
JOIN locs l ON l.li = CAST(FLOOR(o.o_orderkey / 3) AS BIGINT) % 11
JOIN sfx x ON x.xi = CAST(FLOOR(o.o_orderkey / 5) AS BIGINT) % 4
JOIN descs d ON d.di = o.o_orderkey % 9
""")

_view("prior_jobs_fx", "postings_fx customer", """
SELECT job_id, company, title, apply_url, location,
       CASE WHEN seq % 2 = 0 THEN 'mid' ELSE 'intern' END AS role_type,
       posted_on, source, '' AS sponsorship, '' AS clearance, '' AS grad_year,
       '2026-01-01T00:00:00+00:00' AS first_seen, '2026-01-02T00:00:00+00:00' AS last_seen,
       CASE WHEN seq % 4 = 0 THEN 'removed' ELSE 'active' END AS status
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM postings_fx WHERE substr(job_id, length(job_id), 1) IN ('1','4','7')) q WHERE rn = 1
UNION ALL
SELECT 'gone_' || CAST(c_custkey AS STRING), 'Customer ' || CAST(c_custkey % 100 AS STRING), 'Data Analyst', 'https://example.org/gone', 'Austin, TX',
       'mid', '', 'workday', '', '', '', '2026-01-01T00:00:00+00:00', '2026-01-02T00:00:00+00:00',
       CASE WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'active' END
FROM customer WHERE c_custkey % 10 < 6
""")

# One posting per order, ids of their own, real-looking addresses per source.
_view("jobs_fx", "postings_fx", """
SELECT seq,
       CASE source WHEN 'ashby' THEN 'ash_' ELSE '' END || 'j' || CAST(seq AS STRING) AS job_id,
       company, title,
       CASE source
         WHEN 'workday' THEN 'https://Acme.wd5.myworkdayjobs.com/Careers/job/Austin/Intern_R' || CAST(seq AS STRING) || '?src=x'
         WHEN 'greenhouse' THEN CASE WHEN seq % 5 = 0 THEN 'https://acme.example/jobs?gh=' || CAST(seq AS STRING)
                                     ELSE 'https://job-boards.greenhouse.io/acme/jobs/' || CAST(seq AS STRING) END
         WHEN 'lever' THEN CASE WHEN seq % 5 = 0 THEN 'https://jobs.lever.co/acme' ELSE 'https://jobs.lever.co/acme/u' || CAST(seq AS STRING) || '/apply' END
         WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/acme' || CAST(seq % 7 AS STRING) || '/j' || CAST(seq AS STRING)
         ELSE apply_url END AS apply_url,
       location, posted_on, source,
       CASE WHEN source IN ('indeed','smartrecruiters') THEN description ELSE '' END AS description,
       description AS landed
FROM postings_fx
""")

_view("details_fx", "jobs_fx", """
SELECT source,
       CASE source
         WHEN 'workday' THEN 'acme.wd5.myworkdayjobs.com/wday/cxs/acme/Careers/job/Austin/Intern_R' || CAST(seq AS STRING)
         WHEN 'greenhouse' THEN 'acme/jobs/' || CAST(seq AS STRING)
         ELSE 'acme/u' || CAST(seq AS STRING) END AS detail_key,
       CASE WHEN seq % 17 = 0 THEN 500 ELSE 200 END AS status,
       CASE source
         WHEN 'workday' THEN '{"jobPostingInfo":{"jobDescription":"<p>' || landed || '</p><br/>"}}'
         WHEN 'greenhouse' THEN '{"content":"<div class=x><b>About</b> ' || landed || '</div>"}'
         ELSE '{"descriptionPlain":"' || landed || '","additionalPlain":' || CASE WHEN seq % 2 = 0 THEN 'null' ELSE '"More."' END
              || ',"lists":[{"content":"<li>Class of 2025</li>"},{"content":""},{"text":"none"}]}' END AS body
FROM jobs_fx WHERE source IN ('workday','greenhouse','lever')
""")

# Each detail once more as it was landed earlier, and some as they will be later.
_view("detail_versions_fx", "details_fx", """
SELECT source, detail_key, status, body, '2026-01-02T00:00:00+00:00' AS landed FROM details_fx
UNION ALL
SELECT source, detail_key, 200, CASE source WHEN 'workday' THEN '{"jobPostingInfo":{"jobDescription":"Unable to sponsor."}}'
         WHEN 'greenhouse' THEN '{"content":"Class of 2027"}' ELSE '{"descriptionPlain":"Unable to sponsor."}' END, '2026-01-01T00:00:00+00:00'
FROM details_fx
UNION ALL
SELECT source, detail_key, 200, '{}', '2026-01-05T00:00:00+00:00' FROM details_fx WHERE status = 200
""")

_view("ashby_boards_fx", "jobs_fx", """
SELECT 'acme' || CAST(seq % 7 AS STRING) AS slug, seq AS part,
       CASE WHEN seq % 19 = 0 THEN 404 ELSE 200 END AS status,
       '{"jobs":[{"id":"j' || CAST(seq AS STRING) || '",' ||
       CASE WHEN seq % 2 = 0 THEN '"descriptionPlain":"' || landed || '"' ELSE '"descriptionPlain":"","descriptionHtml":"<p>' || landed || '</p>"' END
       || '},{"title":"no id"}]}' AS body
FROM jobs_fx WHERE source = 'ashby'
""")

_view("crawl_text_fx", "pages", """
SELECT page_id,
       CASE page_id % 8
         WHEN 0 THEN 'see https://t' || CAST(page_id % 5 AS STRING) || '.wd1.myworkdayjobs.com/en-US/Careers and more'
         WHEN 1 THEN 'https://job-boards.greenhouse.io/Tok' || CAST(page_id % 6 AS STRING) || '/jobs/12'
         WHEN 2 THEN 'https://boards-api.greenhouse.io/v1/boards'
         WHEN 3 THEN 'jobs.lever.co/Co' || CAST(page_id % 4 AS STRING) || '/x jobs.lever.co/other'
         WHEN 4 THEN 'https://jobs.ashbyhq.com/Caf%C3%A9' || CAST(page_id % 3 AS STRING) || '.'
         WHEN 5 THEN 'https://careers.smartrecruiters.com/oneclick-ui/company/Acme' || CAST(page_id % 3 AS STRING)
         WHEN 6 THEN 'https://apply.workable.com/api/v3 https://apply.workable.com/wk-' || CAST(page_id % 3 AS STRING)
         ELSE '<a href="https://www.greenhouse.io/embed/job_board?x=1&for=emb' || CAST(page_id % 2 AS STRING) || '">'
       END || ' ' || html AS body
FROM pages
""")

# Every payload is the one page of a board of its own.
_view("payloads_fx", "orders", """
SELECT ats, board, board AS name, board AS tenant, 'wd1' AS wd, 'Careers' AS site,
       CAST('' AS STRING) AS term, 0 AS term_ord, board_ord, CAST(0 AS BIGINT) AS page_no,
       CASE WHEN board_ord % 31 = 5 THEN 404 ELSE 200 END AS status,
       CASE WHEN board_ord % 37 = 3 THEN '<html>try later</html>' ELSE body END AS body
FROM (
SELECT o_orderkey AS board_ord,
  CASE o_orderkey % 6 WHEN 0 THEN 'workday' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' WHEN 4 THEN 'smartrecruiters' ELSE 'workable' END AS ats,
  'b' || CAST(o_orderkey AS STRING) AS board,
  CASE o_orderkey % 6
   WHEN 0 THEN '{"total":2,"jobPostings":[{"bulletFields":[" JR' || CAST(o_orderkey AS STRING) || ' "],"title":" Intern ","externalPath":"/job/x_R1","locationsText":"Austin, TX","postedOn":"Posted Today"},{"bulletFields":[],"title":"Staff","externalPath":"/job/y_R' || CAST(o_orderkey AS STRING) || '"},{"bulletFields":["  "],"title":"blank","externalPath":"/job/z_R9"},{"title":"dropped","externalPath":"/job/none"}]}'
   WHEN 1 THEN '{"jobs":[{"id":' || CAST(o_orderkey AS STRING) || ',"title":"New Grad","absolute_url":"https://boards.greenhouse.io/t/jobs/1","location":{"name":" NYC "},"updated_at":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T01:02:03-05:00"},{"title":"no id"},{"id":0,"title":"zero id"}]}'
   WHEN 2 THEN '[{"id":"u' || CAST(o_orderkey AS STRING) || '","text":"Lead","hostedUrl":"https://jobs.lever.co/a/u","createdAt":' || CAST(1700000000000 + o_orderkey * 86400000 AS STRING) || ',"categories":{"location":"Remote","allLocations":[' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '"Paris","Rome"' END || ']}},{"id":"","text":"dropped"},{"id":"v' || CAST(o_orderkey AS STRING) || '","text":"Lead","createdAt":0}]'
   WHEN 3 THEN '{"jobs":[{"id":"a' || CAST(o_orderkey AS STRING) || '","title":"Analyst","location":null,"publishedAt":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00Z"},{"id":"c' || CAST(o_orderkey AS STRING) || '","title":"Engineer","jobUrl":"https://jobs.ashbyhq.com/x/y","location":"Oslo "}]}'
   WHEN 4 THEN '{"totalFound":1,"content":[{"id":"s' || CAST(o_orderkey AS STRING) || '","name":"Engineer II","releasedDate":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00Z","location":{"city":"Berlin","region":"","country":"de"}}]}'
   ELSE '{"total":2,"nextPage":null,"results":[{"shortcode":"W' || CAST(o_orderkey AS STRING) || '","title":"Co-op","published":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '","location":{"display":"","city":"Rome","country":"Italy"}},{"shortcode":"","title":"dropped"},{"shortcode":"X' || CAST(o_orderkey AS STRING) || '","title":"Intern","location":{"display":" Pisa, Italy "}}]}'
  END AS body,
  o_orderdate
FROM orders) p
""")

# Page sequences: l_orderkey is a board (and term), its lines are the pages. A page
# number is the count of earlier pages: DuckDB 2.0 shifts ROW_NUMBER() - 1 by one
# when a filter on it meets its top-n rewrite.
_view("page_rows_fx", "lineitem", """
SELECT k, COUNT(*) OVER (PARTITION BY k ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS page_no, p, s
FROM (SELECT l_orderkey AS k, l_linenumber AS l, MIN(l_partkey) AS p, MIN(l_suppkey) AS s
      FROM lineitem GROUP BY l_orderkey, l_linenumber) q
""")

_view("wd_pages_fx", "page_rows_fx", """
SELECT 'workday' AS ats, 'wd' || CAST(b AS STRING) AS board, 'wd' || CAST(b AS STRING) AS name,
       't' || CAST(b AS STRING) AS tenant, 'wd5' AS wd, 'Jobs' AS site,
       'term' || CAST(t AS STRING) AS term, t AS term_ord, b AS board_ord, page_no,
       CASE WHEN p % 13 = 0 THEN 500 ELSE 200 END AS status,
       CASE WHEN p % 11 = 0 THEN '{"total":90,"jobPostings":[]}'
            WHEN p % 17 = 0 THEN 'not json'
            ELSE '{' || CASE s % 4 WHEN 0 THEN '' WHEN 1 THEN '"total":40,' ELSE '"total":200,' END
              || '"jobPostings":[{"bulletFields":["JR' || CAST(p % 9 AS STRING) || '"],"title":"Intern ' || CAST(k AS STRING)
              || '","externalPath":"/job/a_R' || CAST(p AS STRING) || '","locationsText":"Austin, TX","postedOn":"Posted Today"},'
              || '{"title":"Staff","externalPath":"/job/b_R' || CAST(p AS STRING) || '"}]}' END AS body
FROM (SELECT k, CAST(FLOOR(k / 5) AS BIGINT) AS b, CAST(k % 5 AS INT) AS t, page_no, p, s FROM page_rows_fx) q
""")

_view("sr_pages_fx", "page_rows_fx", """
SELECT 'smartrecruiters' AS ats, 'Sr' || CAST(k AS STRING) AS board, 'Sr' || CAST(k AS STRING) AS name,
       CAST(NULL AS STRING) AS tenant, CAST(NULL AS STRING) AS wd, CAST(NULL AS STRING) AS site,
       CAST('' AS STRING) AS term, 0 AS term_ord, k AS board_ord, page_no,
       CASE WHEN p % 13 = 0 THEN 500 ELSE 200 END AS status,
       CASE WHEN p % 11 = 0 THEN '{"totalFound":9,"content":[]}'
            ELSE '{' || CASE s % 5 WHEN 0 THEN '' WHEN 1 THEN '"totalFound":2,' WHEN 2 THEN '"totalFound":4,' ELSE '"totalFound":50,' END
              || '"content":[{"id":"' || CAST(p AS STRING) || '-' || CAST(page_no AS STRING) || '","name":" Engineer ","releasedDate":"2026-01-0' || CAST(page_no + 1 AS STRING)
              || 'T00:00:00Z","location":{"city":"Berlin","country":"de"}},{"name":"no id"}]}' END AS body
FROM page_rows_fx
""")

_view("wk_pages_fx", "page_rows_fx", """
SELECT 'workable' AS ats, 'wk' || CAST(k AS STRING) AS board, 'wk' || CAST(k AS STRING) AS name,
       CAST(NULL AS STRING) AS tenant, CAST(NULL AS STRING) AS wd, CAST(NULL AS STRING) AS site,
       CAST('' AS STRING) AS term, 0 AS term_ord, k AS board_ord, page_no,
       CASE WHEN p % 13 = 0 THEN 500 ELSE 200 END AS status,
       CASE WHEN p % 11 = 0 THEN '{"total":9,"nextPage":"n","results":[]}'
            ELSE '{' || CASE s % 5 WHEN 0 THEN '' WHEN 1 THEN '"total":2,' WHEN 2 THEN '"total":4,' ELSE '"total":50,' END
              || CASE s % 7 WHEN 0 THEN '"nextPage":null,' WHEN 1 THEN '' ELSE '"nextPage":"tok",' END
              || '"results":[{"shortcode":"' || CAST(p AS STRING) || 'x' || CAST(page_no AS STRING) || '","title":"Co-op","published":"2026-01-01T00:00:00Z","location":{"city":"Rome","country":"Italy"}},{"title":"no code"}'
              || CASE WHEN p % 3 = 0 THEN ',{"shortcode":"' || CAST(p AS STRING) || 'y' || CAST(page_no AS STRING) || '","title":"Lead"}' ELSE '' END || ']}' END AS body
FROM page_rows_fx
""")

_view("listings_fx", "orders", """
SELECT o_orderkey AS seq,
       CASE o_orderkey % 3 WHEN 0 THEN 'indeed' WHEN 1 THEN 'glassdoor' ELSE 'zip_recruiter' END AS scanned_site,
       'term' || CAST(CAST(FLOOR(o_orderkey / 3) AS BIGINT) % 4 AS STRING) AS term,
       CASE o_orderkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN CAST(NULL AS STRING) WHEN 2 THEN ' indeed ' ELSE 'glassdoor' END AS site,
       CASE WHEN o_orderkey % 7 = 0 THEN 'None' ELSE ' https://example.net/view?jk=' || CAST(o_custkey AS STRING) END AS job_url,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'https://jobs.lever.co/Agg' || CAST(o_custkey AS STRING) || '/1' END AS job_url_direct,
       CASE WHEN o_orderkey % 14 = 0 THEN CAST(NULL AS STRING) ELSE 'https://apply.workable.com/agg' || CAST(o_custkey AS STRING) || '/j/2' END AS apply_url,
       CASE WHEN o_orderkey % 11 = 0 THEN 'nan' ELSE 'Customer ' || CAST(o_custkey AS STRING) END AS company,
       CASE o_orderkey % 3 WHEN 0 THEN ' Software Intern ' WHEN 1 THEN 'New Grad Analyst' ELSE 'Staff Engineer' END AS title,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE 'Austin, TX' END AS location,
       CASE WHEN o_orderkey % 9 = 0 THEN 'NaT' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_posted,
       CASE WHEN o_orderkey % 2 = 0 THEN 'none' ELSE 'Visa sponsorship available.' END AS description
FROM orders
""")

# Boards of customers. Every second one is registered, every third one is live.
_view("board_parts_fx", "customer", """
SELECT c_custkey AS k,
       CASE c_custkey % 6 WHEN 0 THEN 'workday' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' WHEN 4 THEN 'smartrecruiters' ELSE 'workable' END AS ats,
       CASE WHEN c_custkey % 6 = 0 THEN 't' || CAST(c_custkey AS STRING) END AS tenant,
       CASE WHEN c_custkey % 6 = 0 THEN 'wd' || CAST(c_custkey % 5 + 1 AS STRING) END AS wd,
       CASE WHEN c_custkey % 6 = 0 THEN 'Careers' || CAST(c_custkey % 3 AS STRING) END AS site,
       CASE c_custkey % 6 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'tok' || CAST(c_custkey AS STRING) WHEN 2 THEN 'co' || CAST(c_custkey AS STRING)
         WHEN 3 THEN 'Org%20' || CAST(c_custkey AS STRING) WHEN 4 THEN 'Acme' || CAST(c_custkey AS STRING) ELSE 'wk-' || CAST(c_custkey AS STRING) END AS slug
FROM customer
""")

_view("boards_fx", "board_parts_fx", """
SELECT ats, tenant, wd, site, slug, CASE WHEN k % 10 = 4 THEN CAST(NULL AS STRING) ELSE c END AS name, k AS ord
FROM (SELECT *, 'Customer ' || CAST(k AS STRING) AS c FROM board_parts_fx) q
WHERE CAST(FLOOR(k / 6) AS BIGINT) % 2 = 0
""")

_view("probes_fx", "board_parts_fx", """
SELECT ats,
       CASE WHEN ats = 'workday' THEN tenant || '/' || wd || '/' || site
            WHEN ats IN ('ashby','smartrecruiters') THEN lower(slug) ELSE slug END AS board_key,
       CASE WHEN g % 7 = 6 THEN 404 ELSE 200 END AS status,
       CASE WHEN g % 3 = 0 THEN
         CASE ats WHEN 'workday' THEN '{"total":1,"jobPostings":[{"title":"x"}]}' WHEN 'lever' THEN '[{"id":"1"}]'
                  WHEN 'smartrecruiters' THEN '{"totalFound":3,"content":[]}' WHEN 'workable' THEN '{"total":2}' ELSE '{"jobs":[{"id":1}]}' END
       ELSE CASE ats WHEN 'workday' THEN '{"total":0,"jobPostings":[]}' WHEN 'lever' THEN '{"ok":false}'
                  WHEN 'smartrecruiters' THEN '{"totalFound":0}' WHEN 'workable' THEN '{}' ELSE '{"jobs":[]}' END END AS body
FROM (SELECT *, CAST(FLOOR(k / 6) AS BIGINT) AS g FROM board_parts_fx) q
""")

# One line of a URL index per order, at its customer's board.
_view("url_lines_fx", "orders", """
SELECT o_orderkey AS line_no,
  CASE WHEN o_orderkey % 23 = 0 THEN '   ' WHEN o_orderkey % 29 = 0 THEN '{"url": oops' WHEN o_orderkey % 31 = 0 THEN '{"status":"200"}'
  ELSE '{"url": "' || CASE o_custkey % 6
    WHEN 0 THEN 'https://T' || CAST(o_custkey AS STRING) || '.wd' || CAST(o_custkey % 5 + 1 AS STRING) || '.myworkdayjobs.com/' || CASE WHEN o_orderkey % 2 = 0 THEN 'en-US/' ELSE '' END || 'Careers' || CAST(o_custkey % 3 AS STRING) || '/job/1'
    WHEN 1 THEN 'https://' || CASE WHEN o_orderkey % 2 = 0 THEN 'job-' ELSE '' END || 'boards.greenhouse.io/Tok' || CAST(o_custkey AS STRING) || '/jobs/1'
    WHEN 2 THEN 'https://jobs.lever.co/Co' || CAST(o_custkey AS STRING) || '/x'
    WHEN 3 THEN 'https://jobs.ashbyhq.com/' || CASE WHEN o_orderkey % 2 = 0 THEN 'ORG' ELSE 'Org' END || '%20' || CAST(o_custkey AS STRING) || '.'
    WHEN 4 THEN 'https://jobs.smartrecruiters.com/' || CASE WHEN o_orderkey % 2 = 0 THEN 'ACME' ELSE 'Acme' END || CAST(o_custkey AS STRING) || '/7'
    ELSE 'https://apply.workable.com/WK-' || CAST(o_custkey AS STRING) || '/j/1' END || '", "status": "200"}' END AS value
FROM orders
""")

# Links whose captures are partly not boards.
_view("bad_links_fx", "orders", """
SELECT o_orderkey AS doc_id,
  CASE o_orderkey % 12
    WHEN 0 THEN 'https://boards.greenhouse.io/embed/x' WHEN 1 THEN 'https://boards.greenhouse.io/Jobs' WHEN 2 THEN 'boards-api.greenhouse.io/v1/boards'
    WHEN 3 THEN 'https://acme.wd3.myworkdayjobs.com/wday/cxs' WHEN 4 THEN 'https://acme.wd3.myworkdayjobs.com/en-US' WHEN 5 THEN 'https://jobs.ashbyhq.com/API'
    WHEN 6 THEN 'https://jobs.smartrecruiters.com/Sitemap' WHEN 7 THEN 'https://apply.workable.com/j/ https://apply.workable.com/good' WHEN 8 THEN 'https://apply.workable.com/Assets'
    WHEN 9 THEN 'https://jobs.lever.co/api' WHEN 10 THEN 'https://boards.greenhouse.io/internal' ELSE 'https://boards.greenhouse.io/tok' || CAST(o_custkey AS STRING) END
    || ' ' || o_orderpriority AS body
FROM orders
""")

_view("seeds_fx", "customer", """
SELECT CASE c_custkey % 4 WHEN 0 THEN '# ' WHEN 1 THEN '   #' ELSE '' END || 'https://jobs.lever.co/seed' || CAST(c_custkey AS STRING) AS value
FROM customer
""")

_view("crawl_pairs_fx", "lineitem", """
SELECT 'CRAWL-' || CAST(l_suppkey AS STRING) AS index_name, l_suppkey AS list_ord,
       'pattern-' || CAST(l_linenumber AS STRING) AS pattern, COUNT(*) AS num_pages
FROM lineitem GROUP BY l_suppkey, l_linenumber
""")

_view("title_labels_fx", "postings_fx", """
SELECT DISTINCT title, CASE length(title) % 3 WHEN 0 THEN 'intern' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'senior' END AS label
FROM postings_fx
""")

# A sheet as it stands (prior jobs), and a payload with blank ids and repeats.
_view("sheet_fx", "prior_jobs_fx", """
SELECT first_seen, company, title, role_type, location, posted_on, source, apply_url,
       CASE WHEN job_id LIKE '%9' THEN '' ELSE job_id END AS job_id, sponsorship, clearance, grad_year,
       ROW_NUMBER() OVER (ORDER BY job_id) AS append_seq
FROM prior_jobs_fx
""")

_view("sheet_payload_fx", "postings_fx", """
SELECT CASE WHEN seq % 3 = 0 THEN '2026-01-03T00:00:00+00:00' ELSE '2026-01-04T00:00:00+00:00' END AS first_seen,
       company, title,
       CASE seq % 5 WHEN 0 THEN 'intern' WHEN 1 THEN 'new_grad' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' ELSE 'other' END AS role_type,
       location, posted_on, source, apply_url,
       CASE WHEN seq % 10 = 0 THEN '' WHEN seq % 10 = 1 THEN CAST(NULL AS STRING) ELSE job_id END AS job_id,
       '' AS sponsorship, '' AS clearance, '' AS grad_year, seq + 1000000000 AS append_seq
FROM postings_fx
""")


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for need in VIEWS[name][0]:
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    return order


def with_views(*names: str) -> str:
    """CTE list with the views named and all they need, for DuckDB."""
    return ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in _closure(names))


#: Stored bytes of a table per task, where its rows are dealt out.
DEALT_BYTES = 8 << 20
#: Views that several others read; stored once, so that their windows run once.
STORED = ("page_rows_fx",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Here each is one file with one row group, which Spark can only
    read in one task; its rows are then dealt out, to more tasks if there are more of
    them. Tables of many files are not."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    return rows.repartition(max(cores, -(-folder_bytes(spark, path) // DEALT_BYTES)))


def view(
    spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None
) -> DataFrame:
    """The view (or given table) as a DataFrame; ``made`` holds those made before."""
    made = {} if made is None else made
    if name not in made:
        if name in TABLES:
            made[name] = table(spark, sf_dir, name)
        else:
            for need in VIEWS[name][0]:
                view(spark, sf_dir, need, made).createOrReplaceTempView(need)
            rows = spark.sql(VIEWS[name][1])
            made[name] = stored(rows, name) if name in STORED else rows
    return made[name]
