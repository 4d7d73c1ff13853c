"""Surrogate ids, board keys, detail keys and the batch order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import text

# Job page addresses that carry a Greenhouse board token.
GREENHOUSE_JOB_URL = (
    r"(?:job-boards|boards)(?:\.eu)?\.greenhouse\.io/([A-Za-z0-9_-]+)/jobs/(\d+)"
)

URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)"
URL_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def surrogate_id(source: Column, url: Column) -> Column:
    """Stable id of a listing that has none of its own."""
    return F.concat(source, F.lit("_"), F.substring(F.sha1(url), 1, 12))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(url), URL_HOST, 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(text(url), URL_PATH, 1)
    return F.regexp_replace(path, r";[^/]*\z", "")


def workday_detail_key(apply_url: Column) -> Column:
    host = url_host(apply_url)
    tenant = F.substring_index(host, ".", 1)
    path = F.regexp_replace(url_path(apply_url), "^/+", "")
    site = F.regexp_extract(path, "^([^/]*)/(.*)$", 1)
    rest = F.regexp_extract(path, "^([^/]*)/(.*)$", 2)
    whole = (tenant != "") & (site != "") & (rest != "")
    return F.when(whole, F.concat_ws("/", host, F.lit("wday/cxs"), tenant, site, rest))


def greenhouse_detail_key(apply_url: Column) -> Column:
    url = text(apply_url)
    token = F.regexp_extract(url, GREENHOUSE_JOB_URL, 1)
    number = F.regexp_extract(url, GREENHOUSE_JOB_URL, 2)
    return F.when(token != "", F.concat_ws("/", token, F.lit("jobs"), number))


def _path_parts(apply_url: Column) -> Column:
    return F.split(F.regexp_replace(url_path(apply_url), "^/+|/+$", ""), "/")


def lever_detail_key(apply_url: Column) -> Column:
    parts = _path_parts(apply_url)
    return F.when(F.size(parts) >= 2, F.concat_ws("/", parts[0], parts[1]))


def ashby_detail_key(job_id: Column, apply_url: Column) -> Column:
    slug = _path_parts(apply_url)[0]
    own_id = F.regexp_replace(job_id, "^ash_", "")
    return F.when(slug != "", F.concat_ws("/", slug, own_id))


def detail_key(source: Column, job_id: Column, apply_url: Column) -> Column:
    """Where the description of a job is found; NULL if it cannot be looked up."""
    return (
        F.when(source == "workday", workday_detail_key(apply_url))
        .when(source == "greenhouse", greenhouse_detail_key(apply_url))
        .when(source == "lever", lever_detail_key(apply_url))
        .when(source == "ashby", ashby_detail_key(job_id, apply_url))
    )


def board_key(ats: Column, tenant: Column, wd: Column, site: Column, slug: Column) -> Column:
    """Identity of a board within its system."""
    return (
        F.when(ats == "workday", F.concat_ws("/", tenant, wd, site))
        .when(ats.isin("ashby", "smartrecruiters"), F.lower(slug))
        .otherwise(slug)
    )


def key_label(ats: Column, tenant: Column, wd: Column, site: Column, key: Column) -> Column:
    """Board key as printed in reports; Workday's three parts as a tuple."""
    printed = F.concat(
        F.lit("('"), tenant, F.lit("', '"), wd, F.lit("', '"), site, F.lit("')")
    )
    return F.when(ats == "workday", printed).otherwise(key)


# Decimal digits per part of the batch order; 38 in all.
SEQ_DIGITS = {"source": 1, "board": 13, "term": 4, "page": 10, "pos": 10}
SEQ_TYPE = "DECIMAL(38,0)"


def batch_seq(source: Column, board: Column, term: Column, page: Column, pos: Column) -> Column:
    """One DECIMAL(38,0) that sorts like (source, board, term, page, pos).

    It comes from the data alone, so it is the same after any retry or repartitioning.
    Parts have room for 10^13 boards, 10^4 terms, and 10^10 pages and items on a page; a
    larger or negative part fails the job rather than to collide.
    """
    parts = dict(zip(SEQ_DIGITS, (source, board, term, page, pos)))
    fits, head, tail = F.lit(True), F.lit(0).cast("bigint"), []
    for name, part in parts.items():
        part = part.cast("bigint")
        fits = fits & part.between(0, 10 ** SEQ_DIGITS[name] - 1)
        if name in ("page", "pos"):
            tail.append(F.lpad(part.cast("string"), SEQ_DIGITS[name], "0"))
        else:
            # 18 digits fit a bigint, so only two parts are padded as text.
            head = head * F.lit(10 ** SEQ_DIGITS[name]).cast("bigint") + part
    digits = [head.cast("string"), *tail]
    return F.when(fits, F.concat(*digits).cast(SEQ_TYPE)).otherwise(
        F.raise_error(F.lit("batch order part out of range")).cast(SEQ_TYPE)
    )


def link_seq(text_order: Column, pos: Column) -> Column:
    """One DECIMAL(38,0) that sorts like (order of the text, place of the link in it)."""
    return (text_order.cast("DECIMAL(20,0)") * F.lit(10**12) + pos).cast(SEQ_TYPE)
