"""Descriptions of announceable jobs and the flags read from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.flags import with_flags
from jobloom.functions.keys import detail_key
from jobloom.functions.roles import announceable
from jobloom.functions.text import strip_html, strip_html_each, text
from jobloom.operators.reconcile import FLAGS
from jobloom.operators.skew import HOT_ROWS, join_unique
from jobloom.session import written
from jobloom.sources.details import key_counts, versions, with_newest

# Detail payloads, the fields read.
DETAIL_WORKDAY = "struct<jobPostingInfo:struct<jobDescription:string>>"
DETAIL_GREENHOUSE = "struct<content:string>"
DETAIL_LEVER = (
    "struct<descriptionPlain:string, additionalPlain:string, lists:array<struct<content:string>>>"
)
DETAIL_ASHBY = "struct<descriptionPlain:string, descriptionHtml:string>"
BOARD_ASHBY = (
    "struct<jobs:array<struct<id:string, descriptionPlain:string, descriptionHtml:string>>>"
)


def targets(fresh: DataFrame) -> DataFrame:
    return fresh.where(announceable(F.col("role_type")))


def with_detail_key(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn(
        "detail_key", detail_key(F.col("source"), F.col("job_id"), F.col("apply_url"))
    )


def ashby_details(boards: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One DETAIL row per job of the Ashby board payloads (slug, status, body).

    With ``jobs``, only boards that they are on are parsed, and only their rows come out.
    """
    wanted = None
    if jobs is not None:
        keyed = with_detail_key(jobs.where(F.col("source") == "ashby"))
        wanted = keyed.where(F.col("detail_key").isNotNull()).select("detail_key").distinct()
        slugs = wanted.select(F.substring_index("detail_key", "/", 1).alias("slug")).distinct()
        boards = boards.join(slugs, "slug", "left_semi")
    listed = F.from_json("body", BOARD_ASHBY)["jobs"]
    each = boards.where(F.col("status") == 200).select("slug", F.explode(listed).alias("job"))
    each = each.where(F.col("job.id").isNotNull()).withColumn(
        "detail_key", F.concat_ws("/", "slug", F.col("job.id"))
    )
    if wanted is not None:
        each = each.join(wanted, "detail_key", "left_semi")
    body = F.to_json(F.struct("job.descriptionPlain", "job.descriptionHtml"))
    return each.select(
        F.lit("ashby").alias("source"),
        "detail_key",
        F.lit(200).alias("status"),
        body.alias("body"),
    )


def with_details(jobs: DataFrame, details: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Jobs joined to the landed detail payload of their source and key.

    Of a detail landed more than once the newest counts, by the column ``landed`` if there
    is one; at a tie, and without it, the last body by its text.
    """
    landed = F.col("landed") if "landed" in details.columns else F.lit(0)
    ok = details.where(F.col("status") == 200).select(
        "source", "detail_key", F.struct(landed.alias("landed"), "body").alias("_detail")
    )
    return join_unique(
        with_detail_key(jobs),
        ok,
        ["source", "detail_key"],
        "left",
        "job_id",
        hot_rows,
        reduce=[F.max("_detail")["body"].alias("body")],
    )


def with_description(jobs: DataFrame) -> DataFrame:
    """Add ``full_description``: the scrape-time text, else the payload's, else ''.

    Payloads are parsed into columns first, so that each body is parsed once. Ashby jobs may come
    with ``plain`` and ``html`` in place of a body.
    """
    if "plain" in jobs.columns:
        own = F.struct(F.col("plain").alias("descriptionPlain"), F.col("html").alias("descriptionHtml"))
        ashby = F.when((F.col("source") == "ashby") & (F.col("plain").isNotNull() | F.col("html").isNotNull()), own)
    else:
        ashby = F.from_json(F.when(F.col("source") == "ashby", F.col("body")), DETAIL_ASHBY)
    source = F.col("source")

    def payload(name: str, schema: str) -> Column:
        return F.from_json(F.when(source == name, F.col("body")), schema)

    parsed = jobs.withColumns({
        "_workday": payload("workday", DETAIL_WORKDAY)["jobPostingInfo"]["jobDescription"],
        "_greenhouse": payload("greenhouse", DETAIL_GREENHOUSE)["content"],
        "_lever": payload("lever", DETAIL_LEVER),
        "_ashby": ashby,
    })
    # One source per row, so one pass through the HTML clean-up serves all.
    ashby_plain, ashby_html = F.col("_ashby.descriptionPlain"), F.col("_ashby.descriptionHtml")
    ready = parsed.withColumns({
        "_markup": F.coalesce(
            "_workday", "_greenhouse", F.when(text(ashby_plain) == "", ashby_html)
        ),
        "_bullets": F.transform("_lever.lists", lambda x: x["content"]),
    }).withColumns({
        "_markup": strip_html(F.col("_markup")),
        "_bullets": strip_html_each(F.col("_bullets")),
    })
    none = F.array().cast("array<string>")
    pieces = F.concat(
        F.array(text(F.col("_lever.descriptionPlain")), text(F.col("_lever.additionalPlain"))),
        F.coalesce("_bullets", none),
    )
    lever = F.array_join(F.filter(pieces, lambda p: p != ""), "\n")
    fetched = (
        F.when(source == "lever", lever)
        .when((source == "ashby") & (text(ashby_plain) != ""), ashby_plain)
        .otherwise(F.col("_markup"))
    )
    scraped = F.nullif("description", F.lit(""))
    return ready.withColumn("full_description", F.coalesce(scraped, fetched)).drop(
        "_workday", "_greenhouse", "_lever", "_ashby", "_markup", "_bullets"
    )


def enrich(
    jobs: DataFrame,
    details: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    boards: DataFrame | None = None,
    as_of: str | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """Jobs with ``full_description`` and the three flags set from it.

    ``details`` are landed payloads, ``boards`` those of whole Ashby boards; of several versions of
    a description the newest landed at ``as_of`` or before counts. Without either only
    scrape-time descriptions count.
    """
    keyed = with_detail_key(jobs)
    if details is None and boards is None:
        joined = keyed.withColumn("body", F.lit(None).cast("string"))
    elif boards is None and as_of is None:
        joined = with_details(jobs, details, hot_rows)
    else:
        counts = key_counts(keyed, keep)
        found = versions(details, boards, counts, keep)
        joined = with_newest(keyed, found, as_of, hot_rows, counts)
    flagged = with_flags(with_description(joined), "full_description")
    return flagged.drop("body", "plain", "html", "detail_key")


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(*[F.count_if(F.col(c) != "").alias(c) for c in FLAGS])


def without_no_sponsorship(jobs: DataFrame) -> DataFrame:
    return jobs.where(text(F.col("sponsorship")) != "no")

