"""Result tables of job-search sites: site, term, and the listing's columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.keys import surrogate_id
from jobloom.functions.text import strip
from jobloom.operators.dedupe import first_per_key
from jobloom.schemas import POSTING_COLS
from jobloom.settings import HOURS_OLD

# Cells that mean "no value", and the URL columns harvested.
EMPTY_CELLS = ("nan", "nat", "none")
URL_COLS = ("job_url_direct", "job_url", "apply_url")


def cell(col: Column) -> Column:
    """Trimmed text; NULL, nan, nat and none become ''."""
    value = strip(col.cast("string"))
    return F.when(F.lower(value).isin(*EMPTY_CELLS), "").otherwise(value)


def normalize(listings: DataFrame) -> DataFrame:
    """Every listing with a URL as a posting; ``scanned_site`` is the site asked."""
    url = F.coalesce(F.nullif(cell(F.col("job_url")), F.lit("")), cell(F.col("apply_url")))
    source = F.coalesce(F.nullif(cell(F.col("site")), F.lit("")), F.col("scanned_site"))
    rows = listings.withColumns({"_url": url, "_source": source}).where(F.col("_url") != "")
    cols = {
        "seq": F.col("seq"),
        "job_id": surrogate_id(F.col("_source"), F.col("_url")),
        "company": cell(F.col("company")),
        "title": cell(F.col("title")),
        "apply_url": F.col("_url"),
        "location": cell(F.col("location")),
        "posted_on": cell(F.col("date_posted")),
        "source": F.col("_source"),
        "description": cell(F.col("description")),
    }
    return rows.select(*[cols[c].alias(c) for c in POSTING_COLS])


def read_listings(listings: DataFrame) -> DataFrame:
    """Normalized postings, the first of each (source, address) over all sites and terms.

    The id is a short hash of both and only a label: two addresses may share it.
    """
    return first_per_key(normalize(listings), ["source", "apply_url"])


def source_filters(
    listings: DataFrame,
    run_ts: str,
    hours_old: int = HOURS_OLD,
    results_per_term: int | None = None,
    sites: Sequence[str] | None = None,
    terms: Sequence[str] | None = None,
) -> DataFrame:
    """Listings of the ``hours_old`` hours before ``run_ts``, an ISO time with its offset.

    ``sites`` and ``terms`` keep those scanned for; both filters reach the scan. Rows without
    a date stay. ``results_per_term`` caps the rows per site and term if it is given; as that
    filter is on ``row_number``, each map task keeps no more before the shuffle.
    """
    # Wall-clock times in UTC, free of the session's time zone.
    now = datetime.fromisoformat(run_ts)
    now = now.astimezone(timezone.utc).replace(tzinfo=None) if now.tzinfo else now
    oldest = F.lit(now.isoformat()).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours_old} HOURS")
    posted = cell(F.col("date_posted")).try_cast("timestamp_ntz")
    for column, wanted in (("scanned_site", sites), ("term", terms)):
        if wanted is not None:
            listings = listings.where(F.col(column).isin(*wanted))
    recent = listings.where(posted.isNull() | (posted >= oldest))
    if results_per_term is None:
        return recent
    by_term = Window.partitionBy("scanned_site", "term").orderBy("seq")
    ranked = recent.withColumn("_rank", F.row_number().over(by_term))
    return ranked.where(F.col("_rank") <= results_per_term).drop("_rank")


def listing_urls(listings: DataFrame) -> DataFrame:
    """The three URL columns stacked, without NULLs."""
    stacked = listings.select(
        "seq", *URL_COLS
    ).unpivot("seq", list(URL_COLS), "column", "url")
    return stacked.where(F.col("url").isNotNull())
