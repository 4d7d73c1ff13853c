"""Landed board payloads to postings, one reader per applicant-tracking system.

Pages carry: ats, board (the key in the payload address), board_ord, name, tenant,
wd, site, term, term_ord, page_no, status, body. Readers are narrow: parse with a
schema of the fields used, cut the page sequence, explode, project.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.keys import SEQ_DIGITS, SEQ_TYPE, batch_seq
from jobloom.functions.text import strip, text
from jobloom.operators.boards import systems
from jobloom.operators.dedupe import first_per_key
from jobloom.schemas import POSTING_COLS, SOURCE_ORDER
from jobloom.session import stored
from jobloom.settings import Settings
from jobloom.sources import paging

# Payload fields read, per system.
PAYLOADS = {
    "workday": (
        "struct<total:bigint, jobPostings:array<struct<bulletFields:array<string>, "
        "title:string, externalPath:string, locationsText:string, postedOn:string>>>"
    ),
    "greenhouse": (
        "struct<jobs:array<struct<id:string, title:string, absolute_url:string, "
        "updated_at:string, location:struct<name:string>>>>"
    ),
    "lever": (
        "array<struct<id:string, text:string, hostedUrl:string, createdAt:bigint, "
        "categories:struct<location:string, allLocations:array<string>>>>"
    ),
    "ashby": (
        "struct<jobs:array<struct<id:string, title:string, jobUrl:string, "
        "location:string, publishedAt:string>>>"
    ),
    "smartrecruiters": (
        "struct<totalFound:bigint, content:array<struct<id:string, name:string, "
        "releasedDate:string, location:struct<city:string, region:string, country:string>>>>"
    ),
    "workable": (
        "struct<total:bigint, nextPage:string, results:array<struct<shortcode:string, "
        "title:string, published:string, location:struct<display:string, city:string, "
        "region:string, country:string>>>>"
    ),
}


# Where a payload lists its items; Lever's root is the list.
ITEMS = {
    "workday": "jobPostings",
    "greenhouse": "jobs",
    "lever": "",
    "ashby": "jobs",
    "smartrecruiters": "content",
    "workable": "results",
}

Keep = Callable[[DataFrame, str], DataFrame]

DAY_MILLIS = 86_400_000
FIRST_MILLIS, LAST_MILLIS = -62_135_596_800_000, 253_402_300_799_999


def parse(ats: str, body: Column) -> Column:
    """Payload of a system, NULL where the root is of the wrong kind."""
    root = "[" if PAYLOADS[ats].startswith("array") else "{"
    body = F.ltrim(body)
    return F.from_json(F.when(body.startswith(root), body), PAYLOADS[ats])


def display_name(*fallbacks: Column) -> Column:
    """First of the names that is not empty, else '?'."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in fallbacks], F.lit("?"))


def present(value: Column) -> Column:
    """Neither NULL nor ''. The string "0" is an id like any other."""
    return F.coalesce(value != "", F.lit(False))


def nonzero(value: Column) -> Column:
    """Present, and not the number 0, for systems whose ids are numbers."""
    return present(value) & (value != "0")


def of_boards(pages: DataFrame, boards: DataFrame) -> DataFrame:
    """Landed pages (ats, board_key, ...) of the registered boards, with their fields.

    The inner join leaves out pages of boards that are not registered. A page set
    is partitioned by ``ats``, so each reader scans its own partitions only.
    """
    fields = boards.select(
        "ats",
        "board_key",
        F.coalesce("slug", "board_key").alias("board"),
        F.col("ord").alias("board_ord"),
        "name",
        "tenant",
        "wd",
        "site",
    )
    return pages.join(fields, ["ats", "board_key"])


def landed(pages: DataFrame, keep: Keep = stored) -> DataFrame:
    """Pages with their bodies parsed, stored: each body is parsed once for all that reads it.

    Beside the columns of ``pages`` but ``body`` there are one column per system with the items of
    its payloads, and the numbers that stop rules look at. All are filled for a page's own system
    only, and parquet columns are read one by one, so a rule reads a few numbers and a reader the
    items of its system.
    """
    docs = {f"_{ats}": parse(ats, F.when(F.col("ats") == ats, F.col("body"))) for ats in PAYLOADS}
    parsed = pages.withColumns(docs).drop("body")
    own = F.coalesce(*[F.when(F.col(f"_{ats}").isNotNull(), True) for ats in PAYLOADS], F.lit(False))
    items = {ats: F.col(f"_{ats}.{ITEMS[ats]}" if ITEMS[ats] else f"_{ats}") for ats in PAYLOADS}
    totals = [F.col(f"_{ats}.{name}") for ats, name in paging.TOTALS.items()]
    codes = F.filter(items["workable"], lambda r: F.coalesce(r["shortcode"], F.lit("")) != "")
    numbers = {
        "failed": (F.coalesce("status", F.lit(0)) != 200) | ~own,
        "rows": F.coalesce(*[F.when(x.isNotNull(), F.size(x)) for x in items.values()], F.lit(0)).cast("bigint"),
        "total": F.coalesce(*totals, F.lit(0).cast("bigint")),
        "codes": F.when(codes.isNotNull(), F.size(codes)).otherwise(0).cast("bigint"),
        "more": F.coalesce("_workable.nextPage", F.lit("")) != "",
    }
    kept = [c for c in pages.columns if c != "body"]
    return keep(parsed.select(*kept, *[c.alias(n) for n, c in numbers.items()], *[items[a].alias(a) for a in PAYLOADS]), "landed-pages")


def is_landed(pages: DataFrame) -> bool:
    return set(PAYLOADS) <= set(pages.columns)


def kept_pages(pages: DataFrame, ats: str, settings: Settings = Settings()) -> DataFrame:
    """Pages of one system that its stop rule lets through, with their ``items``.

    ``pages`` may be ``landed``; else bodies are parsed here, once, and meet their rule in one shuffle.
    """
    own = pages.where(F.col("ats") == ats)
    if ats not in paging.GROUPS:
        ok = (own if is_landed(pages) else _parsed(own, ats)).where(~F.col("failed"))
        return ok.withColumn("items", F.col(ats)).drop(*PAYLOADS, *paging.NUMBERS)
    own = paging.capped(own, {
        "workday": settings.max_pages_per_term, "smartrecruiters": settings.smartrecruiters_pages, "workable": settings.workable_pages,
    }[ats])
    if not is_landed(pages):
        ok = paging.below_at_once(_parsed(own, ats), ats, settings.page_limit)
    else:
        ok = paging.below_landed(own.drop(*[a for a in PAYLOADS if a != ats]), ats, settings.page_limit)
    return ok.withColumn("items", F.col(ats)).drop(*PAYLOADS, *paging.NUMBERS)


def _parsed(pages: DataFrame, ats: str) -> DataFrame:
    """Pages of one system with the columns of ``landed`` that it fills, in place of ``body``: parsed once."""
    doc = pages.withColumn("_doc", parse(ats, F.col("body"))).drop("body")
    items = F.col(f"_doc.{ITEMS[ats]}" if ITEMS[ats] else "_doc")
    total = F.col(f"_doc.{paging.TOTALS[ats]}") if ats in paging.TOTALS else F.lit(None)
    codes = F.filter(items, lambda r: F.coalesce(r["shortcode"], F.lit("")) != "") if ats == "workable" else None
    numbers = {
        "failed": (F.coalesce("status", F.lit(0)) != 200) | F.col("_doc").isNull(),
        "rows": F.when(items.isNotNull(), F.size(items)).otherwise(0).cast("bigint"),
        "total": F.coalesce(total.cast("bigint"), F.lit(0).cast("bigint")),
        "codes": (F.lit(0) if codes is None else F.when(codes.isNotNull(), F.size(codes)).otherwise(0)).cast("bigint"),
        "more": F.coalesce("_doc.nextPage", F.lit("")) != "" if ats == "workable" else F.lit(False),
    }
    kept = [c for c in pages.columns if c != "body"]
    return doc.select(*kept, *[c.alias(n) for n, c in numbers.items()], items.alias(ats))


def running_offsets(pages: DataFrame) -> DataFrame:
    """SmartRecruiters pages with the rows listed so far."""
    return paging.rows_so_far(pages.where(F.col("ats") == "smartrecruiters"))


def scan(pages: DataFrame, ats: str, settings: Settings = Settings()) -> DataFrame:
    """One row per item (``p``) of the kept pages, with its place in the batch.

    ``pages`` may also be those of ``kept_pages``.
    """
    if "items" in pages.columns:
        kept = pages
    elif ats not in paging.GROUPS and not is_landed(pages):
        # A body that does not parse has no items. To filter on that as well would
        # make Spark parse every body twice.
        ok = pages.where((F.col("ats") == ats) & (F.col("status") == 200))
        items = F.col(f"doc.{ITEMS[ats]}" if ITEMS[ats] else "doc")
        kept = ok.withColumn("doc", parse(ats, F.col("body"))).drop("body").withColumn("items", items).drop("doc")
    else:
        kept = kept_pages(pages, ats, settings)
    # Of an inner explode Spark would infer a filter on the items and parse each body for it as well.
    placed = kept.select("*", F.posexplode_outer("items").alias("pos", "p")).drop("items").where(F.col("pos").isNotNull())
    rank = F.element_at(
        F.create_map(*[F.lit(x) for i, s in enumerate(SOURCE_ORDER) for x in (s, i)]),
        F.col("ats"),
    )
    seq = batch_seq(rank, F.col("board_ord"), F.col("term_ord"), F.col("page_no"), F.col("pos"))
    return placed.withColumn("seq", seq)


def _posting(rows: DataFrame, **cols: Column) -> DataFrame:
    cols = {
        "seq": F.col("seq"),
        "company": F.coalesce("name", "board"),
        "source": F.col("ats"),
        "description": F.lit(""),
    } | cols
    return rows.select(*[cols[c].alias(c) for c in POSTING_COLS], "board")


def _day(value: Column) -> Column:
    return F.substring(text(value), 1, 10)


def _utc_day(millis: Column) -> Column:
    """UTC date of epoch milliseconds, whatever the session's time zone; '' for 0,
    NULL and years outside 1 to 9999."""
    days = F.floor(millis / F.lit(DAY_MILLIS)).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    valid = millis.between(FIRST_MILLIS, LAST_MILLIS) & (millis != 0)
    return F.when(valid, day).otherwise("")


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ", ")


def workday_id(bullets: Column, path: Column) -> Column:
    """First bullet, else what follows the last '_' of the path, else NULL.

    A first bullet of blanks gives '' and no second try.
    """
    bullet = F.get(bullets, F.lit(0))
    path = text(path)
    tail = F.when(path.contains("_"), strip(F.substring_index(path, "_", -1)))
    return F.when(text(bullet) != "", strip(bullet)).otherwise(tail)


def read_workday(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Postings of the kept pages, the first of each id per board."""
    rows = scan(pages, "workday", settings)
    postings = _posting(
        rows,
        company=F.coalesce("name", "tenant"),
        job_id=workday_id(F.col("p.bulletFields"), F.col("p.externalPath")),
        title=strip(F.col("p.title")),
        apply_url=F.concat(
            F.lit("https://"), "tenant", F.lit("."), "wd", F.lit(".myworkdayjobs.com/"),
            "site", text(F.col("p.externalPath")),
        ),
        location=strip(F.col("p.locationsText")),
        posted_on=strip(F.col("p.postedOn")),
    ).where(text(F.col("job_id")) != "")
    # What is the same for all rows is not shuffled with them.
    same = {"source": F.lit("workday"), "description": F.lit("")}
    first = first_per_key(postings.drop(*same), ["board", "job_id"])
    return first.withColumns(same).select(*POSTING_COLS, "board")


def read_greenhouse(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rows = scan(pages, "greenhouse", settings)
    return _posting(
        rows.where(nonzero(F.col("p.id"))),
        job_id=F.concat(F.lit("gh_"), "p.id"),
        title=strip(F.col("p.title")),
        apply_url=text(F.col("p.absolute_url")),
        location=strip(F.col("p.location.name")),
        posted_on=_day(F.col("p.updated_at")),
    )


def read_lever(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rows = scan(pages, "lever", settings)
    place = F.col("p.categories")
    millis = F.col("p.createdAt")
    return _posting(
        rows.where(strip(F.col("p.id")) != ""),
        job_id=F.concat(F.lit("lv_"), strip(F.col("p.id"))),
        title=strip(F.col("p.text")),
        apply_url=text(F.col("p.hostedUrl")),
        location=strip(
            F.when(F.size(place["allLocations"]) > 0, place["allLocations"][0]).otherwise(
                place["location"]
            )
        ),
        posted_on=_utc_day(millis),
    )


def read_ashby(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rows = scan(pages, "ashby", settings)
    built = F.concat(F.lit("https://jobs.ashbyhq.com/"), "board", F.lit("/"), "p.id")
    return _posting(
        rows.where(present(F.col("p.id"))),
        job_id=F.concat(F.lit("ash_"), "p.id"),
        title=strip(F.col("p.title")),
        apply_url=F.coalesce(F.nullif(F.col("p.jobUrl"), F.lit("")), built),
        location=strip(F.col("p.location")),
        posted_on=_day(F.col("p.publishedAt")),
    )


def read_smartrecruiters(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rows = scan(pages, "smartrecruiters", settings)
    place = F.col("p.location")
    return _posting(
        rows.where(present(F.col("p.id"))),
        job_id=F.concat(F.lit("sr_"), "p.id"),
        title=strip(F.col("p.name")),
        apply_url=F.concat(
            F.lit("https://jobs.smartrecruiters.com/"), "board", F.lit("/"), "p.id"
        ),
        location=_joined(place["city"], place["region"], F.upper(place["country"])),
        posted_on=_day(F.col("p.releasedDate")),
    )


def read_workable(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rows = scan(pages, "workable", settings)
    place = F.col("p.location")
    code = F.col("p.shortcode")
    return _posting(
        rows.where(present(code)),
        job_id=F.concat(F.lit("wk_"), code),
        title=strip(F.col("p.title")),
        apply_url=F.concat(
            F.lit("https://apply.workable.com/"), "board", F.lit("/j/"), code, F.lit("/")
        ),
        location=F.when(text(place["display"]) != "", strip(place["display"])).otherwise(
            _joined(place["city"], place["region"], place["country"])
        ),
        posted_on=_day(F.col("p.published")),
    )


Reader = Callable[[DataFrame, Settings], DataFrame]
READERS: dict[str, Reader] = {
    "workday": read_workday,
    "greenhouse": read_greenhouse,
    "lever": read_lever,
    "ashby": read_ashby,
    "smartrecruiters": read_smartrecruiters,
    "workable": read_workable,
}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_boards(
    pages: DataFrame,
    settings: Settings = Settings(),
    keep: Keep = stored,
    only: Sequence[str] = tuple(READERS),
) -> DataFrame:
    """All systems' postings in batch order (``seq``), with ats and board; ``only`` names fewer systems.

    Of landed pages, those of a paged system that count are stored before the next system's are dealt,
    so that the shuffle files of one system at a time take room.
    """
    own = dict.fromkeys(only, pages)
    if is_landed(pages):
        own |= {ats: keep(kept_pages(pages, ats, settings), f"kept-{ats}") for ats in only if ats in paging.GROUPS}
    return union_all([
        READERS[ats](kept, settings).withColumn("ats", F.lit(ats)) for ats, kept in own.items()
    ])


def unified_batch(
    pages: DataFrame,
    listings: DataFrame | None = None,
    settings: Settings = Settings(),
    keep: Keep = stored,
) -> DataFrame:
    """The run's batch: the six systems, then the aggregator postings.

    ``pages`` should be ``landed``, so that no body is parsed twice.
    """
    return with_listings(read_boards(pages, settings, keep), listings)


def with_listings(boards: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """Postings of ``read_boards``, and the aggregator postings after them."""
    parts = [boards.select(*POSTING_COLS)]
    if listings is not None:
        last = SOURCE_ORDER.index("aggregator") * 10 ** (38 - SEQ_DIGITS["source"])
        after = F.lit(str(last)).cast(SEQ_TYPE) + F.col("seq").cast("DECIMAL(37,0)")
        parts.append(listings.withColumn("seq", after.cast(SEQ_TYPE)).select(*POSTING_COLS))
    return union_all(parts)


def board_counts(postings: DataFrame) -> DataFrame:
    """Postings per board."""
    return postings.groupBy("ats", "board").agg(F.count(F.lit(1)).alias("postings"))


def ats_counts(postings: DataFrame) -> DataFrame:
    """Postings per system; a system without any shows 0."""
    counts = postings.groupBy("ats").agg(F.count(F.lit(1)).alias("postings"))
    return systems(postings.sparkSession).join(counts, "ats", "left").na.fill(0, ["postings"])
