"""Which landed pages count: the stop rules of paged listings, as data.

A group is one board's (and term's) pages. Its rule looks at a few numbers per page, so only
those are shuffled; payloads meet the one bound per group that comes out, a table of the size
of the registry, which Spark broadcasts below its limit. ``status`` other than 200 or a body
that does not parse is a failed page. Page caps are off unless a caller asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The numbers a rule needs, per system.
COUNTED = {
    "workday": "struct<total:bigint, jobPostings:array<struct<>>>",
    "smartrecruiters": "struct<totalFound:bigint, content:array<struct<>>>",
    "workable": "struct<total:bigint, nextPage:string, results:array<struct<shortcode:string>>>",
}
#: The field of a payload that says how many rows there are in all.
TOTALS = {"workday": "total", "smartrecruiters": "totalFound", "workable": "total"}
#: Columns of landed pages that rules read.
NUMBERS = ("failed", "rows", "total", "codes", "more")
GROUPS = {"workday": ["board", "term"], "smartrecruiters": ["board"], "workable": ["board"]}
#: Landed pages for one task to meet their bounds. Spark sizes tasks and broadcasts by compressed
#: bytes, and pages of boards that are alike take over ten times these in memory.
PAGES_A_TASK = 1 << 20


def usable(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("status") == 200) & F.col("doc").isNotNull())


def _count(items: Column) -> Column:
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def capped(pages: DataFrame, max_pages: int | None) -> DataFrame:
    return pages if max_pages is None else pages.where(F.col("page_no") < max_pages)


def numbers(pages: DataFrame, ats: str, items: str, total: str) -> DataFrame:
    """Per page: its group, ``page_no``, ``failed``, ``rows``, ``total`` and, for Workable,
    ``codes`` (rows with a shortcode) and ``more`` (whether there is a next page).

    Landed pages have these columns; others are parsed for them."""
    if set(NUMBERS) <= set(pages.columns):
        return pages.select(*GROUPS[ats], "page_no", *NUMBERS)
    text = F.ltrim("body")
    doc = F.from_json(F.when(text.startswith("{"), text), COUNTED[ats])
    read = pages.select(*GROUPS[ats], "page_no", "status", doc.alias("_doc"))
    out = {
        "failed": (F.coalesce("status", F.lit(0)) != 200) | F.col("_doc").isNull(),
        "rows": _count(F.col(f"_doc.{items}")).cast("bigint"),
        "total": F.coalesce(f"_doc.{total}", F.lit(0)),
    }
    if ats == "workable":
        coded = F.filter("_doc.results", lambda r: F.coalesce(r["shortcode"], F.lit("")) != "")
        out["codes"] = _count(coded).cast("bigint")
        out["more"] = F.coalesce("_doc.nextPage", F.lit("")) != ""
    return read.select(*GROUPS[ats], "page_no", *[c.alias(n) for n, c in out.items()])


def _so_far(count: str) -> Column:
    # A window over the numbers of one board's pages, a few bytes each.
    pages = Window.partitionBy("board").orderBy("page_no")
    return F.sum(count).over(pages.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def rows_so_far(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """SmartRecruiters pages (board, page_no, ...) with ``rows`` and ``rows_so_far`` of the board."""
    counted = numbers(capped(pages, max_pages), "smartrecruiters", "content", "totalFound")
    return counted.withColumn("rows_so_far", _so_far("rows"))


def _until(pages: DataFrame, group: list[str], failed: Column, last: Column) -> DataFrame:
    """(group, until): pages below ``until`` count, those before the first failed one and up
    to and with the first last one. NULL if neither is among the pages."""
    return pages.groupBy(*group).agg(_bound(failed, last).alias("until"))


def _bound(failed: Column, last: Column) -> Column:
    first = F.when(failed, F.col("page_no")).when(last, F.col("page_no") + 1)
    return F.min(first)


def _counted(page: DataFrame, ats: str) -> DataFrame:
    """Pages with the running count that the system's rule looks at."""
    if ats == "smartrecruiters":
        return page.withColumn("rows_so_far", _so_far("rows"))
    return page.withColumn("_codes", _so_far("codes")) if ats == "workable" else page


def _ends(ats: str, page_limit: int = 0) -> tuple[Column, Column]:
    """Whether a page of ``_counted`` is failed, and whether it is the last."""
    failed, none = F.col("failed"), F.col("rows") == 0
    if ats == "workday":
        return failed | none, (F.col("page_no") + 1) * page_limit >= F.col("total")
    if ats == "smartrecruiters":
        return failed, none | (F.col("rows_so_far") >= F.col("total"))
    return failed, none | ~F.col("more") | (F.col("_codes") >= F.col("total"))


def workday_until(pages: DataFrame, page_limit: int) -> DataFrame:
    """Per term: stop at a failed or empty page, or once the offset reaches total."""
    page = numbers(pages, "workday", "jobPostings", "total")
    return _until(page, GROUPS["workday"], *_ends("workday", page_limit))


def smartrecruiters_until(pages: DataFrame) -> DataFrame:
    """Stop at a failed page, an empty one, or once the rows so far reach totalFound."""
    return _until(rows_so_far(pages), GROUPS["smartrecruiters"], *_ends("smartrecruiters"))


def workable_until(pages: DataFrame) -> DataFrame:
    """As above, counting rows with a shortcode; also stop without a next page."""
    page = _counted(numbers(pages, "workable", "results", "total"), "workable")
    return _until(page, GROUPS["workable"], *_ends("workable"))


def _until_of(pages: DataFrame, ats: str, page_limit: int) -> DataFrame:
    if ats == "workday":
        return workday_until(pages, page_limit)
    return smartrecruiters_until(pages) if ats == "smartrecruiters" else workable_until(pages)


def below_landed(pages: DataFrame, ats: str, page_limit: int) -> DataFrame:
    """The pages that count, of landed ones; what fits one task is left to Spark, the rest is dealt by group.

    A task then holds the numbers and bounds of its pages; their items only stream past, unsorted."""
    group = GROUPS[ats]
    pages = pages.dropna(subset=group)
    few = pages.select(*group, "page_no", *NUMBERS)
    n = -(-pages.count() // PAGES_A_TASK)
    if n <= 1:
        return below(pages, _until_of(few, ats, page_limit), group)
    n = max(n, pages.sparkSession.sparkContext.defaultParallelism)
    until = _until_of(few.repartition(n, *group), ats, page_limit)
    return below(pages.repartition(n, *group), until.hint("shuffle_hash"), group)


def below_at_once(pages: DataFrame, ats: str, page_limit: int) -> DataFrame:
    """The pages that count, of pages with NUMBERS: they move once, items and all, and are not joined."""
    group = GROUPS[ats]
    bound = _bound(*_ends(ats, page_limit)).over(Window.partitionBy(*group))
    kept = _counted(pages.dropna(subset=group), ats).withColumn("until", bound)
    return kept.where(F.col("page_no") < F.coalesce("until", F.col("page_no") + 1)).drop("until", "rows_so_far", "_codes")


def below(pages: DataFrame, until: DataFrame, group: list[str]) -> DataFrame:
    """The pages that count."""
    kept = pages.join(until, group)
    return kept.where(F.col("page_no") < F.coalesce("until", F.col("page_no") + 1)).drop("until")
