"""Board addresses in text, board liveness, and merging boards into the registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.keys import board_key
from jobloom.functions.text import percent_decode, slug_clean
from jobloom.operators.dedupe import first_per_key
from jobloom.operators.ranking import global_row_number
from jobloom.session import written
from jobloom.schemas import BOARD_COLS, CANDIDATE_COLS

# Board addresses, and captures that are not boards.
WORKDAY_URL = (
    r"https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com"
    r"/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)"
)
GREENHOUSE_URLS = (
    r"boards(?:-api)?\.greenhouse\.io(?:/v1/boards)?/([a-z0-9_-]+)",
    r"job-boards(?:\.eu)?\.greenhouse\.io/([a-z0-9_-]+)",
    r"greenhouse\.io/embed/job_board\?[^\s\"'<>]*?for=([a-z0-9_-]+)",
)
LEVER_URL = r"jobs\.lever\.co/([A-Za-z0-9_-]+)"
ASHBY_URL = r"jobs\.ashbyhq\.com/([A-Za-z0-9_.%-]+)"
SMARTRECRUITERS_URL = (
    r"(?:jobs|careers)\.smartrecruiters\.com/(?:oneclick-ui/company/)?([A-Za-z0-9]+)"
)
WORKABLE_URL = r"apply\.workable\.com/([a-z0-9-]+)"
NOT_BOARDS = {
    "workday": ("wday", "cxs", "assets", "static", "login", "fonts"),
    "greenhouse": ("v1", "boards", "jobs", "embed", "js", "generic", "internal"),
    "lever": (),
    "ashby": ("api",),
    "smartrecruiters": ("sitemap", "favicon"),
    "workable": ("api", "j", "jobs", "assets"),
}

ANY_CASE = "(?iu)"
LOWERED = "_lowered"

Link = Callable[[Column], Column]


def _none() -> Column:
    return F.lit(None).cast("string")


def _link(ats: str, rule: int, slug: Column, name: Column, **workday: Column) -> Column:
    cols = {"tenant": _none(), "wd": _none(), "site": _none(), "slug": slug} | workday
    key = board_key(F.lit(ats), cols["tenant"], cols["wd"], cols["site"], cols["slug"])
    return F.struct(
        F.lit(ats).alias("ats"),
        key.alias("board_key"),
        *[c.cast("string").alias(n) for n, c in cols.items()],
        name.alias("name"),
        F.lit(rule).alias("rule"),
    )


def _all(body: Column, host: str, pattern: str, link: Link, group: int = 1) -> Column:
    """Links of all matches. The regex runs only where the host occurs.

    Both cases of the body are columns: written out for each of the eight rules,
    ``lower`` would run eight times.
    """
    found = F.regexp_extract_all(body, F.lit(ANY_CASE + pattern), group)
    return F.when(F.col(LOWERED).contains(host), F.transform(found, link))


def _proper(ats: str, links: Column, token: Callable[[Column], Column]) -> Column:
    bad = NOT_BOARDS.get(ats, ())
    return F.filter(links, lambda x: ~F.lower(token(x)).isin(*bad)) if bad else links


def _workday_links(body: Column) -> list[Column]:
    def link(url: Column) -> Column:
        tenant, wd, site = [
            F.regexp_extract(url, ANY_CASE + WORKDAY_URL, i) for i in (1, 2, 3)
        ]
        tenant, wd = F.lower(tenant), F.lower(wd)
        return _link("workday", 0, _none(), tenant, tenant=tenant, wd=wd, site=site)

    links = _all(body, ".myworkdayjobs.com/", WORKDAY_URL, link, group=0)
    return [_proper("workday", links, lambda x: x["site"])]


def slug_links(
    ats: str,
    host: str,
    patterns: tuple[str, ...],
    clean: Link = F.lower,
    name: Link = lambda slug: slug,
) -> Link:
    def rule_links(body: Column, rule: int, pattern: str) -> Column:
        def link(raw: Column) -> Column:
            return _link(ats, rule, clean(raw), name(clean(raw)))

        return _proper(ats, _all(body, host, pattern, link), lambda x: x["slug"])

    return lambda body: [rule_links(body, i, p) for i, p in enumerate(patterns)]


def listed(path: str) -> Link:
    """Alive: the list at ``path`` is not empty."""
    return lambda body: F.coalesce(
        F.json_array_length(F.get_json_object(body, path)) > 0, F.lit(False)
    )


def counted(path: str) -> Link:
    """Alive: the number at ``path`` is not zero."""
    return lambda body: F.coalesce(
        F.get_json_object(body, path).try_cast("bigint") != 0, F.lit(False)
    )


@dataclass(frozen=True)
class Ats:
    """What it takes to support a system: find its links, tell a live board."""

    name: str
    links: Callable[[Column], list[Column]]
    alive: Link
    crawl_patterns: tuple[str, ...]


# Adding a system is one entry here.
ATS: dict[str, Ats] = {
    a.name: a
    for a in (
        Ats("workday", _workday_links, listed("$.jobPostings"), ("*.myworkdayjobs.com/*",)),
        Ats(
            "greenhouse",
            slug_links("greenhouse", "greenhouse.io/", GREENHOUSE_URLS),
            listed("$.jobs"),
            ("boards.greenhouse.io/*", "job-boards.greenhouse.io/*"),
        ),
        Ats(
            "lever",
            slug_links("lever", "jobs.lever.co/", (LEVER_URL,)),
            listed("$"),
            ("jobs.lever.co/*",),
        ),
        Ats(
            "ashby",
            slug_links("ashby", "jobs.ashbyhq.com/", (ASHBY_URL,), slug_clean, percent_decode),
            listed("$.jobs"),
            ("jobs.ashbyhq.com/*",),
        ),
        Ats(
            "smartrecruiters",
            slug_links(
                "smartrecruiters", ".smartrecruiters.com/", (SMARTRECRUITERS_URL,), lambda s: s
            ),
            counted("$.totalFound"),
            ("jobs.smartrecruiters.com/*", "careers.smartrecruiters.com/*"),
        ),
        Ats(
            "workable",
            slug_links("workable", "apply.workable.com/", (WORKABLE_URL,)),
            counted("$.total"),
            ("apply.workable.com/*",),
        ),
    )
}


def systems(spark: SparkSession) -> DataFrame:
    """One row per system, so that reports show systems without boards as 0."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ATS))).alias("ats"))


def pattern_system(pattern: Column, among: dict[str, Ats] = ATS) -> Column:
    """System whose crawl pattern this is."""
    return F.coalesce(
        *[F.when(pattern.isin(*a.crawl_patterns), a.name) for a in among.values()]
    )


def board_links(
    body: Column, among: dict[str, Ats] = ATS, queried: Column | None = None
) -> Column:
    """All board links of a text, system by system, as an array of structs.

    The text in lower case is expected in column ``_lowered``. With ``queried`` only the links of the system it names are looked for.
    """
    empty = F.array().cast(
        "array<struct<ats:string,board_key:string,tenant:string,wd:string,"
        "site:string,slug:string,name:string,rule:int>>"
    )

    def links(a: Ats) -> list[Column]:
        asked = F.lit(True) if queried is None else queried == a.name
        return [F.coalesce(F.when(asked, x), empty) for x in a.links(body)]

    return F.concat(*[x for a in among.values() for x in links(a)])


def extract_boards(
    texts: DataFrame,
    body: str = "body",
    among: dict[str, Ats] = ATS,
    queried: Column | None = None,
) -> DataFrame:
    """One row per link with the text's other columns and ``pos``; no shuffle."""
    rest = [c for c in texts.columns if c != body]
    found = board_links(F.col(body), among, queried)
    texts = texts.withColumn(LOWERED, F.lower(body))
    return texts.select(*rest, F.posexplode(found).alias("pos", "x")).select(*rest, "pos", "x.*")


def alive(ats: Column, body: Column, among: dict[str, Ats] = ATS) -> Column:
    """Whether a probe's body shows a board with jobs."""
    tests = [F.when(ats == a.name, a.alive(body)) for a in among.values()]
    return F.coalesce(*tests, F.lit(False))


def live_probes(probes: DataFrame) -> DataFrame:
    ok = (F.col("status") == 200) & alive(F.col("ats"), F.col("body"))
    return probes.where(ok)


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """The first candidate of every (ats, board_key)."""
    return first_per_key(candidates, ["ats", "board_key"])


def not_registered(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct candidates the registry lacks. Both sides are unique per key, so
    Spark's own choice of join (broadcast only below its size limit) does."""
    known = registry.select("ats", "board_key").distinct()
    return candidates.join(known, ["ats", "board_key"], "left_anti")


def validated(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    live = live_probes(probes).select("ats", "board_key").distinct()
    return candidates.join(live, ["ats", "board_key"], "left_semi")


def union_candidates(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select(*CANDIDATE_COLS) for s in sources])


def merge_registry(registry: DataFrame, survivors: DataFrame) -> DataFrame:
    """Existing boards in their order, then the survivors in order of discovery.

    New boards are numbered on from the system's last ``ord``, without gaps, however large
    their ``seq``: positions over all survivors, less those of the systems before.
    """
    known = registry.where(F.col("ats").isin(*ATS))
    # One row per system of ATS, so six at most.
    ends = known.groupBy("ats").agg(F.max("ord").alias("_end"))
    numbered = written(global_row_number(survivors, ["ats", "seq", "board_key"], "_pos"), "survivors")
    starts = numbered.groupBy("ats").agg(F.min("_pos").alias("_start")).join(ends, "ats", "left")
    placed = numbered.join(F.broadcast(starts), "ats").withColumn(
        "ord", F.coalesce("_end", F.lit(-1)) + 1 + F.col("_pos") - F.col("_start")
    )
    return registry.select(*BOARD_COLS).unionByName(placed.select(*BOARD_COLS))


def added_counts(survivors: DataFrame) -> DataFrame:
    """Boards added per system, 0 included."""
    counts = survivors.groupBy("ats").agg(F.count(F.lit(1)).alias("added"))
    return systems(survivors.sparkSession).join(counts, "ats", "left").na.fill(0, ["added"])

