"""Registry growth: harvested texts to candidates to validated boards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.keys import link_seq
from jobloom.operators import boards as b
from jobloom.schemas import CANDIDATE_COLS
from jobloom.session import written
from jobloom.sources import harvest as hv
from jobloom.sources.aggregator import URL_COLS, listing_urls


#: Harvest sources in the order in which their candidates count.
ORIGINS = ("seeds", "lists", "listings", "index")
#: Room for the texts of one source in the order of all.
ROOM = 1 << 50


@dataclass
class Discovery:
    distinct: DataFrame
    survivors: DataFrame
    registry: DataFrame


def candidates(
    texts: DataFrame, origin: str, order: str, body: str = "body", among=b.ATS
) -> DataFrame:
    """Candidates of one harvest source, in the order of its texts."""
    found = b.extract_boards(texts.select(F.col(order).alias("_doc"), body), body, among)
    return _placed(found, origin)


def crawl_candidates(urls: DataFrame, order: str, among=b.ATS) -> DataFrame:
    """Candidates of URL-index rows (``pattern``, ``url``).

    A row is searched for the system whose pattern it answers, and for no other.
    """
    rows = urls.select(F.col(order).alias("_doc"), "pattern", "url")
    queried = b.pattern_system(F.col("pattern"), among)
    return _placed(b.extract_boards(rows, "url", among, queried), "index")


def _placed(found: DataFrame, origin: str) -> DataFrame:
    seq = link_seq(F.col("_doc"), F.col("pos"))
    return found.withColumns({"origin": F.lit(origin), "seq": seq}).select(*CANDIDATE_COLS)


def numbered(texts: DataFrame, origin: str, order: str, body: str) -> DataFrame:
    """(doc, body): texts of a source, numbered after those of the sources before it."""
    place = F.col(order).cast("bigint")
    fits = F.when(place.between(0, ROOM - 1), place).otherwise(F.raise_error(F.lit(f"order of {origin} out of range")).cast("bigint"))
    return texts.select((fits + ORIGINS.index(origin) * ROOM).alias("doc"), F.col(body).alias("body"))


def harvest(
    seeds: DataFrame | None = None,
    lists: DataFrame | None = None,
    listings: DataFrame | None = None,
    index: DataFrame | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Candidates of all sources that are given, with their origins.

    ``seeds`` are lines (line_no, value), ``lists`` whole published texts (doc_id, body), ``listings``
    rows of job-search sites, ``index`` JSON lines of a URL index (line_no, index_name, pattern, value).
    With a ``ledger`` only the (index, pattern) pairs that it does not list are read, and what they
    find is stored there; the candidates of all its pairs count, those of earlier crawls too.
    """
    parts = []
    if seeds is not None:
        parts.append(candidates(numbered(hv.seed_lines(seeds), "seeds", "line_no", "value"), "seeds", "doc"))
    if lists is not None:
        parts.append(candidates(numbered(lists, "lists", "doc_id", "body"), "lists", "doc"))
    if listings is not None:
        urls = listing_urls(listings)
        column = F.array_position(F.array(*map(F.lit, URL_COLS)), F.col("column")) - 1
        urls = urls.withColumn("place", F.col("seq") * len(URL_COLS) + column)
        parts.append(candidates(numbered(urls, "listings", "place", "url"), "listings", "doc"))
    if index is not None:
        spark, pairs = index.sparkSession, index.select("index_name", "pattern").distinct()
        if ledger is not None:
            pairs = written(hv.pending_pairs(pairs, hv.done_pairs(spark, ledger)), "pending-pairs")
            index = index.join(pairs, ["index_name", "pattern"], "left_semi")
        found = candidates(numbered(hv.index_urls(index), "index", "line_no", "url"), "index", "doc")
        if ledger is not None:
            hv.append_ledger(ledger, pairs, found)
            found = hv.ledger_candidates(spark, ledger)
        parts.append(found)
    return b.union_candidates(parts)


def discover(found: DataFrame, registry: DataFrame, probes: DataFrame) -> Discovery:
    # Stored, as several outputs read them: the first of each board is then looked for once.
    distinct = written(b.distinct_candidates(found), "distinct-candidates")
    survivors = written(b.validated(b.not_registered(distinct, registry), probes), "new-boards")
    return Discovery(distinct, survivors, b.merge_registry(registry, survivors))
