"""One run: batch, dedupe, reconcile, suppress, enrich, publish."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators import enrich as en
from jobloom.operators import publish as pub
from jobloom.operators import reconcile as rc
from jobloom.operators.dedupe import cross_source_dedupe, cross_source_marked
from jobloom.operators.scoring import Scorer, score_titles
from jobloom.session import recorded, remove, stored
from jobloom.settings import Settings
from jobloom.sources.aggregator import read_listings, source_filters
from jobloom.sources.deltas import DeltaStore
from jobloom.sources.labels import LabelStore
from jobloom.sources.paging import GROUPS
from jobloom.sources.payloads import READERS, landed, of_boards, read_boards, union_all, with_listings


@dataclass
class Run:
    """Tables of one run. All are DataFrames; nothing is held on the driver."""

    state: DataFrame
    new_jobs: DataFrame
    fresh: DataFrame
    messages: DataFrame
    sheet_rows: DataFrame
    counters: DataFrame


Keep = Callable[[DataFrame, str], DataFrame]


def run(
    postings: DataFrame,
    state: DataFrame,
    now: str,
    details: DataFrame | None = None,
    settings: Settings = Settings(),
    scorer: Callable[[], Scorer] | None = None,
    keep: Keep = stored,
    complete_sources: Sequence[str] | None = None,
    store: DeltaStore | None = None,
    boards: DataFrame | None = None,
    labels: LabelStore | None = None,
) -> Run:
    """Process one whole batch against the state before it.

    ``keep(df, name)`` stores a table that several outputs read, so that it is
    computed once and no plan grows over several steps. Tables of a step go once nothing reads them
    any more, if ``keep`` stores them as ``written`` does. Descriptions stay out of
    the shuffles: they are fetched for the few jobs that are announced.
    ``details`` are landed detail payloads, ``boards`` whole Ashby boards (slug, status, body); of
    several versions the newest up to ``now`` counts. ``scorer`` builds a model for titles
    without a keyword label; with ``labels`` only titles that store lacks are scored. ``complete_sources`` names the sources whose jobs may be removed
    for being absent, where others failed; by default all.

    With a ``store`` of deltas, whose ``read`` gives ``state``, only changed rows are stored and
    ``state`` of the result has no others; keys of active rows come from the store's index.
    """
    return _run(postings, [], state, now, details, settings, scorer, keep, complete_sources, store, boards, labels)


def _run(
    postings: DataFrame,
    posted: list[str],
    state: DataFrame,
    now: str,
    details: DataFrame | None,
    settings: Settings,
    scorer: Callable[[], Scorer] | None,
    keep: Keep,
    complete_sources: Sequence[str] | None,
    store: DeltaStore | None = None,
    boards: DataFrame | None = None,
    labels: LabelStore | None = None,
) -> Run:
    """``run``; ``posted`` are folders of the postings, which go as soon as their marks and descriptions are stored."""
    spark = postings.sparkSession
    slim = postings.drop("description")
    with recorded() as marks:
        marked = keep(cross_source_marked(slim, keep=keep).drop("fuzzy_key"), "batch")
    totals = keep(batch_counts(marked), "totals")
    with recorded() as texts:
        if posted and settings.enrich_descriptions:
            postings = keep(rc.described(postings), "descriptions")
    remove(spark, *posted)
    kept = marked.where(~F.col("dropped"))
    if store is None:
        rows, prior = rc.reconcile(kept, state, now, complete_sources=complete_sources), rc.active_keys(state)
    else:
        rows = rc.changes(kept, state, now, store.last_ts(), complete_sources=complete_sources)
        prior = store.active_keys()
    reconciled = keep(rows, "reconciled")
    if store is None:  # else the counters count the rows that were reconciled
        remove(spark, *marks)
    if scorer is not None:
        titles = rc.undecided(reconciled).select("title").distinct()
        scored = score_titles(titles, scorer) if labels is None else labels.labelled(titles, scorer, now)
        reconciled = keep(rc.with_scored_roles(reconciled, keep(scored, "labels")), "scored")

    new_jobs = rc.new_jobs(reconciled)
    with recorded() as keyed:
        fresh = rc.without_relistings(new_jobs, prior, keep=keep)
    with recorded() as unflagged:
        fresh = keep(fresh, "fresh")
    remove(spark, *keyed)
    after = rc.next_state(reconciled)
    if settings.enrich_descriptions:
        with recorded() as looked_up:
            targets = rc.with_descriptions(en.targets(fresh), postings)
            flagged = en.enrich(targets, details, boards=boards, as_of=now if boards is not None else None, keep=keep)
        flagged = keep(flagged.select("job_id", *rc.FLAGS), "flagged")
        fresh = keep(rc.merge_flags(fresh, flagged), "fresh-flagged")
        remove(spark, *texts, *looked_up, *unflagged)
        after = rc.flagged_state(reconciled, flagged)
    if store is not None:
        after = after.join(reconciled.select("job_id", "before"), "job_id")
    told = en.without_no_sponsorship(fresh) if settings.exclude_no_sponsorship else fresh

    return Run(
        state=after,
        new_jobs=new_jobs,
        fresh=fresh,
        messages=pub.messages(told),
        sheet_rows=pub.sheet_rows(told),
        counters=_counters(totals, reconciled, fresh, told, None if store is None else kept),
    )


def run_landed(
    registry: DataFrame,
    pages: DataFrame,
    listings: DataFrame | None,
    state: DataFrame,
    now: str,
    details: DataFrame | None = None,
    settings: Settings = Settings(),
    scorer: Callable[[], Scorer] | None = None,
    keep: Keep = stored,
    complete_sources: Sequence[str] | None = None,
    boards: DataFrame | None = None,
) -> Run:
    """A whole run from landed data: registered boards' pages and listings to all outputs.

    Bodies are parsed once, as pages are landed in columns; the batch is stored once too.
    ``pages`` carry ats, board_key, term, term_ord, page_no, status and body.
    """
    found = None
    if listings is not None:
        recent = source_filters(listings, now, settings.hours_old, settings.results_per_term)
        found = read_listings(recent)
    spark, boards_of = pages.sparkSession, []
    with recorded() as parts:
        # One paged system at a time, so that the shuffle files and pages of the others take no room.
        for systems in [[a] for a in GROUPS] + [[a for a in READERS if a not in GROUPS]]:
            theirs = F.col("ats").isin(systems)
            with recorded() as landing:
                parsed = landed(of_boards(pages.where(theirs), registry.where(theirs)), keep)
            boards_of.append(read_boards(parsed, settings, keep, systems))
            if systems[0] in GROUPS:
                remove(spark, *landing)
    with recorded() as posted:
        batch = keep(with_listings(union_all(boards_of), found), "postings")
    remove(spark, *parts)
    return _run(batch, posted, state, now, details, settings, scorer, keep, complete_sources, boards=boards)


def batch_counts(marked: DataFrame) -> DataFrame:
    """One row: the batch's rows, and those dropped as duplicates of another source."""
    return marked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("dropped").alias("cross_dropped")
    )


def counters(
    marked: DataFrame, reconciled: DataFrame, fresh: DataFrame, told: DataFrame, batch: DataFrame | None = None
) -> DataFrame:
    """One row of run counters, from four one-row aggregates; ``batch`` is that of ``change_counts``."""
    return _counters(batch_counts(marked), reconciled, fresh, told, batch)


def _counters(
    total: DataFrame, reconciled: DataFrame, fresh: DataFrame, told: DataFrame, batch: DataFrame | None
) -> DataFrame:
    left = fresh.agg(F.count(F.lit(1)).alias("_fresh"))
    out = told.agg(F.count(F.lit(1)).alias("_told"))
    rows = [total, rc.change_counts(reconciled, batch), left, out]
    one = rows[0].withColumn("_one", F.lit(1))
    for other in rows[1:]:
        one = one.join(other.withColumn("_one", F.lit(1)), "_one")
    return one.select(
        "total",
        "cross_dropped",
        "new_jobs",
        "updated",
        "removed",
        (F.col("new_jobs") - F.col("_fresh")).alias("suppressed"),
        (F.col("_fresh") - F.col("_told")).alias("excluded"),
    )


def announceable_jobs(
    postings: DataFrame, state: DataFrame, now: str, keep: Keep = stored
) -> DataFrame:
    """New US intern and new-grad jobs of a run, without the other outputs."""
    kept = cross_source_dedupe(postings.drop("description"))
    new_jobs = rc.new_jobs(rc.reconcile(kept, state, now))
    told = keep(pub.to_announce(new_jobs), "announceable")
    return rc.without_relistings(told, rc.active_keys(state))
