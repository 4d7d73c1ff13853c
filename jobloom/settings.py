"""Run settings. Plain configuration, never data."""

from __future__ import annotations

from dataclasses import dataclass

WORKDAY_PAGE_LIMIT = 20
HOURS_OLD = 72
MESSAGE_SIZE = 10


@dataclass(frozen=True)
class Settings:
    """Caps are for callers that want them; by default every landed page and row counts."""

    page_limit: int = WORKDAY_PAGE_LIMIT
    max_pages_per_term: int | None = None
    smartrecruiters_pages: int | None = None
    workable_pages: int | None = None
    results_per_term: int | None = None
    hours_old: int = HOURS_OLD
    enrich_descriptions: bool = True
    exclude_no_sponsorship: bool = False
    keep_snapshots: int | None = None
