"""Role type from a title, by ordered keyword rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import text
from jobloom.schemas import ANNOUNCE_ROLES, DEFAULT_ROLE, ROLE_TYPES

# Rules, first match wins.
ROLE_RULES = (
    (r"\b(intern|internship|co-?op|summer\s+(?:analyst|associate))\b", "intern"),
    (
        r"\b(new\s*grad|new\s*graduate|university\s*grad|campus|early\s*career|"
        r"entry[\s-]*level|graduate\s+(?:program|engineer|analyst)|associate\s+"
        r"(?:engineer|developer))\b",
        "new_grad",
    ),
    (
        r"\b(senior|sr\.?|staff|principal|lead|architect|distinguished|"
        r"director|head\s+of|vp|manager|mgr|fellow)\b",
        "senior",
    ),
    (r"\b(iii|iv|v)\b", "senior"),
    (r"\b(ii)\b", "mid"),
    (r"\b\d{2,}\+?\s*years?\b", "senior"),
)

# What a scorer is asked to choose from.
SCORER_LABELS = {
    "intern": "internship, co-op, or summer position for students",
    "new_grad": "entry-level position for new or recent graduates",
    "mid": "mid-level position requiring a few years of experience",
    "senior": "senior, staff, lead, principal, or management role",
}

# Place names that mark a location as outside the US.
NON_US_KEYWORDS = (
    "canada", "uk", "united kingdom", "germany", "france", "india", "china", "japan",
    "australia", "singapore", "ireland", "netherlands", "spain", "italy", "poland",
    "brazil", "mexico", "israel", "sweden", "switzerland", "remote - non us",
)


def keyword_role(title: Column) -> Column:
    """Label of the first rule that matches, else NULL."""
    title = text(title)
    return F.coalesce(
        *[F.when(title.rlike(f"(?iuU){rule}"), F.lit(label)) for rule, label in ROLE_RULES]
    )


def role(title: Column, scored: Column | None = None) -> Column:
    """Keyword label, else the scorer's label, else the default."""
    options = [keyword_role(title)] + ([] if scored is None else [scored])
    return F.coalesce(*options, F.lit(DEFAULT_ROLE))


def role_rank(role_type: Column) -> Column:
    ranks = F.coalesce(
        *[F.when(role_type == name, F.lit(i)) for i, name in enumerate(ROLE_TYPES)]
    )
    return F.coalesce(ranks, F.lit(99))


def announceable(role_type: Column) -> Column:
    return F.coalesce(role_type.isin(*ANNOUNCE_ROLES), F.lit(False))


def in_us(location: Column) -> Column:
    """False only if a non-US keyword occurs anywhere in the location.

    The match is by substring, so "Indianapolis" (india) is refused as well.
    """
    return ~F.lower(text(location)).rlike("|".join(NON_US_KEYWORDS))
