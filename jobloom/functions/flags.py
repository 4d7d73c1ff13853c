"""Sponsorship, clearance and graduation-year flags of a description.

The patterns read text that has been through ``flag_text``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import flag_text

# Flag patterns.
NO_SPONSOR = (
    r"(?:not|unable|cannot|can ?not|won'?t|will not|do(?:es)? not)"
    r"(?: \w+){0,3} sponsor",
    r"no (?:visa |work |immigration )?sponsorship",
    r"sponsorship (?:is )?(?:not (?:available|offered|provided)|unavailable)",
    r"without (?:visa |employer |the need for )?sponsorship",
    r"not (?:offer|provide|be able)[^.]{0,30}sponsor",
    r"(?:u\.?s\.?|united states) citizen(?:ship)?(?: is)? required",
    r"must be (?:a )?(?:u\.?s\.?|united states) citizen",
)
YES_SPONSOR = (
    r"(?:visa |h-?1b |immigration )?sponsorship (?:is )?available",
    r"will (?:consider )?sponsor",
    r"(?:offer|provide)s? (?:visa |immigration |work )?sponsorship",
    r"open to (?:visa )?sponsorship",
)
NO_CLEARANCE = (
    r"(?:no|not)[^.]{0,40}clearance",
    r"clearance[^.]{0,20}not required",
)
CLEARANCE = (
    r"security clearance",
    r"ts\W{0,2}sci",
    r"top secret",
    r"secret clearance",
    r"public trust",
    r"clearance (?:is )?required",
    r"able to obtain[^.]{0,30}clearance",
)
GRAD_WORDS = r"graduat\w*|class of|degree completion"
GRAD_YEAR = r"\b(20\d{2})\b"
FIRST_GRAD_YEAR, LAST_GRAD_YEAR = 2024, 2032


def _any_of(col: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col.rlike(f"(?U){p}") for p in patterns])


def sponsorship(t: Column) -> Column:
    """'no' beats 'yes'. Every pattern needs 'sponsor' or 'citizen' in the text."""
    sponsor = t.contains("sponsor")
    no = (sponsor | t.contains("citizen")) & _any_of(t, NO_SPONSOR)
    return F.when(no, "no").when(sponsor & _any_of(t, YES_SPONSOR), "yes").otherwise("")


def clearance(t: Column) -> Column:
    return F.when(_any_of(t, CLEARANCE) & ~_any_of(t, NO_CLEARANCE), "yes").otherwise("")


def grad_years(t: Column) -> Column:
    """Years of the sentences that speak of graduation: distinct, sorted, joined."""
    sentences = F.filter(F.split(t, r"\."), lambda s: s.rlike(f"(?U){GRAD_WORDS}"))
    years = F.flatten(
        F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(f"(?U){GRAD_YEAR}"), 1))
    )
    kept = F.filter(
        years, lambda y: y.try_cast("int").between(FIRST_GRAD_YEAR, LAST_GRAD_YEAR)
    )
    joined = F.array_join(F.sort_array(F.array_distinct(kept)), ", ")
    return F.when(t.contains("20"), joined).otherwise("")


def with_flags(df: DataFrame, description: str) -> DataFrame:
    """Add the three flags. The cleaned text is a column of its own, so that the
    regexes share it."""
    t = F.col("_flag_text")
    cleaned = df.withColumn("_flag_text", flag_text(F.col(description)))
    return cleaned.withColumns(
        {"sponsorship": sponsorship(t), "clearance": clearance(t), "grad_year": grad_years(t)}
    ).drop("_flag_text")
