"""Labels for titles the keyword rules cannot decide, from a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.roles import SCORER_LABELS, keyword_role
from jobloom.operators.skew import HOT_ROWS, join_unique

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[str]]


def ambiguous_titles(postings: DataFrame) -> DataFrame:
    """Distinct titles no rule matches. Distinct comes first: it shrinks before
    the shuffle, and the rules then see each title once."""
    titles = postings.select("title").distinct()
    return titles.where(keyword_role(F.col("title")).isNull())


def score_titles(
    titles: DataFrame, factory: Callable[[], Scorer], tasks: int | None = None
) -> DataFrame:
    """(title, label): label NULL where the model fails or answers off the list.

    ``factory`` builds the model once per task; it is then called once per Arrow
    batch with the titles and the label texts, and returns the best text of each.
    ``tasks`` spreads few titles over many tasks, as a slow model needs; left to
    itself Spark packs them into few.
    """
    if tasks is not None:
        titles = titles.repartition(tasks, "title")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_text = {text: name for name, text in SCORER_LABELS.items()}
        try:
            model = factory()
        except Exception:
            model = None
        for batch in batches:
            names = [None] * len(batch)
            if model is not None:
                try:
                    best = model(list(batch["title"]), list(by_text))
                    names = [by_text.get(text) for text in best]
                except Exception:
                    names = [None] * len(batch)
            yield pd.DataFrame({"title": batch["title"], "label": names})

    return titles.select("title").mapInPandas(score, "title string, label string")


def join_labels(
    postings: DataFrame, labels: DataFrame, spread: str = "seq", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Postings with the label of their title, NULL if there is none."""
    return join_unique(postings, labels, ["title"], "left", spread, hot_rows)
