"""Reconciling a run with the persistent job state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.roles import keyword_role, role
from jobloom.functions.text import fuzzy_key
from jobloom.operators.dedupe import KeyFn, with_key
from jobloom.operators.skew import HOT_ROWS, hot_hashes, join_unique
from jobloom.schemas import DEFAULT_ROLE, STATE_COLS, STATE_DEFAULTS

RoleFn = Callable[[Column], Column]
FLAGS = ("sponsorship", "clearance", "grad_year")
FIRST_COLS = ("company", "title", "apply_url", "location", "posted_on", "source")
LAST_COLS = ("title", "apply_url", "location")
#: What the fuzzy key of an active row is made of.
KEY_COLS = ("company", "title", "location", "status")


def upgrade_state(state: DataFrame) -> DataFrame:
    """Add the columns an older state lacks, with their defaults."""
    have = set(state.columns)
    missing = {c: F.lit(STATE_DEFAULTS[c]) for c in STATE_DEFAULTS if c not in have}
    return state.withColumns(missing).select(*STATE_COLS)


def known_ids(state: DataFrame) -> DataFrame:
    """Every id ever seen, removed ones too."""
    return state.select("job_id")


def active_keys(state: DataFrame, key_fn: KeyFn = fuzzy_key) -> DataFrame:
    """Fuzzy keys of the active rows, one row per job that has a key."""
    keyed = with_key(state.where(F.col("status") == "active"), key_fn)
    return keyed.where(F.col("fuzzy_key").isNotNull()).select("fuzzy_key")


def unseen(postings: DataFrame, state: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Postings whose id the state has never held."""
    return join_unique(postings, known_ids(state), ["job_id"], "left_anti", "seq", hot_rows)


def without_relistings(
    jobs: DataFrame,
    prior_keys: DataFrame,
    spread: str = "job_id",
    key_fn: KeyFn = fuzzy_key,
    hot_rows: int = HOT_ROWS,
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Jobs whose key no prior active row has; a job without a key always stays.

    ``prior_keys`` has fuzzy_key, or their hashes as the index of a ``DeltaStore`` gives them. The
    keys of the jobs are read twice, to find hot ones and to join: ``keep`` stores the jobs with
    them in between, so that each is computed once, and the hot keys, so that Spark sees how few
    they are and does not shuffle the jobs for them.
    """
    keyed = with_key(jobs, key_fn)
    key = prior_keys.columns[0]
    if key == "key":
        keyed = keyed.withColumn("key", F.unhex(F.md5("fuzzy_key")))
    keyed = keyed if keep is None else keep(keyed, "keyed-jobs")
    hot = None if keep is None else keep(hot_hashes(keyed, [key], hot_rows), "hot-keys")
    kept = join_unique(keyed, prior_keys, [key], "left_anti", spread, hot_rows, hot, reduce=[])
    return kept.drop("fuzzy_key", "key")


def batch_by_id(postings: DataFrame) -> DataFrame:
    """One row per id: the first row, what the last row overwrites, and the count."""
    first = [c for c in (*FIRST_COLS, "description") if c in postings.columns]
    return postings.groupBy("job_id").agg(
        F.min_by(F.struct("seq", *first), F.col("seq")).alias("first"),
        F.max_by(F.struct(*LAST_COLS), F.col("seq")).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )


def reconcile(
    postings: DataFrame,
    state: DataFrame,
    now: str,
    role_for: RoleFn = role,
    complete_sources: Sequence[str] | None = None,
) -> DataFrame:
    """Full outer join of the batch, one row per id, with the state.

    Gives the next state's columns plus ``change`` (new, updated, removed or
    kept), ``n`` (rows of the batch with this id) and ``first`` (the batch's first
    row). Both sides are unique on ``job_id``, so no key can be hot here.

    ``role_for`` maps the last title of a new id to its role. An active row that the
    batch lacks is removed; ``complete_sources`` limits that to the sources named,
    for runs in which other sources failed. Postings may come without their
    descriptions, which are the bulk of a batch and not needed here.
    """
    return _reconciled(postings, state, now, role_for, complete_sources).drop("old")


def changes(
    postings: DataFrame,
    state: DataFrame,
    now: str,
    since: str | None,
    role_for: RoleFn = role,
    complete_sources: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``reconcile`` that a state of deltas has to store, with ``before``.

    ``since`` is the time of the run before, which stands for the ``last_seen`` of the rows it
    saw. A row that is only seen again needs no new one; one that is active but was not seen,
    by that run or by this one, does. ``before`` has the old company, title, location and status.
    """
    rows = _reconciled(postings, state, now, role_for, complete_sources)
    updated, kept = F.col("change") == "updated", F.col("change") == "kept"
    differs = F.lit(False)
    for c in (*LAST_COLS, "status"):
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old.{c}"))
    seen_before = F.col("old.last_seen").eqNullSafe(F.lit(since))
    altered = (
        F.col("change").isin("new", "removed")
        | (updated & (differs | ~seen_before))
        | (kept & (F.col("status") == "active") & seen_before)
    )
    before = F.when(F.col("old").isNotNull(), F.struct(*[F.col(f"old.{c}").alias(c) for c in KEY_COLS]))
    return rows.where(altered).withColumn("before", before).drop("old")


def _reconciled(
    postings: DataFrame,
    state: DataFrame,
    now: str,
    role_for: RoleFn,
    complete_sources: Sequence[str] | None,
) -> DataFrame:
    batch = batch_by_id(postings)
    old = state.select("job_id", F.struct(*STATE_COLS[1:]).alias("old"))
    rows = batch.join(old, "job_id", "full_outer")

    in_batch, in_state = F.col("n").isNotNull(), F.col("old").isNotNull()
    goes = ~in_batch & (F.col("old.status") == "active")
    if complete_sources is not None:
        goes = goes & F.col("old.source").isin(*complete_sources)
    change = (
        F.when(in_batch & ~in_state, "new")
        .when(in_batch, "updated")
        .when(goes, "removed")
        .otherwise("kept")
    )
    rows = rows.withColumn("change", change)
    is_new, seen, gone = F.col("change") == "new", in_batch, F.col("change") == "removed"

    label = role_for(F.col("last.title"))

    def frozen(name: str) -> Column:
        return F.when(is_new, F.col(f"first.{name}")).otherwise(F.col(f"old.{name}"))

    def refreshed(name: str) -> Column:
        return F.when(seen, F.col(f"last.{name}")).otherwise(F.col(f"old.{name}"))

    def blank(name: str) -> Column:
        return F.when(is_new, F.lit("")).otherwise(F.col(f"old.{name}"))

    return rows.select(
        "job_id",
        frozen("company").alias("company"),
        refreshed("title").alias("title"),
        refreshed("apply_url").alias("apply_url"),
        refreshed("location").alias("location"),
        F.when(is_new, F.coalesce(label, F.lit(DEFAULT_ROLE)))
        .otherwise(F.col("old.role_type"))
        .alias("role_type"),
        frozen("posted_on").alias("posted_on"),
        F.when(is_new, F.coalesce("first.source", F.lit("workday")))
        .otherwise(F.col("old.source"))
        .alias("source"),
        *[blank(c).alias(c) for c in FLAGS],
        F.when(is_new, F.lit(now)).otherwise(F.col("old.first_seen")).alias("first_seen"),
        F.when(seen | gone, F.lit(now)).otherwise(F.col("old.last_seen")).alias("last_seen"),
        F.when(seen, F.lit("active"))
        .when(gone, F.lit("removed"))
        .otherwise(F.col("old.status"))
        .alias("status"),
        "change",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "first",
        "old",
    )


def undecided(reconciled: DataFrame) -> DataFrame:
    """New rows whose (last) title no keyword rule decides."""
    return reconciled.where(
        (F.col("change") == "new") & keyword_role(F.col("title")).isNull()
    )


def with_scored_roles(reconciled: DataFrame, labels: DataFrame) -> DataFrame:
    """Roles of the undecided rows from ``labels`` (title, label).

    Only those rows take part in the join; the rest of the state is not shuffled.
    """
    open_ = (F.col("change") == "new") & keyword_role(F.col("title")).isNull()
    scored = join_unique(undecided(reconciled), labels, ["title"], "left", "job_id")
    scored = scored.withColumn("role_type", F.coalesce("label", "role_type"))
    return reconciled.where(~open_).unionByName(scored.select(*reconciled.columns))


def next_state(reconciled: DataFrame) -> DataFrame:
    return reconciled.select(*STATE_COLS)


def new_jobs(reconciled: DataFrame) -> DataFrame:
    """Ids seen for the first time, with the values of their first row."""
    names = reconciled.schema["first"].dataType.names
    first = [F.col(f"first.{c}").alias(c) for c in names if c not in ("seq", "source")]
    return reconciled.where(F.col("change") == "new").select(
        F.col("first.seq").alias("seq"),
        "job_id",
        *first,
        "role_type",
        "source",
        "first_seen",
        *FLAGS,
    )


def described(postings: DataFrame) -> DataFrame:
    """(seq, description) of the postings that have one."""
    return postings.where(F.col("description") != "").select("seq", "description")


def with_descriptions(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Jobs with the description of their first row ('' if none), found by ``seq``.

    The inner join comes first: it lets Spark broadcast or filter by the jobs, a
    small part of the batch, where a left join would shuffle every description.
    """
    wanted = described(postings).join(jobs.select("seq"), "seq")
    return jobs.join(wanted, "seq", "left").na.fill("", ["description"])


def change_counts(reconciled: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """One row: new, updated and removed. A repeat of a new id counts as updated.

    Where ``reconciled`` has changed rows only, ``batch`` has all rows that were reconciled: each
    of them is an update, but the first of each new id.
    """
    is_new = F.col("change") == "new"
    if batch is not None:
        rows = reconciled.agg(F.count_if(is_new).alias("new_jobs"), F.count_if(F.col("change") == "removed").alias("removed"))
        one = batch.agg(F.count(F.lit(1)).alias("_rows"))
        both = rows.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one")
        return both.select("new_jobs", (F.col("_rows") - F.col("new_jobs")).alias("updated"), "removed")
    repeats = F.when(is_new, F.col("n") - 1).when(F.col("change") == "updated", F.col("n"))
    return reconciled.agg(
        F.count_if(is_new).alias("new_jobs"),
        F.coalesce(F.sum(repeats), F.lit(0)).alias("updated"),
        F.count_if(F.col("change") == "removed").alias("removed"),
    )


def merge_flags(state: DataFrame, flagged: DataFrame) -> DataFrame:
    """Write flags back by id; rows without new flags keep the old ones."""
    new = flagged.select("job_id", *[F.col(c).alias(f"_{c}") for c in FLAGS])
    merged = state.join(new, "job_id", "left")
    return merged.withColumns(
        {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in FLAGS}
    ).select(*state.columns)


def flagged_state(reconciled: DataFrame, flagged: DataFrame) -> DataFrame:
    """Next state with the run's flags. Only new rows can have any, so only they are
    joined; the rest of the state is not shuffled."""
    is_new = F.col("change") == "new"
    new = merge_flags(next_state(reconciled.where(is_new)), flagged)
    return next_state(reconciled.where(~is_new)).unionByName(new)
