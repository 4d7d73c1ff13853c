"""Job state as a base and one delta per run, merged on read.

All rows lie in one table per generation, bucketed by ``job_id``: first the base, then what
each run changed. So a reader merges them bucket by bucket without a shuffle, and a run
writes the rows it changed instead of the whole state. After ``compact_after`` deltas the
merged rows become the base of a new generation.

An active row that the last run saw is stored without ``last_seen``: it is the time of the last
run, whichever that is, so that being seen again changes nothing. Rows of an attempt count
only once the attempt's row is in ``manifest``; what a run that died has written is never read.

Beside the state lies an index of the fuzzy keys of active rows: per key the changes of its
number of active rows, by the hash of the key. It is kept with the same attempts, so that no run
computes the keys of rows that it does not change.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.functions.text import fuzzy_key
from jobloom.operators.dedupe import KeyFn
from jobloom.schemas import JOB_STATE, STATE_COLS
from jobloom.session import remove

COMPACT_AFTER = 24
MANIFEST = "run_id BIGINT, run_ts STRING, generation BIGINT, attempt STRING, base BOOLEAN"
ROWS = f"{JOB_STATE}, run_id BIGINT, attempt STRING"
INDEX = "key BINARY, active BIGINT, attempt STRING"


def key_hash(key: Column) -> Column:
    """128 bits that stand for a fuzzy key."""
    return F.unhex(F.md5(key))


def state_keys(company: Column, title: Column, location: Column, status: Column, key_fn: KeyFn) -> Column:
    """Key of an active row, NULL for others and for rows without a key."""
    return F.when(status == "active", key_hash(key_fn(company, title, location)))


@dataclass(frozen=True)
class Version:
    """The committed attempts of the newest generation; at most ``compact_after`` and the base."""

    run_id: int | None
    run_ts: str | None
    generation: int
    attempts: tuple[str, ...]
    base: str | None


class DeltaStore:
    """State of all runs below ``root``; ``buckets`` are the session's shuffle partitions by default."""

    def __init__(
        self, spark: SparkSession, root: str, buckets: int | None = None,
        compact_after: int = COMPACT_AFTER, key_fn: KeyFn = fuzzy_key,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.compact_after, self.key_fn = compact_after, key_fn
        self.known: Version | None = None  # as of the last look at the manifest
        self.layouts: dict[str, int] = {}

    def manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise  # a damaged manifest is not an empty one
            return None

    def version(self) -> Version:
        """The version that counts now. All of one run should be told from the same: see ``pinned``."""
        rows = self.manifest()
        if rows is None:
            self.known = Version(None, None, 0, (), None)
            return self.known
        newest = rows.agg(F.max("generation").alias("generation"))
        found = rows.join(newest, "generation", "left_semi").collect()
        last = max(found, key=lambda r: r.run_id)
        base = next((r.attempt for r in found if r.base), None)
        self.known = Version(last.run_id, last.run_ts, last.generation, tuple(sorted({r.attempt for r in found})), base)
        return self.known

    def pinned(self) -> Version:
        """The version at the last look, which ``read``, ``last_run`` and a commit take."""
        return self.known or self.version()

    def last_run(self) -> int | None:
        return self.version().run_id

    def last_ts(self) -> str | None:
        return self.pinned().run_ts

    def committed(self, run_id: int) -> bool:
        rows = self.manifest()
        return rows is not None and not rows.where(F.col("run_id") == run_id).isEmpty()

    def table(self, kind: str, generation: int) -> DataFrame:
        """The bucketed table of a generation, registered in this session's catalog."""
        path = f"{self.root}/{kind}/generation={generation}"
        name = self.name(kind, path)
        columns, key = (ROWS, "job_id") if kind == "state" else (INDEX, "key")
        if not self.spark.catalog.tableExists(name):
            known = self.layout(path)
            buckets = known if known is not None else self.buckets
            if known is None:
                self.layouts[path] = buckets
                self.spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}-layout")
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    @staticmethod
    def name(kind: str, path: str) -> str:
        return f"jobloom_{kind}_{md5(path.encode()).hexdigest()}"

    def layout(self, path: str) -> int | None:
        """The number of buckets with which a table was made; every session has to use it."""
        if path in self.layouts:
            return self.layouts[path]
        try:
            self.layouts[path] = self.spark.read.schema("buckets INT").parquet(f"{path}-layout").first()[0]
            return self.layouts[path]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def rows(self, version: Version) -> DataFrame:
        """The newest stored row of every id, ``last_seen`` NULL where the last run's time stands for it.

        A bucket is sorted once, for this window and for the merge join with a batch.
        """
        table = self.table("state", version.generation).where(F.col("attempt").isin(*version.attempts))
        if version.attempts != (version.base,):
            place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("run_id")))
            table = table.withColumn("_place", place).where("_place = 1")
        return table.select(*STATE_COLS)

    def read(self) -> DataFrame:
        """The whole state after the last committed run; empty before the first."""
        version = self.version()
        if version.run_id is None:
            return self.spark.createDataFrame([], JOB_STATE)
        return self.rows(version).withColumn("last_seen", F.coalesce("last_seen", F.lit(version.run_ts)))

    def active_keys(self) -> DataFrame:
        """(key) of every fuzzy key that an active row has, from the index alone."""
        version = self.pinned()
        if version.run_id is None:
            return self.spark.createDataFrame([], "key BINARY")
        index = self.table("keys", version.generation).where(F.col("attempt").isin(*version.attempts))
        return index.groupBy("key").agg(F.sum("active").alias("_n")).where("_n > 0").select("key")

    def write(self, changes: DataFrame, run_id: int, run_ts: str) -> str:
        """Append a run's changed rows and their effect on the index; returns the attempt's name.

        ``changes`` has STATE_COLS and ``before``, the old company, title, location and status. It is
        read twice, so it should be stored.
        """
        version, attempt = self.pinned(), uuid.uuid4().hex
        seen = (F.col("status") == "active") & (F.col("last_seen") == run_ts)
        rows = changes.withColumn("last_seen", F.when(~seen, F.col("last_seen")))
        self._append("state", version.generation, rows.withColumns({"run_id": F.lit(run_id).cast("bigint"), "attempt": F.lit(attempt)}))
        before = [F.col(f"before.{c}") for c in ("company", "title", "location", "status")]
        own = [F.col(c) for c in ("company", "title", "location", "status")]
        both = changes.select(F.array(
            F.struct(state_keys(*before, self.key_fn).alias("key"), F.lit(-1).cast("bigint").alias("active")),
            F.struct(state_keys(*own, self.key_fn).alias("key"), F.lit(1).cast("bigint").alias("active"))).alias("_both"))
        each = both.select(F.inline("_both")).where(F.col("key").isNotNull())
        moved = each.groupBy("key").agg(F.sum("active").alias("active")).where(F.col("active") != 0)
        self._append("keys", version.generation, moved.withColumn("attempt", F.lit(attempt)))
        return attempt

    def commit(self, run_id: int, run_ts: str, attempt: str) -> None:
        """From here on the attempt's rows count. Compacts if there are many deltas."""
        self._manifest(run_id, run_ts, self.pinned().generation, attempt, False)
        if len(self.version().attempts) > self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Write the merged rows as the base of a new generation.

        Until its manifest row is there, readers use the old one; a compaction that died
        leaves rows of an attempt that nothing names.
        """
        version, attempt = self.version(), uuid.uuid4().hex
        if version.run_id is None:
            return
        new = version.generation + 1
        merged = self.rows(version)
        rows = merged.withColumns({"run_id": F.lit(version.run_id).cast("bigint"), "attempt": F.lit(attempt)})
        self._append("state", new, rows, dealt=True)
        keys = self.table("keys", version.generation).where(F.col("attempt").isin(*version.attempts))
        keys = keys.groupBy("key").agg(F.sum("active").alias("active")).where(F.col("active") != 0)
        self._append("keys", new, keys.withColumn("attempt", F.lit(attempt)), dealt=True)
        self._manifest(version.run_id, version.run_ts, new, attempt, True)
        self.version()

    def prune(self, keep: int) -> None:
        """Delete all but the last ``keep`` generations."""
        newest = self.version().generation
        for old in range(newest - max(1, keep), -1, -1):
            for kind in ("state", "keys"):
                path = f"{self.root}/{kind}/generation={old}"
                if self.layout(path) is None:
                    return  # gone before, and so are those before it
                remove(self.spark, path, f"{path}-layout")
                self.layouts.pop(path, None)

    def _append(self, kind: str, generation: int, rows: DataFrame, dealt: bool = False) -> None:
        """Insert rows, ``dealt`` if they come bucket by bucket; else they are, so that a task writes one file."""
        path = f"{self.root}/{kind}/generation={generation}"
        rows = rows.select(*self.table(kind, generation).columns)
        if not dealt:
            rows = rows.repartition(self.layout(path), "job_id" if kind == "state" else "key")
        rows.write.insertInto(self.name(kind, path))

    def _manifest(self, run_id: int, run_ts: str, generation: int, attempt: str, base: bool) -> None:
        row = self.spark.createDataFrame([(run_id, run_ts, generation, attempt, base)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
