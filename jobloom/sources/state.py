"""Job state on shared storage: one full snapshot per run.

Parquet has no MERGE, so a run writes a new ``run_id=N`` folder and never touches
one being read. A snapshot counts only once its row in ``commits`` is there, so
a run that died half-way is simply written again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.reconcile import upgrade_state
from jobloom.schemas import JOB_STATE
from jobloom.session import remove


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def last_run(self) -> int | None:
        """Highest committed run id: one number."""
        try:
            runs = self.spark.read.schema("run_id BIGINT").parquet(f"{self.root}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise  # damaged commits are not the same as none
            return None
        return runs.agg(F.max("run_id")).first()[0]

    def committed(self, run_id: int) -> bool:
        runs = self.spark.read.schema("run_id BIGINT").parquet(f"{self.root}/commits")
        return not runs.where(F.col("run_id") == run_id).isEmpty()

    def read(self, run_id: int | None = None) -> DataFrame:
        """Snapshot of a run, the last one by default; empty before the first."""
        run_id = self.last_run() if run_id is None else run_id
        if run_id is None:
            return self.spark.createDataFrame([], JOB_STATE)
        return upgrade_state(self.spark.read.parquet(f"{self.root}/state/run_id={run_id}"))

    def write(self, state: DataFrame, run_id: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.root}/state/run_id={run_id}")

    def prune(self, keep: int) -> None:
        """Delete all but the last ``keep`` committed snapshots; their commits stay."""
        runs = self.spark.read.schema("run_id BIGINT").parquet(f"{self.root}/commits").distinct()
        old = [r.run_id for r in runs.orderBy(F.desc("run_id")).collect()][max(1, keep):]
        remove(self.spark, *[f"{self.root}/state/run_id={i}" for i in old])

    def commit(self, run_id: int) -> None:
        done = self.spark.range(run_id, run_id + 1, 1, 1).withColumnRenamed("id", "run_id")
        done.write.mode("append").parquet(f"{self.root}/commits")
