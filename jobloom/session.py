"""Session set-up and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Lists of the paths made inside ``recorded`` and ``temporary``, the outermost first.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())
#: Has Spark drop a job's shuffle files at its end; else they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("jobloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master, as in tests, may go without it; its warehouse then holds the tables.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made.get():
        made.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders on whatever file system they are; missing ones are no error."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Stored bytes of a file or folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of tables that are written below the shared folder inside the block, for ``remove``."""
    made: list[str] = []
    token = _made.set((*_made.get(), made))
    try:
        yield made
    finally:
        _made.reset(token)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Drops all tables that are written below the shared folder inside the block."""
    with recorded() as made:
        try:
            yield
        finally:
            remove(spark, *made)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``written``, for tables as large as the input: compressed by zstd, and the shuffle files that
    they were made from are dropped at once, so that those of two steps never lie side by side."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
