import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    return local_session("4", shuffle_partitions=4, checkpoint_dir=folder)


@pytest.fixture(scope="session")
def apply(spark):
    """Values of a column expression over a list of inputs."""
    from pyspark.sql import functions as F

    def run(fn, values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i INT, x {kind}")
        out = df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in out]

    return run
