"""The shared folder for written tables."""

import pytest

from jobloom import session


class FakeContext:
    master = "yarn"

    def getCheckpointDir(self):
        return None


class FakeSession:
    sparkContext = FakeContext()

    class conf:
        folder = None

        @classmethod
        def get(cls, name, default):
            assert name == "spark.checkpoint.dir"
            return cls.folder or default


def test_cluster_names_the_folder(monkeypatch):
    monkeypatch.setattr(FakeSession.conf, "folder", "hdfs:///shared/")
    assert session.shared_dir(FakeSession()) == "hdfs:///shared"


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession())


def test_written(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    back = session.written(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 10
    assert session.scratch(spark, "t") != session.scratch(spark, "t")
