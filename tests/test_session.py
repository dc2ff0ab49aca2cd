import pytest

from chatlake import session as SN


class FakeContext:
    def __init__(self, master, folder):
        self.master, self.folder, self.applicationId = master, folder, "app-1"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, setting=None, master="local[2]", folder=None):
        self.sparkContext, self.conf = FakeContext(master, folder), self
        self.setting = setting

    def get(self, key, default=None):
        return self.setting if key == "spark.checkpoint.dir" and self.setting else default


def test_the_cluster_names_the_folder():
    assert SN.scratch_root(FakeSession("hdfs://shared/check/", "yarn")) == "hdfs://shared/check"
    assert SN.scratch_path(FakeSession("s3://b/c"), "x").startswith("s3://b/c/chatlake/app-1/x-")


def test_only_a_local_session_may_choose_its_own(monkeypatch, tmp_path):
    monkeypatch.setattr(SN.tempfile, "mkdtemp", lambda prefix: str(tmp_path / prefix))
    assert SN.scratch_root(FakeSession()) == str(tmp_path / "chatlake-")
    with pytest.raises(RuntimeError):
        SN.scratch_root(FakeSession(master="spark://host:7077"))


def test_settled_tables_keep_rows_and_types(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS s", "timestamp_micros(id) AS t", "array(id) AS a")
    kept = SN.settle(df, "test")
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
