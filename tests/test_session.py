"""Where scratch tables go, and that they go away."""

import os

import pytest

from lorekeep import session


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        return self.value or default


class Fake:
    """As much of a session as scratch_dir looks at."""

    def __init__(self, master, folder=None):
        self.conf = Conf(folder)
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})


def test_a_cluster_needs_a_shared_folder():
    assert session.scratch_dir(Fake("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_dir(Fake("spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_dir(Fake("yarn"))
    local = session.scratch_dir(Fake("local[2]"))
    assert local.startswith("file:///") and os.path.isdir(local.removeprefix("file://"))


def test_cut_reads_what_it_wrote(spark):
    rows = session.cut(spark.range(5), "five")
    assert rows.count() == 5 and all(session.own_scratch(spark).removeprefix("file://") in f for f in rows.inputFiles())
