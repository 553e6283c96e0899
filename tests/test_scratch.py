from types import SimpleNamespace

import pytest

from sceneloom.jobs import scratch


def session(root, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: root), sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_named_folder_is_taken():
    assert scratch.shared_folder(session("hdfs://x/y", "spark://m"), "job").startswith("hdfs://x/y/job-")


def test_only_a_local_session_gets_one_of_its_own():
    first = scratch.shared_folder(session(None, "local[2]"), "job")
    assert first.rsplit("/", 1)[0] == scratch.shared_folder(session(None, "local[2]"), "job").rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session(None, "spark://m"), "job")
