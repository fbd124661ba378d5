"""Where shared files go, and how jobs are sized."""

from types import SimpleNamespace

import pytest

from meterlight.session import new_shared_path, scale_settings, shared_folder


def fake(master, folder=None, context_folder=None):
    context = SimpleNamespace(master=master, folder=context_folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_the_named_folder_is_used():
    session = fake("yarn", "hdfs:///shared/")
    assert shared_folder(session) == "hdfs:///shared/"
    assert new_shared_path(session, "numbered").startswith("hdfs:///shared/numbered-")
    assert new_shared_path(session, "x") != new_shared_path(session, "x")
    assert session.sparkContext.folder is None


def test_the_applications_folder_is_next():
    assert shared_folder(fake("yarn", None, "hdfs:///app")) == "hdfs:///app"


def test_a_cluster_without_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_folder(fake(master))


def test_local_mode_has_one_scratch_folder():
    session = fake("local[4]")
    assert shared_folder(session) == shared_folder(session)


def test_scale_settings():
    small = scale_settings(10, 8)
    assert small["spark.sql.shuffle.partitions"] == "8"
    large = int(scale_settings(100 * 10**12, 4000)["spark.sql.shuffle.partitions"])
    assert large % 4000 == 0
    assert 100 * 10**12 / large <= 128 * 1024 * 1024


def test_a_plain_file_folder_on_a_cluster_is_warned_about():
    with pytest.warns(UserWarning):
        shared_folder(fake("yarn", "file:/mnt/shared"))
