from __future__ import annotations

from types import SimpleNamespace

import pytest

from pulsegrid.functions.scratch import scratch_root
from pulsegrid.settings import session_settings


def test_partitions_follow_the_input():
    small, large = session_settings(10 << 20, 8), session_settings(100 << 40, 8000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(large["spark.sql.shuffle.partitions"]) == (100 << 40) // (128 << 20)


def cluster(setting):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: setting),
        sparkContext=SimpleNamespace(master="yarn", applicationId="app"),
    )


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        scratch_root(cluster(None))
    assert scratch_root(cluster("hdfs:///scratch/")) == "hdfs:///scratch"
