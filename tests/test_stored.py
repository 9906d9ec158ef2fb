"""Where tables that several consumers read are written."""

from types import SimpleNamespace

import pytest

from proofloom.operators.stored import shared_folder


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def clustered(spark, **conf):
    """The session as a cluster's master would have it."""
    told = Conf({"spark.sql.warehouse.dir": "/shared/warehouse", **conf})
    return SimpleNamespace(conf=told, _jvm=spark._jvm, _jsc=spark._jsc,
                           sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: told))


@pytest.mark.parametrize("conf, folder", [
    ({}, "file:/shared/warehouse"), ({"spark.checkpoint.dir": "/shared/kept/"}, "file:/shared/kept"),
    ({"spark.checkpoint.dir": "file:///shared/kept"}, "file:/shared/kept")])
def test_cluster_uses_the_folder_it_states(spark, conf, folder):
    assert shared_folder(clustered(spark, **conf)) == folder
