"""Stored tables: where they go, and when they are removed."""

import os
from types import SimpleNamespace

import pytest

from tapeloom import session as S


def test_a_shared_folder_is_demanded_on_a_cluster():
    nothing = SimpleNamespace(get=lambda key, default: default, set=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            S.shared_folder(SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master=master)))
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(S.shared_folder(SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master=master))))


def test_scope_removes_its_tables(spark):
    before = S.materialise(spark.range(3), "outside")
    with S.stored_tables(spark):
        inside = S.materialise(spark.range(5), "inside")
        folder = inside.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        with S.stored_tables(spark):
            S.materialise(inside, "deeper")
        assert inside.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder) and before.count() == 3
