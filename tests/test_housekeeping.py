"""Folders of settled answers, and public names."""

from __future__ import annotations

import os
import uuid

import pytest

import quietframe
from quietframe import AddOneRow, AnalyticsDefault, ColumnType, GroupbyCountQuery, KeySet, PureDPBudget, QueryBuilder, Session, check_installation, cleanup, remove_all_temp_tables
from quietframe.runtime import checkpoint_folder


def test_names():
    for name in quietframe.__all__:
        assert getattr(quietframe, name) is not None
    for kind in ColumnType:
        assert kind.default == getattr(AnalyticsDefault, kind.value)
    q = QueryBuilder("t").groupby(KeySet.from_dict({"k": [1]})).count()
    assert isinstance(q, GroupbyCountQuery) and isinstance(q.suppress(3), GroupbyCountQuery)
    assert isinstance(QueryBuilder("t").groupby(KeySet.from_dict({"k": [1]})), quietframe.GroupedQueryBuilder)


def test_check_installation(spark):
    check_installation()


def test_cleanup(spark, tmp_path, monkeypatch):
    sc, top = spark.sparkContext, f"file://{tmp_path}"
    had = sc.getCheckpointDir()

    class Conf:
        def get(self, key, default=None):
            return top if key == "spark.checkpoint.dir" else default

    class Spark:
        sparkContext, conf = sc, Conf()

    try:
        sc.setCheckpointDir(top)
        s = Session.from_dataframe(PureDPBudget(1), "t", spark.createDataFrame([(1,)], "x long"), AddOneRow())
        assert s.evaluate(QueryBuilder("t").count(), PureDPBudget(1)).count() == 1
        own, old, other = os.path.basename(sc.getCheckpointDir().rstrip("/")), str(uuid.uuid4()), "tables"
        os.makedirs(tmp_path / old)
        os.makedirs(tmp_path / other)
        remove_all_temp_tables(Spark())
        assert set(os.listdir(tmp_path)) == {own, other}
        cleanup(spark)
        assert own not in os.listdir(tmp_path)
    finally:
        if had:
            sc.setCheckpointDir(had.rstrip("/").rpartition("/")[0])


def test_no_local_folder_on_a_cluster(spark, tmp_path):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return None

    class Cluster:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_folder(Cluster())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        checkpoint_folder(Cluster())
    Context.master = "local[4]"
    assert checkpoint_folder(Cluster()).startswith("file://")


def test_delete_view(spark):
    s = Session.from_dataframe(PureDPBudget.inf(), "t", spark.createDataFrame([(1,), (5,)], "x long"), AddOneRow())
    s.create_view(QueryBuilder("t").filter("x > 2"), "big", cache=True)
    assert s.evaluate(QueryBuilder("big").count(), PureDPBudget.inf()).first()[0] == 1
    s.delete_view("big")
    with pytest.raises(Exception):
        s.evaluate(QueryBuilder("big").count(), PureDPBudget.inf())
    with pytest.raises(KeyError):
        s.delete_view("big")
    s.delete_view("t")
    assert s.private_sources == []
