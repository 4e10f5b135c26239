"""Key sets: content against plain sets, rewrites, and equality."""

from __future__ import annotations

import datetime

import pytest

from quietframe import BinningSpec, KeySet
from quietframe.keys import Detect, KeySetPlan, Product, Tuples


def content(k):
    return sorted(tuple(r) for r in k.dataframe().collect())


def test_algebra(spark):
    a, b = KeySet.from_dict({"x": [1, 2, 2], "y": ["a", "b"]}), KeySet.from_dict({"z": [7]})
    assert content(a * b) == [(x, y, 7) for x in (1, 2) for y in ("a", "b")]
    assert a.size() == 4 and (a * b).columns() == ["x", "y", "z"]
    assert content(a - KeySet.from_dict({"x": [1]})) == [(2, "a"), (2, "b")]
    assert content(a.join(KeySet.from_tuples([(1, 5), (3, 6)], ["x", "w"]))) == [(1, "a", 5), (1, "b", 5)]
    assert content(a["x"].union(KeySet.from_dict({"x": [2, 3]}))) == [(1,), (2,), (3,)]
    assert content((a * b)[["z", "x"]]) == [(7, 1), (7, 2)]
    assert content(a.filter("x > 1")) == [(2, "a"), (2, "b")]
    df = KeySet.from_dataframe(spark.createDataFrame([(1, None), (1, None), (None, "q")], "x int, y string"))
    assert df.size() == 2 and content(df.filter("x is null")) == [(None, "q")]
    nulls = KeySet.from_tuples([(None,), (1,)], ["x"])
    assert nulls.join(KeySet.from_tuples([(None,), (2,)], ["x"])).size() == 1
    assert (nulls - KeySet.from_tuples([(None,), (2,)], ["x"])).size() == 1


def test_total_aggregation_and_empty(spark):
    one = KeySet.from_dict({})
    assert one.columns() == [] and one.size() == 1
    assert (one * KeySet.from_dict({"x": [1]})).size() == 1
    none = KeySet.from_dataframe(spark.createDataFrame([], "x int"))
    assert none.size() == 0
    assert (none * KeySet.from_dict({"y": [1, 2]}))["y"].size() == 0  # the empty factor stays


def test_rewrites():
    big = KeySet.from_dict({c: list(range(64)) for c in "abcde"})
    assert big.size() == 64**5
    assert isinstance(big["a"]._node, Tuples) and big["a"].size() == 64
    small = KeySet.from_dict({"a": [1], "b": [2], "c": [3]})
    assert isinstance(small._node, Tuples)
    k = KeySet.from_dict({c: [0, 1, 2] for c in "abcdefghijklmnopqrst"})
    assert k.size() == 3**20 and isinstance(k._node, Product)
    factors, minus = (KeySet.from_dict({"a": [1, 2], "b": [1, 2]}) - KeySet.from_tuples([(1, 1)], ["a", "b"]))._decompose()
    assert len(minus) == 1 and len(factors) == 1
    assert len(KeySet.from_dict({"a": [1, 2], "b": [1, 2]})._decompose(["a"])[0]) == 2


def test_equality(spark):
    a = KeySet.from_dict({"x": [1, 2], "y": ["a"]})
    assert a == KeySet.from_dict({"y": ["a"], "x": [2, 1]})
    assert a == KeySet.from_dataframe(spark.createDataFrame([("a", 2), ("a", 1)], "y string, x long"))
    assert a != KeySet.from_dict({"x": [1, 3], "y": ["a"]})


def test_errors(spark):
    a = KeySet.from_dict({"x": [1]})
    for f in (
        lambda: a * a, lambda: a.join(KeySet.from_dict({"y": [1]})), lambda: a.union(KeySet.from_dict({"y": [1]})), lambda: a["y"], lambda: a[[]], lambda: KeySet.from_tuples([], ["x"]), lambda: KeySet.from_dict({"x": [1, "a"]}),
        lambda: KeySet.from_dict({"x": [1.5]}), lambda: a.join(KeySet.from_dict({"x": ["a"]})), lambda: a - KeySet.from_dict({"y": [1]}), lambda: KeySet.from_dataframe(spark.createDataFrame([], "x double")),
    ):
        with pytest.raises(ValueError):
            f()


def test_plans():
    a = KeySet.from_dict({"x": [1, 2]})
    plan = a * KeySet._detect({"y": a.schema()["x"]})
    assert isinstance(plan, KeySetPlan) and plan.detected() == ["y"]
    with pytest.raises(ValueError):
        plan.dataframe()
    with pytest.raises(ValueError):
        KeySet.from_dict({"y": [1]}) - KeySet(Detect({"y": a.schema()["x"]}))
    assert content(plan.resolved(KeySet.from_dict({"y": [9]}))) == [(1, 9), (2, 9)]
    assert content(plan["x"]) == [(1,), (2,)]


def test_bin_names():
    assert BinningSpec([0, 5, 10]).bins() == ["[0, 5]", "(5, 10]"]
    assert BinningSpec([0, 5, 10], right=False).bins() == ["[0, 5)", "[5, 10]"]
    assert BinningSpec([0.0, 0.123, 0.1234]).bins()[0] == "[0.0000, 0.1230]"
    assert BinningSpec([0, 1, 2], ["a", "a"], nan_bin="n").bins(True) == ["a", "n", None]
    assert BinningSpec([datetime.date(2020, 1, 1), datetime.date(2021, 1, 1)]).bins() == ["[2020-01-01, 2021-01-01]"]
    for bad in ([1], [1, 1], [2, 1], [1, "a"], [0.0, float("nan")]):
        with pytest.raises(ValueError):
            BinningSpec(bad)
