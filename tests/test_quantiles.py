"""Ranks of values by parts, and quantiles of keys of every size by one rule."""

from __future__ import annotations

import math
import random

import pytest

from quietframe import AddOneRow, KeySet, PureDPBudget, QueryBuilder, Session
from quietframe.operators import aggregate


@pytest.mark.parametrize("most", [(1 << 18, 4096), (3, 4), (1, 2)])
def test_ranked(spark, monkeypatch, most):
    """One part, a few and many levels of parts give the same ranks."""
    monkeypatch.setattr(aggregate, "RANKED", most[0])
    monkeypatch.setattr(aggregate, "PARTS", most[1])
    r = random.Random(3)
    rows = [(k, x, r.randint(1, 9)) for k, values in (("a", {r.choice([r.uniform(-5, 5), r.uniform(0, 1e-9), 1e300]) for _ in range(60)}), (None, {float(i) for i in range(30)}), ("one", {7.0})) for x in values]
    want = []
    for k in ("a", None, "one"):
        left, below, total = -10.0, 0, sum(n for key, _, n in rows if key == k)
        for x, n in sorted((x, n) for key, x, n in rows if key == k):
            want.append((k or "", left, x, below, below + n, total))
            left, below = x, below + n
    got = aggregate.ranked(spark.createDataFrame(rows, "k string, __x double, __n long"), ["k"], -10.0).collect()
    assert sorted((row[0] or "", *row[1:]) for row in got) == sorted(want)


def answers(spark, values, low, high, q, eps=math.inf, times=1):
    s = Session.from_dataframe(PureDPBudget(eps * times), "t", spark.createDataFrame([(float(x),) for x in values], "x double"), AddOneRow())
    return [s.evaluate(QueryBuilder("t").quantile("x", q, low, high, "q"), PureDPBudget(eps)).first()[0] for _ in range(times)]


def test_bounds_far_wider_than_the_values(spark):
    values = [*(1 + i % 10 for i in range(499)), 9000]
    for high in (1e4, 1e9):
        assert 5 <= answers(spark, values, 0.0, high, 0.5)[0] <= 6
    assert 0 <= answers(spark, values, 0.0, 1e9, 0.0)[0] <= 1
    assert 9000 <= answers(spark, values, 0.0, 1e9, 1.0)[0] <= 1e9


def test_size_changes_nothing(spark, monkeypatch):
    """Noisy answers can pass the values' own range, however many values there are."""
    for most in (1 << 18, 4):
        monkeypatch.setattr(aggregate, "RANKED", most)
        assert any(x < 40 or x > 60 for x in answers(spark, range(40, 61), 0.0, 1e6, 0.5, 0.01, 6))
    assert all(49 <= x <= 51 for x in answers(spark, range(101), 0.0, 100.0, 0.5, 1e4, 2))


def test_no_values(spark):
    s = Session.from_dataframe(PureDPBudget.inf(), "t", spark.createDataFrame([("a", 5.0), ("a", None), ("a", float("nan"))], "k string, x double"), AddOneRow())
    q = QueryBuilder("t").groupby(KeySet.from_dict({"k": ["a", "b"]})).max("x", 0.0, 9.0, "m")
    got = dict(tuple(r) for r in s.evaluate(q, PureDPBudget.inf()).collect())
    assert 5 <= got["a"] <= 9 and 0 <= got["b"] <= 9
