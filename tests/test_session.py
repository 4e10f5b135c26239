"""Golden answers at an infinite budget, calibration, errors and the ledger."""

from __future__ import annotations

import datetime
import math
import warnings
from fractions import Fraction

import pytest

from quietframe import AddMaxRows, AddMaxRowsInMaxGroups, AddOneRow, AddRowsWithID, ApproxDPBudget, BinningSpec, ColumnDescriptor, ColumnType, Config, KeySet, MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, PureDPBudget, QueryBuilder, RhoZCDPBudget, Session, TruncationStrategy

BUDGETS = [PureDPBudget, RhoZCDPBudget]
ROWS = [("0", 0, 0), ("0", 0, 1), ("0", 1, 2), ("1", 0, 3)]
PEOPLE = [(1, "A", "X", 4), (1, "A", "Y", 5), (1, "A", "X", 6), (2, "A", "Y", 7), (3, "A", "X", 8), (3, "B", "Y", 9)]


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame(ROWS, "A string not null, B int not null, X int not null")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, g string, g2 string, n long")


def answer(s, q, budget):
    return sorted(tuple(r) for r in s.evaluate(q, budget).collect())


Q = QueryBuilder("t")
A2, A3 = KeySet.from_dict({"A": ["0", "1"]}), KeySet.from_dict({"A": ["0", "1", "2"]})
GOLDEN = [
    (Q.count(), [(4,)]),
    (Q.groupby(KeySet.from_dict({"A": ["0", "1"], "B": [0, 1]})).count(), [("0", 0, 2), ("0", 1, 1), ("1", 0, 1), ("1", 1, 0)]),
    (Q.groupby(A3).count(), [("0", 3), ("1", 1), ("2", 0)]),
    (Q.groupby(A2).sum("X", 0, 1), [("0", 2), ("1", 1)]),
    (Q.groupby(A3).sum("X", 2, 3), [("0", 6), ("1", 3), ("2", 0)]),
    (Q.flat_map(lambda r: [{}, {}], {}, augment=True, max_rows=2).sum("X", 0, 3), [(12,)]),
    (Q.flat_map(lambda r: [{}, {}, {}], {}, augment=True, max_rows=2).count(), [(8,)]),
    (Q.histogram("X", BinningSpec([0, 2, 4], ["0,1", "2,3"], right=False)), [("0,1", 2), ("2,3", 2)]),
    (Q.filter("A == '0'").count(), [(3,)]),
    (Q.select("A").count_distinct(), [(2,)]),
    (Q.count_distinct(["A", "B"]), [(3,)]),
    (Q.groupby(KeySet.from_dict({"A": ["0", "1"], "B": [0, 1]})).count().suppress(1), [("0", 0, 2), ("0", 1, 1), ("1", 0, 1)]),
    (Q.groupby(A2).average("X", 0.0, 1.0), [("0", pytest.approx(2 / 3)), ("1", 1.0)]),
    (Q.groupby(KeySet.from_dict({"A": ["2"]})).average("X", 0, 10), [("2", 5.0)]),
    (Q.groupby(KeySet.from_dict({"A": ["0"]})).stdev("X", 0.0, 1.0), [("0", 0.5)]),
    (Q.groupby(KeySet.from_dict({"A": ["0"]})).variance("X", 0.0, 1.0), [("0", 0.25)]),
    (Q.rename({"X": "Y"}).sum("Y", 0, 9), [(6,)]),
    (Q.map(lambda r: {"C": 2 * r["X"]}, {"C": ColumnType.INTEGER}).sum("C", 0, 100), [(12,)]),
    (Q.derive({"C": "2 * X"}, {"C": ColumnType.INTEGER}).sum("C", 0, 100), [(12,)]),
    (Q.get_bounds("X"), [(-4, 4)]),
    (Q.join_public("public").groupby(KeySet.from_dict({"A+B": [0, 1, 2]})).count(), [(0, 3), (1, 4), (2, 1)]),
]


@pytest.mark.parametrize("budget", BUDGETS)
def test_golden(spark, t, budget):
    inf = budget.inf()
    b = Session.Builder().with_privacy_budget(inf).with_private_dataframe("t", t, AddOneRow())
    s = b.with_public_dataframe("public", spark.createDataFrame([("0", 0), ("0", 1), ("1", 1), ("1", 2)], ["A", "A+B"])).build()
    for q, want in GOLDEN:
        assert answer(s, q, inf) == want
    got = dict(answer(s, Q.groupby(A2).stdev("X", 0, 1), inf))
    assert math.isnan(got["1"])
    for q in (Q.groupby(A2).median("X", 0, 3), Q.groupby(A2).min("X", 0, 3), Q.groupby(A2).max("X", 0, 3)):
        assert all(0 <= v <= 3 for _, v in answer(s, q, inf))


def test_types_on_load(spark):
    for bad in ("boolean", "array<int>", "decimal(5,2)", "binary"):
        with pytest.raises(ValueError):
            Session.from_dataframe(PureDPBudget(1), "t", spark.createDataFrame([], f"x {bad}"), AddOneRow())
    s = Session.from_dataframe(PureDPBudget(1), "t", spark.createDataFrame([], "i int, f float, d date, ts timestamp_ntz"), AddOneRow())
    assert s.get_column_types("t") == {"i": ColumnType.INTEGER, "f": ColumnType.DECIMAL, "d": ColumnType.DATE, "ts": ColumnType.TIMESTAMP}


def test_special_values(spark):
    inf = PureDPBudget.inf()
    rows = [(x,) for x in (1.0, 1.0, None, float("nan"), float("inf"), float("-inf"))]
    s = Session.from_dataframe(inf, "t", spark.createDataFrame(rows, "x double"), AddOneRow())
    assert answer(s, Q.sum("x", -100.0, 300.0), inf) == [(202.0,)]
    assert answer(s, Q.count_distinct(["x"]), inf) == [(5,)]
    assert answer(s, Q.replace_null_and_nan().replace_infinity({"x": (5.0, 6.0)}).sum("x", -100.0, 300.0), inf) == [(13.0,)]
    assert answer(s, Q.drop_null_and_nan().count(), inf) == [(4,)]
    assert answer(s, Q.drop_infinity().count(), inf) == [(4,)]
    assert answer(s, Q.get_bounds("x"), inf) == [(-1.0, 1.0)]
    dates = spark.createDataFrame([(datetime.date(2000, 1, 1),), (None,)], "d date")
    s = Session.from_dataframe(inf, "t", dates, AddOneRow())
    keys = KeySet.from_tuples([(datetime.date(2000, 1, 1),), (None,)], ["d"])
    assert dict(tuple(r) for r in s.evaluate(Q.groupby(keys).count(), inf).collect()) == {datetime.date(2000, 1, 1): 1, None: 1}
    assert answer(s, Q.replace_null_and_nan().groupby(KeySet.from_dict({"d": [datetime.date(1970, 1, 1)]})).count(), inf) == [(datetime.date(1970, 1, 1), 1)]


@pytest.mark.parametrize("budget", BUDGETS)
def test_ids(spark, people, budget):
    inf = budget.inf()
    s = Session.from_dataframe(inf, "t", people, AddRowsWithID("id"))
    with pytest.raises(RuntimeError):
        s.evaluate(Q.count(), inf)
    assert answer(s, Q.enforce(MaxRowsPerID(1)).count(), inf) == [(3,)]
    assert answer(s, Q.enforce(MaxRowsPerID(2)).count(), inf) == [(5,)]
    assert answer(s, Q.enforce(MaxRowsPerID(1)).sum("n", 0, 10), inf)[0][0] in {a + 7 + b for a in (4, 5, 6) for b in (8, 9)}
    g = Q.enforce(MaxGroupsPerID("g", 1)).enforce(MaxRowsPerGroupPerID("g", 1))
    assert sum(n for _, n in answer(s, g.groupby(KeySet.from_dict({"g": ["A", "B"]})).count(), inf)) == 3
    assert answer(s, Q.count_distinct(["id"]), inf) == [(3,)]
    f = Q.flat_map_by_id(lambda rows: [{"v": sum(r["n"] for r in rows)}], {"v": ColumnType.INTEGER}).enforce(MaxRowsPerID(1))
    assert answer(s, f.sum("v", 0, 100), inf) == [(39,)]
    with pytest.raises(ValueError):
        s.evaluate(Q.select("n").enforce(MaxRowsPerID(1)).count(), inf)
    left = s.evaluate(Q.enforce(MaxRowsPerID(9)).join_public(spark.createDataFrame([("A", 1)], "g string, z int"), how="left").count(), inf)
    assert left.collect()[0][0] == 6


def test_null_ids_are_one_id(spark):
    inf = PureDPBudget.inf()
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "id long, n long")
    s = Session.from_dataframe(inf, "t", df, AddRowsWithID("id"))
    assert answer(s, Q.enforce(MaxRowsPerID(1)).count(), inf) == [(2,)]
    f = Q.flat_map_by_id(lambda rows: [{"v": len(rows)}], {"v": ColumnType.INTEGER}).enforce(MaxRowsPerID(1))
    assert answer(s, f.sum("v", 0, 100), inf) == [(3,)]


def test_joins(spark, t):
    inf = PureDPBudget.inf()
    b = Session.Builder().with_privacy_budget(inf).with_private_dataframe("t", t, AddOneRow())
    s = b.with_private_dataframe("u", spark.createDataFrame([("0", 5), ("0", 6), ("1", 7), (None, 8)], "A string, X int"), AddOneRow()).build()
    D = TruncationStrategy
    q = Q.join_private("u", D.DropExcess(3), D.DropExcess(3), ["A"])
    assert answer(s, q.count(), inf) == [(7,)]
    assert set(s.evaluate(q.groupby(A2).sum("X_left", 0, 9), inf).columns) == {"A", "X_left_sum"}
    assert answer(s, Q.join_private("u", D.DropNonUnique(), D.DropNonUnique(), ["A"]).count(), inf) == [(1,)]
    with pytest.raises(ValueError):
        s.evaluate(Q.join_private("u").count(), inf)
    info = s._noise_info
    assert info(q.count(), inf)[0]["mechanism"] == "NONE"
    fin = Session.Builder().with_privacy_budget(PureDPBudget(9)).with_private_dataframe("t", t, AddOneRow()).with_private_dataframe("u", t, AddOneRow()).build()
    assert fin._noise_info(Q.join_private("u", D.DropExcess(2), D.DropExcess(3)).count(), PureDPBudget(1))[0]["parameter"] == 2 * 2 + 3 * 2


def parameters(s, q, budget):
    return [x["parameter"] for x in s._noise_info(q, budget)]


def test_calibration(people, t):
    one, rho = PureDPBudget(1), RhoZCDPBudget(1)
    for k in (1, 2, 5):
        q = Q.enforce(MaxRowsPerID(k))
        pure, zcdp = (Session.from_dataframe(b, "t", people, AddRowsWithID("id")) for b in (one, rho))
        assert parameters(pure, q.count(), one) == [k]
        assert parameters(zcdp, q.count(), rho) == [Fraction(k * k, 2)]
        assert parameters(pure, q.average("n", 0, 10), one) == [10 * k, 2 * k]
        assert parameters(zcdp, q.average("n", 0, 10), rho) == [25 * k * k, k * k]
    q = Q.enforce(MaxGroupsPerID("g", 2)).enforce(MaxRowsPerGroupPerID("g", 3))
    assert parameters(pure, q.average("n", 0, 10), one) == [60, 12]
    assert parameters(zcdp, q.average("n", 0, 10), rho) == [900, 36]
    assert parameters(zcdp, q.groupby(KeySet.from_dict({"g": ["A"]})).average("n", 0, 10), rho) == [450, 18]
    assert parameters(pure, q.enforce(MaxRowsPerID(4)).count(), one) == [4]
    seven = Session.from_dataframe(PureDPBudget(7), "t", t, AddOneRow())
    assert parameters(seven, Q.count(), PureDPBudget(7)) == [Fraction(1, 7)]
    assert parameters(seven, Q.average("X", -111, 234), PureDPBudget(2))[0] == 173
    assert seven._noise_info(Q.sum("X", 0.0, 2.0), one)[0]["mechanism"] == "GEOMETRIC"
    with pytest.raises(ValueError):
        seven._noise_info(Q.count(mechanism="gaussian"), one)


def test_groups(spark):
    budget = ApproxDPBudget(1, 1e-5)
    df = spark.range(20001).selectExpr("CASE WHEN id < 20000 THEN id % 2 ELSE 3 END AS b", "0 AS a")
    s = Session.from_dataframe(budget, "t", df, AddOneRow())
    assert answer(s, Q.get_groups(["b"]), budget) == [(0,), (1,)]
    inf = ApproxDPBudget.inf()
    s = Session.from_dataframe(inf, "t", df, AddOneRow())
    assert answer(s, Q.get_groups(["b"]), inf) == [(0,), (1,), (3,)]
    with pytest.raises(ValueError):
        Q.groupby(["b"])
    Config().features.auto_partition_selection.enable()
    try:
        two = ApproxDPBudget(2, 1e-5)
        s = Session.from_dataframe(two, "t", df, AddOneRow())
        got = answer(s, Q.groupby(["b"]).count(), two)
        assert [k for k, _ in got] == [0, 1] and all(abs(n - 10000) < 100 for _, n in got)
        assert answer(Session.from_dataframe(inf, "t", df, AddOneRow()), Q.groupby("b").count_distinct(["a"]), inf) == [(0, 1), (1, 1), (3, 1)]
    finally:
        Config().features.auto_partition_selection.reset()
    with pytest.raises(ValueError):
        Session.from_dataframe(PureDPBudget(1), "t", df, AddOneRow()).evaluate(Q.get_groups(["b"]), PureDPBudget(1))


def test_ledger(t):
    s = Session.from_dataframe(PureDPBudget(1), "t", t, AddOneRow())
    with pytest.raises(ValueError):
        s.evaluate(Q.count(), RhoZCDPBudget(1))
    with pytest.raises(ValueError):
        s.evaluate(Q.count(), PureDPBudget(0))
    with pytest.raises(ValueError):
        s.evaluate(Q.sum("A", 0, 1), PureDPBudget(0.5))
    assert s.remaining_privacy_budget == PureDPBudget(1)
    first = s.evaluate(Q.count(), PureDPBudget(0.25))
    assert first.collect() == first.collect()
    with pytest.raises(RuntimeError):
        s.evaluate(Q.count(), PureDPBudget(0.8))
    assert s.remaining_privacy_budget == PureDPBudget(0.75)
    s._spend_budget_without_executing(PureDPBudget(0.75 * (1 + 1e-12)))
    assert s.remaining_privacy_budget == PureDPBudget(0)
    a = Session.from_dataframe(ApproxDPBudget(1, 0.1), "t", t, AddOneRow())
    a.evaluate(Q.count(), PureDPBudget(0.5))
    assert a.remaining_privacy_budget == ApproxDPBudget(0.5, 0.1)
    assert PureDPBudget(1) + PureDPBudget(2) == PureDPBudget(3) and PureDPBudget(3) / 3 == PureDPBudget(1)
    assert ApproxDPBudget(1, 1).is_infinite and not ApproxDPBudget(1, 0.5).is_infinite


def test_views_and_parts(spark, t, people):
    inf = PureDPBudget.inf()
    s = Session.from_dataframe(PureDPBudget(10), "t", t, AddOneRow())
    s.create_view(Q.filter("X > 0"), "v", cache=True)
    assert s.private_sources == ["t", "v"]
    with pytest.raises(ValueError):
        s.create_view(Q, "v", cache=False)
    s.delete_view("v")
    parts = s.partition_and_create("t", PureDPBudget(4), "A", {"x": "0", "y": "1"})
    assert s.remaining_privacy_budget == PureDPBudget(6)
    assert parts["x"].remaining_privacy_budget == PureDPBudget(4)
    parts["y"].evaluate(QueryBuilder("y").count(), PureDPBudget(1))
    with pytest.raises(RuntimeError):
        parts["x"].evaluate(QueryBuilder("x").count(), PureDPBudget(1))
    s.evaluate(Q.count(), PureDPBudget(1))
    with pytest.raises(RuntimeError):
        parts["y"].evaluate(QueryBuilder("y").count(), PureDPBudget(1))
    i = Session.from_dataframe(inf, "t", people, AddRowsWithID("id"))
    with pytest.raises(ValueError):
        i.partition_and_create("t", inf, "g", {"a": "A"})
    i.create_view(Q.enforce(MaxGroupsPerID("g", 1)), "w", cache=False)
    got = i.partition_and_create("w", inf, "g", {"a": "A", "b": "B"})
    assert sum(answer(p, QueryBuilder(n).enforce(MaxRowsPerID(1)).count(), inf)[0][0] for n, p in got.items()) == 3
    assert "INTEGER" in s.describe("t") and "Remaining budget" in s.describe()


def test_errors(t, people):
    s = Session.from_dataframe(PureDPBudget(1), "t", t, AddOneRow())
    bad = [
        lambda: Q.select("nope").count(), lambda: Q.filter("nope > 1").count(), lambda: Q.filter("rand() > 0.5").count(), lambda: Q.rename({"A": "B"}).count(), lambda: Q.enforce(MaxRowsPerID(1)).count(),
        lambda: Q.groupby(KeySet.from_dict({"Z": [1]})).count(), lambda: Q.groupby(KeySet.from_dict({"B": ["text"]})).count(), lambda: Q.groupby(KeySet.from_dict({"X": [1]})).sum("X", 0, 1), lambda: QueryBuilder("none").count(),
        lambda: Q.flat_map(lambda r: [], {"Z": ColumnType.INTEGER}).count(), lambda: Q.map(lambda r: {}, {"A": ColumnType.INTEGER}, augment=True).count(), lambda: Q.sum("X", 2, 1), lambda: Q.quantile("X", 2, 0, 1), lambda: Q.replace_null_and_nan({"X": "text"}).count(),
    ]
    for f in bad:
        with pytest.raises((ValueError, TypeError)):
            s.evaluate(f(), PureDPBudget(1))
    with pytest.raises(ValueError):
        Session.Builder().with_private_dataframe("t", t, AddOneRow()).build()
    with pytest.raises(ValueError):
        Session.Builder().with_privacy_budget(PureDPBudget(1)).build()
    with pytest.raises(ValueError):
        AddMaxRows(0)
    grouped = Session.from_dataframe(PureDPBudget(1), "t", t, AddMaxRowsInMaxGroups("A", 1, 1))
    with pytest.raises(ValueError):
        grouped.evaluate(Q.count(), PureDPBudget(1))
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        i = Session.from_dataframe(PureDPBudget(1), "t", people, AddRowsWithID("id"))
        i.create_view(Q.flat_map(lambda r: [r], {"z": ColumnDescriptor(ColumnType.INTEGER)}, augment=True, max_rows=3), "v", cache=False)
        assert any("max_rows" in str(x.message) for x in w)


def test_keys_derived_from_the_private_table(spark):
    inf = PureDPBudget.inf()
    df = spark.createDataFrame([("0", 1, 100000), ("1", 0, 20000), ("1", 2, 20000)], "A string, B long, X long")
    s = Session.from_dataframe(inf, "t", df, AddOneRow())
    assert answer(s, Q.groupby(KeySet.from_dataframe(df.select("A", "B"))).sum("X", 0, 10**6), inf) == [("0", 1, 100000), ("1", 0, 20000), ("1", 2, 20000)]


def test_stream(spark, tmp_path):
    from quietframe.streaming import answer_each_batch

    spark.range(10).write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    w = answer_each_batch(stream, Q.count(), "t", AddOneRow(), PureDPBudget.inf(), lambda df, n: got.update({n: df.collect()[0][0]}))
    q = w.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(got.values()) == 10
