"""Queries of the driver, at an infinite budget, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import AddMaxRows, AddMaxRowsInMaxGroups, AddOneRow, AddRowsWithID, ApproxDPBudget, BinningSpec, ColumnDescriptor, ColumnType, Config, KeySet, MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, PureDPBudget, QueryBuilder, RhoZCDPBudget, Session, TruncationStrategy
from .sources import load

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLE: dict[str, str] = {}
INF = PureDPBudget.inf()


def query(sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


FLAGS, STATUS = ["A", "N", "R", "X"], ["O", "F"]
TYPES = ["click", "view", "purchase", "signup", "error", "none"]
_KEYS2 = "(SELECT * FROM (VALUES ('A'),('N'),('R'),('X')) a(l_returnflag), (VALUES ('O'),('F')) b(l_linestatus)) k"
_ON2 = "k.l_returnflag = t.l_returnflag AND k.l_linestatus = t.l_linestatus"


def keys2() -> KeySet:
    return KeySet.from_dict({"l_returnflag": FLAGS, "l_linestatus": STATUS})


def rows(spark: SparkSession, sf: str, name: str, *columns: str, budget=INF, change=None) -> Session:
    return Session.from_dataframe(budget, name, load(spark, sf, name, *columns), change or AddOneRow())


def ids(spark: SparkSession, sf: str, name: str, id_column: str, *columns: str, budget=INF) -> Session:
    return rows(spark, sf, name, *columns, budget=budget, change=AddRowsWithID(id_column))


def rounded_(df: DataFrame, c: str, n: int = 4) -> DataFrame:
    return df.withColumn(c, F.round(c, n))


LINE = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber")


@query(f"SELECT k.*, count(t.l_returnflag) AS count FROM {_KEYS2} LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity < 24) t ON {_ON2} GROUP BY ALL")
def count_filtered(spark, sf):
    s = rows(spark, sf, "lineitem", "l_quantity", "l_returnflag", "l_linestatus")
    return s.evaluate(QueryBuilder("lineitem").filter("l_quantity < 24").groupby(keys2()).count(), INF)


@query("SELECT count(*) AS n FROM lineitem")
def count_total(spark, sf):
    return rows(spark, sf, "lineitem", "l_returnflag").evaluate(QueryBuilder("lineitem").count("n"), INF)


@query(f"SELECT k.*, round(coalesce(sum(CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, 5), 30) END), 0), 4) AS s FROM {_KEYS2} LEFT JOIN lineitem t ON {_ON2} GROUP BY ALL")
def sum_clamped(spark, sf):
    s = rows(spark, sf, "lineitem", *LINE)
    return rounded_(s.evaluate(QueryBuilder("lineitem").groupby(keys2()).sum("l_quantity", 5.0, 30.0, "s"), INF), "s")


@query("SELECT sum(least(greatest(l_linenumber, 2), 5))::BIGINT AS s FROM lineitem")
def sum_integer(spark, sf):
    return rows(spark, sf, "lineitem", "l_linenumber").evaluate(QueryBuilder("lineitem").sum("l_linenumber", 2, 5, "s"), INF)


@query(f"SELECT k.*, round(coalesce(avg(CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, 5), 30) END), 17.5), 4) AS m FROM {_KEYS2} LEFT JOIN lineitem t ON {_ON2} GROUP BY ALL")
def average_clamped(spark, sf):
    s = rows(spark, sf, "lineitem", *LINE)
    return rounded_(s.evaluate(QueryBuilder("lineitem").groupby(keys2()).average("l_quantity", 5.0, 30.0, "m"), INF), "m")


@query("SELECT l_returnflag, round(least(var_samp(least(greatest(l_quantity, 5), 30)), 156.25), 4) AS v FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL")
def variance_clamped(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_quantity")
    return rounded_(s.evaluate(QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS[:3]})).variance("l_quantity", 5.0, 30.0, "v"), INF), "v")


@query("SELECT l_returnflag, round(sqrt(least(var_samp(least(greatest(l_quantity, 5), 30)), 156.25)), 4) AS v FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL")
def stdev_clamped(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_quantity")
    return rounded_(s.evaluate(QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS[:3]})).stdev("l_quantity", 5.0, 30.0, "v"), INF), "v")


@query(f"SELECT k.*, count(DISTINCT l_shipdate::DATE) AS d FROM {_KEYS2} LEFT JOIN lineitem t ON {_ON2} GROUP BY ALL")
def count_distinct_column(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate")
    return s.evaluate(QueryBuilder("lineitem").groupby(keys2()).count_distinct(["l_shipdate"], "d"), INF)


@query("SELECT count(*) AS d FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def count_distinct_rows(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber")
    return s.evaluate(QueryBuilder("lineitem").count_distinct(name="d"), INF)


@query("SELECT flag AS flag2, count(*) AS count FROM (SELECT l_returnflag AS flag FROM lineitem) GROUP BY ALL")
def rename_select(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_quantity")
    q = QueryBuilder("lineitem").rename({"l_returnflag": "flag2"}).select(["flag2"])
    return s.evaluate(q.groupby(KeySet.from_dict({"flag2": FLAGS[:3]})).count(), INF)


@query("SELECT CASE WHEN c_acctbal <= 0 THEN 'low' WHEN c_acctbal <= 5000 THEN 'mid' ELSE 'high' END AS bin, count(*) AS count FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000 GROUP BY ALL")
def histogram_named(spark, sf):
    s = rows(spark, sf, "customer", "c_acctbal")
    return s.evaluate(QueryBuilder("customer").histogram("c_acctbal", BinningSpec([-1000.0, 0.0, 5000.0, 10000.0], ["low", "mid", "high"]), "bin"), INF)


@query("SELECT bin, count(*) AS count FROM (SELECT CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' WHEN p_size < 30 THEN 'a' ELSE 'c' END AS bin FROM part WHERE p_size BETWEEN 1 AND 50) GROUP BY ALL")
def bin_column_repeated_names(spark, sf):
    spec = BinningSpec([1, 10, 20, 30, 50], ["a", "b", "a", "c"], right=False)
    s = rows(spark, sf, "part", "p_size")
    return s.evaluate(QueryBuilder("part").bin_column("p_size", spec, "bin").groupby(KeySet.from_dict({"bin": spec.bins()})).count(), INF)


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) >= 100")
def suppress_small(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_linestatus")
    return s.evaluate(QueryBuilder("lineitem").groupby(keys2()).count().suppress(100), INF)


@query("SELECT event_type, count(*) AS count FROM (SELECT coalesce(nullif(event_type, 'click'), 'none') AS event_type FROM events) GROUP BY ALL")
def replace_null(spark, sf):
    df = load(spark, sf, "events", "event_type").select(F.expr("nullif(event_type, 'click')").alias("event_type"))
    s = Session.from_dataframe(INF, "events", df, AddOneRow())
    found = Session.from_dataframe(ApproxDPBudget.inf(), "events", df, AddOneRow()).evaluate(QueryBuilder("events").replace_null_and_nan({"event_type": "none"}).get_groups(["event_type"]), ApproxDPBudget.inf())
    return s.evaluate(QueryBuilder("events").replace_null_and_nan({"event_type": "none"}).groupby(KeySet.from_dataframe(found)).count(), INF)


_SPECIAL = "(SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'nan'::DOUBLE WHEN event_id % 7 = 2 THEN 'inf'::DOUBLE WHEN event_id % 7 = 3 THEN '-inf'::DOUBLE ELSE value END AS v FROM events)"


def _special(spark, sf):
    return load(spark, sf, "events", "event_id", "value").select(F.expr("CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN double('NaN') WHEN event_id % 7 = 2 THEN double('Infinity') WHEN event_id % 7 = 3 THEN double('-Infinity') ELSE value END").alias("v"))


@query(f"SELECT round(sum(CASE WHEN v IS NULL OR isnan(v) THEN NULL ELSE least(greatest(v, 1), 50) END), 4) AS s FROM {_SPECIAL}")
def sum_special_values(spark, sf):
    s = Session.from_dataframe(INF, "t", _special(spark, sf), AddOneRow())
    return rounded_(s.evaluate(QueryBuilder("t").sum("v", 1.0, 50.0, "s"), INF), "s")


@query(f"SELECT round(sum(least(greatest(CASE WHEN v IS NULL OR isnan(v) THEN 7 WHEN isinf(v) THEN (CASE WHEN v > 0 THEN 3 ELSE 2 END) ELSE v END, 1), 50)), 4) AS s FROM {_SPECIAL}")
def replace_special_values(spark, sf):
    s = Session.from_dataframe(INF, "t", _special(spark, sf), AddOneRow())
    q = QueryBuilder("t").replace_null_and_nan({"v": 7.0}).replace_infinity({"v": (2.0, 3.0)})
    return rounded_(s.evaluate(q.sum("v", 1.0, 50.0, "s"), INF), "s")


@query(f"SELECT count(*) AS count FROM {_SPECIAL} WHERE v IS NOT NULL AND NOT isnan(v)")
def drop_null_and_nan(spark, sf):
    s = Session.from_dataframe(INF, "t", _special(spark, sf), AddOneRow())
    return s.evaluate(QueryBuilder("t").drop_null_and_nan(["v"]).count(), INF)


@query(f"SELECT count(*) AS count FROM {_SPECIAL} WHERE v IS NULL OR isnan(v) OR NOT isinf(v)")
def drop_infinity(spark, sf):
    s = Session.from_dataframe(INF, "t", _special(spark, sf), AddOneRow())
    return s.evaluate(QueryBuilder("t").drop_infinity().count(), INF)


@query(f"SELECT count(*) AS d FROM (SELECT DISTINCT v FROM {_SPECIAL})")
def count_distinct_special_values(spark, sf):
    s = Session.from_dataframe(INF, "t", _special(spark, sf), AddOneRow())
    return s.evaluate(QueryBuilder("t").count_distinct(["v"], "d"), INF)


@query("SELECT parity, count(*) AS count FROM (SELECT l_linenumber % 2 AS parity FROM lineitem) GROUP BY ALL")
def map_rows(spark, sf):
    s = rows(spark, sf, "lineitem", "l_linenumber")
    q = QueryBuilder("lineitem").map(lambda r: {"parity": r["l_linenumber"] % 2}, {"parity": ColumnType.INTEGER})
    return s.evaluate(q.groupby(KeySet.from_dict({"parity": [0, 1]})).count(), INF)


@query("SELECT year(l_shipdate)::BIGINT AS y, count(*) AS count FROM lineitem WHERE year(l_shipdate) BETWEEN 1992 AND 1998 GROUP BY ALL")
def derive_columns(spark, sf):
    s = rows(spark, sf, "lineitem", "l_shipdate")
    df = s._catalog.private["lineitem"][0]
    years = KeySet.from_dataframe(df.select(F.year("l_shipdate").cast("long").alias("y")).where("y between 1992 and 1998").distinct())
    q = QueryBuilder("lineitem").derive({"y": "year(l_shipdate)"}, {"y": ColumnType.INTEGER})
    return s.evaluate(q.groupby(years).count(), INF)


@query("SELECT sum(least(l_linenumber, 2))::BIGINT AS count FROM lineitem")
def flat_map_rows(spark, sf):
    s = rows(spark, sf, "lineitem", "l_linenumber")
    q = QueryBuilder("lineitem").flat_map(lambda r: [{"i": i} for i in range(r["l_linenumber"])], {"i": ColumnType.INTEGER}, max_rows=2)
    return s.evaluate(q.count(), INF)


@query("SELECT i, count(*) AS count FROM (SELECT unnest(range(least(l_linenumber, 3))) AS i FROM lineitem) GROUP BY ALL")
def flat_map_grouping(spark, sf):
    s = rows(spark, sf, "lineitem", "l_linenumber")
    q = QueryBuilder("lineitem").flat_map(lambda r: [{"i": i} for i in range(r["l_linenumber"])], {"i": ColumnType.INTEGER}, augment=True, grouping=True, max_rows=3)
    return s.evaluate(q.groupby(KeySet.from_dict({"i": [0, 1, 2]})).count(), INF)


@query("SELECT round(sum(least(v, 100)), 2) AS s FROM (SELECT sum(value) AS v FROM events GROUP BY user_id)")
def flat_map_by_id(spark, sf):
    s = ids(spark, sf, "events", "user_id", "user_id", "value")
    q = QueryBuilder("events").flat_map_by_id(lambda rs: [{"v": float(sum(r["value"] for r in rs))}], {"v": ColumnDescriptor(ColumnType.DECIMAL)}).enforce(MaxRowsPerID(1))
    return rounded_(s.evaluate(q.sum("v", 0.0, 100.0, "s"), INF), "s", 2)


@query("SELECT n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_public_inner(spark, sf):
    s = rows(spark, sf, "customer", "c_nationkey", "c_acctbal")
    nation = load(spark, sf, "nation", "n_nationkey", "n_name").withColumnRenamed("n_nationkey", "c_nationkey")
    s.add_public_dataframe("nation", nation)
    return s.evaluate(QueryBuilder("customer").join_public("nation").groupby(KeySet.from_dataframe(nation.select("n_name"))).count(), INF)


@query("SELECT n_name, count(*) AS count FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n ON c_nationkey = n_nationkey GROUP BY ALL")
def join_public_left(spark, sf):
    s = rows(spark, sf, "customer", "c_nationkey")
    nation = load(spark, sf, "nation", "n_nationkey", "n_name").withColumnRenamed("n_nationkey", "c_nationkey").where("c_nationkey < 10")
    keys = KeySet.from_dataframe(nation.select("n_name")).union(KeySet.from_dataframe(spark.createDataFrame([(None,)], "n_name string")))
    return s.evaluate(QueryBuilder("customer").join_public(nation, how="left").groupby(keys).count(), INF)


@query("SELECT o_orderpriority, count(*) AS count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def join_private_rows(spark, sf):
    b = Session.Builder().with_privacy_budget(INF)
    b.with_private_dataframe("orders", load(spark, sf, "orders", "o_orderkey", "o_orderpriority"), AddOneRow())
    b.with_private_dataframe("lineitem", load(spark, sf, "lineitem", "l_orderkey", "l_quantity"), AddOneRow())
    s = b.build()
    right = QueryBuilder("lineitem").rename({"l_orderkey": "o_orderkey"})
    q = QueryBuilder("orders").join_private(right, TruncationStrategy.DropExcess(1), TruncationStrategy.DropExcess(100))
    keys = KeySet.from_dataframe(load(spark, sf, "orders", "o_orderpriority").distinct())
    return s.evaluate(q.groupby(keys).count(), INF)


@query("""WITH c AS (SELECT c_nationkey, least(count(*), 3) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey, least(count(*), 2) AS n FROM supplier GROUP BY 1)
SELECT n_name, sum(c.n * s.n)::BIGINT AS count FROM c JOIN s ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def join_private_drop_excess(spark, sf):
    """Most nations have more than three customers, and more than two suppliers."""
    b = Session.Builder().with_privacy_budget(INF)
    b.with_private_dataframe("customer", load(spark, sf, "customer", "c_nationkey", "c_acctbal").withColumnRenamed("c_nationkey", "n_nationkey"), AddOneRow())
    b.with_private_dataframe("supplier", load(spark, sf, "supplier", "s_nationkey", "s_name").withColumnRenamed("s_nationkey", "n_nationkey"), AddOneRow())
    nation = load(spark, sf, "nation", "n_nationkey", "n_name")
    q = QueryBuilder("customer").join_private("supplier", TruncationStrategy.DropExcess(3), TruncationStrategy.DropExcess(2)).join_public(nation)
    # Distinct before they meet: a nation's customers times its suppliers grow with the square of the tables.
    c, s = load(spark, sf, "customer", "c_nationkey").distinct(), load(spark, sf, "supplier", "s_nationkey").distinct()
    found = KeySet.from_dataframe(nation.join(c, F.expr("n_nationkey = c_nationkey")).join(s, F.expr("n_nationkey = s_nationkey")).select("n_name"))
    return b.build().evaluate(q.groupby(found).count(), INF)


@query("SELECT count(*) AS count FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1) JOIN customer ON o_custkey = c_custkey")
def join_private_unique(spark, sf):
    b = Session.Builder().with_privacy_budget(INF)
    b.with_private_dataframe("orders", load(spark, sf, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey"), AddOneRow())
    b.with_private_dataframe("customer", load(spark, sf, "customer", "c_custkey"), AddOneRow())
    q = QueryBuilder("orders").join_private("customer", TruncationStrategy.DropNonUnique(), TruncationStrategy.DropNonUnique())
    return b.build().evaluate(q.count(), INF)


@query("WITH a AS (SELECT o_custkey, least(count(*), 2) AS n FROM orders GROUP BY 1) SELECT sum(n)::BIGINT AS count FROM a JOIN customer ON c_custkey = o_custkey")
def join_private_ids(spark, sf):
    b = Session.Builder().with_privacy_budget(INF).with_id_space("people")
    b.with_private_dataframe("orders", load(spark, sf, "orders", "o_custkey", "o_totalprice"), AddRowsWithID("o_custkey", "people"))
    b.with_private_dataframe("customer", load(spark, sf, "customer", "c_custkey", "c_acctbal").withColumnRenamed("c_custkey", "o_custkey"), AddRowsWithID("o_custkey", "people"))
    right = QueryBuilder("customer").enforce(MaxRowsPerID(1))
    return b.build().evaluate(QueryBuilder("orders").enforce(MaxRowsPerID(2)).join_private(right).count(), INF)


@query("SELECT sum(least(n, 3))::BIGINT AS count FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def max_rows_per_id(spark, sf):
    s = ids(spark, sf, "events", "user_id", "user_id", "event_type", "value")
    return s.evaluate(QueryBuilder("events").enforce(MaxRowsPerID(3)).count(), INF)


@query("SELECT sum(least(n, 2))::BIGINT AS d FROM (SELECT count(DISTINCT event_type) AS n FROM events GROUP BY user_id)")
def max_groups_per_id(spark, sf):
    s = ids(spark, sf, "events", "user_id", "user_id", "event_type", "value")
    q = QueryBuilder("events").enforce(MaxGroupsPerID("event_type", 2)).enforce(MaxRowsPerGroupPerID("event_type", 1000))
    return s.evaluate(q.select(["user_id", "event_type"]).count_distinct(["user_id", "event_type"], "d"), INF)


@query("SELECT event_type, sum(least(n, 2))::BIGINT AS count FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def max_rows_per_group_per_id(spark, sf):
    s = ids(spark, sf, "events", "user_id", "user_id", "event_type", "value")
    keys = KeySet.from_dataframe(load(spark, sf, "events", "event_type").distinct())
    q = QueryBuilder("events").enforce(MaxGroupsPerID("event_type", 100)).enforce(MaxRowsPerGroupPerID("event_type", 2))
    return s.evaluate(q.groupby(keys).count(), INF)


@query("SELECT count(DISTINCT user_id) AS d FROM events")
def count_distinct_ids(spark, sf):
    s = ids(spark, sf, "events", "user_id", "user_id", "event_type")
    return s.evaluate(QueryBuilder("events").count_distinct(["user_id"], "d"), INF)


@query("SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY ALL")
def max_rows_in_max_groups(spark, sf):
    budget = RhoZCDPBudget.inf()
    s = rows(spark, sf, "lineitem", "l_returnflag", budget=budget, change=AddMaxRowsInMaxGroups("l_returnflag", 2, 3))
    return s.evaluate(QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS[:3]})).count(), budget)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def get_groups(spark, sf):
    budget = ApproxDPBudget.inf()
    return rows(spark, sf, "lineitem", "l_returnflag", "l_linestatus", budget=budget).evaluate(QueryBuilder("lineitem").get_groups(), budget)


@query("SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY ALL")
def detected_keys(spark, sf):
    budget, flag = ApproxDPBudget.inf(), Config().features.auto_partition_selection
    flag.enable()
    try:
        return rows(spark, sf, "lineitem", "l_returnflag", budget=budget).evaluate(QueryBuilder("lineitem").groupby("l_returnflag").count(), budget)
    finally:
        flag.reset()


@query("""WITH b AS (SELECT CASE WHEN abs(c_acctbal) <= 1 THEN 0 ELSE ceil(log2(abs(c_acctbal))) END AS k, count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT k, sum(n) OVER (ORDER BY k) AS run, sum(n) OVER () AS total FROM b)
SELECT -power(2.0, min(k)) AS low, power(2.0, min(k)) AS high FROM r WHERE run >= 0.95 * total""")
def get_bounds(spark, sf):
    return rows(spark, sf, "customer", "c_acctbal").evaluate(QueryBuilder("customer").get_bounds("c_acctbal", "low", "high"), INF)


def _gap_start(share: float) -> str:
    """Where the gap of the rank nearest to share * n starts: a value, or the bound 0."""
    return f"""WITH v AS (SELECT l_returnflag, l_quantity AS x, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL),
r AS (SELECT l_returnflag, x, sum(n) OVER (PARTITION BY l_returnflag ORDER BY x) AS r, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM v),
g AS (SELECT * FROM r UNION ALL SELECT DISTINCT l_returnflag, 0, 0, total FROM r)
SELECT l_returnflag, arg_min(x, abs(r - {share} * total))::BIGINT AS start FROM g GROUP BY ALL"""


def _sampled(kind: str, *args):
    """Quantities are whole, from 1 to 50: the answer's whole part is the start of its gap."""

    def f(spark, sf):
        s = rows(spark, sf, "lineitem", "l_returnflag", "l_quantity")
        g = QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS[:3]}))
        out = s.evaluate(getattr(g, kind)("l_quantity", *args, 0.0, 60.0, name="q"), INF)
        return out.select("l_returnflag", F.floor(F.least("q", F.lit(50.0))).alias("start"))

    f.__name__ = f"{kind}_sampled"
    return f


for _kind, _args, _share in (("quantile", (0.25,), 0.25), ("min", (), 0), ("max", (), 1), ("median", (), 0.5)):
    query(_gap_start(_share))(_sampled(_kind, *_args))


def _outlier(spark: SparkSession, sf: str) -> DataFrame:
    """About 500 values from 1 to 10, and 9,000."""
    return load(spark, sf, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber = 1 AND l_orderkey <= 500").select(F.expr("CASE WHEN l_orderkey = 500 THEN 9000D ELSE 1D + l_orderkey % 10 END").alias("v"))


@query("""WITH t AS (SELECT CASE WHEN l_orderkey = 500 THEN 9000 ELSE 1 + l_orderkey % 10 END AS v FROM lineitem WHERE l_linenumber = 1 AND l_orderkey <= 500),
r AS (SELECT v, sum(count(*)) OVER (ORDER BY v) AS r, sum(count(*)) OVER () AS total FROM t GROUP BY v)
SELECT arg_min(v, abs(r - 0.5 * total))::BIGINT AS start FROM r""")
def median_wide_bounds(spark, sf):
    """The declared range is far wider than the values."""
    s = Session.from_dataframe(INF, "t", _outlier(spark, sf), AddOneRow())
    return s.evaluate(QueryBuilder("t").median("v", 0.0, 1e9, "q"), INF).select(F.floor("q").alias("start"))


@query("""WITH t(f, x) AS (VALUES ('a', 0.0::DOUBLE), ('a', 10.0), ('b', 10.0), ('b', 0.25), ('b', 10.0), ('c', 4.0), ('c', 6.0))
SELECT f, least(var_samp(x), power((10 - 0) / 2, 2)) AS v FROM t GROUP BY f""")
def variance_at_the_bounds(spark, sf):
    """Samples whose variance passes the square of half the range, which it is kept to."""
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", float("inf")), ("b", 0.25), ("b", 1e308), ("c", 4.0), ("c", 6.0)], "f string, x double")
    s = Session.from_dataframe(INF, "t", df, AddOneRow())
    return s.evaluate(QueryBuilder("t").groupby(KeySet.from_dict({"f": ["a", "b", "c"]})).variance("x", 0.0, 10.0, "v"), INF)


@query("SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_quantity < 24 AND l_returnflag IN ('A', 'N', 'R') GROUP BY ALL")
def view_of_filter(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_quantity")
    s.create_view(QueryBuilder("lineitem").filter("l_quantity < 24"), "small", cache=False)
    return s.evaluate(QueryBuilder("small").groupby(KeySet.from_dict({"l_returnflag": FLAGS[:3]})).count(), INF)


@query("SELECT 'a' AS part, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'r', count(*) FROM lineitem WHERE l_returnflag = 'R'")
def partition_and_create(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_quantity")
    parts = s.partition_and_create("lineitem", INF, "l_returnflag", {"a": "A", "r": "R"})
    out = [p.evaluate(QueryBuilder(n).count("n"), INF).select(F.lit(n).alias("part"), "n") for n, p in parts.items()]
    return out[0].union(out[1])


@query("SELECT l_returnflag, count(*) AS count FROM (SELECT * FROM lineitem) WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def max_rows_protected(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", change=AddMaxRows(4))
    return s.evaluate(QueryBuilder("lineitem").groupby(KeySet.from_tuples([("A",), ("R",)], ["l_returnflag"])).count(), INF)


#: A finite budget whose noise is 0 but with probability exp(-10000): its answers are exact
#: although every sampler runs.
PLENTY = 10_000


@query("SELECT k.*, count(t.l_returnflag) AS count FROM " + _KEYS2 + f" LEFT JOIN lineitem t ON {_ON2} GROUP BY ALL")
def count_noisy(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_linestatus", budget=PureDPBudget(PLENTY))
    return s.evaluate(QueryBuilder("lineitem").groupby(keys2()).count(), PureDPBudget(PLENTY))


@query("SELECT l_returnflag, sum(least(l_linenumber, 5))::BIGINT AS s FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def sum_gaussian(spark, sf):
    """The variance of the discrete Gaussian is 25 / (2 rho)."""
    budget = RhoZCDPBudget(PLENTY**2)
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_linenumber", budget=budget)
    return s.evaluate(QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": ["A", "R"]})).sum("l_linenumber", 0, 5, "s"), budget)


@query("SELECT l_returnflag, round(avg(l_linenumber), 3) AS a FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def average_noisy(spark, sf):
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_linenumber", budget=PureDPBudget(PLENTY**2))
    q = QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": ["A", "R"]})).average("l_linenumber", 1, 7, "a")
    return rounded_(s.evaluate(q, PureDPBudget(PLENTY**2)), "a", 3)


@query("SELECT l_returnflag, round(var_samp(l_linenumber), 3) AS v, round(stddev_samp(l_linenumber), 3) AS d FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def variance_noisy(spark, sf):
    budget = PureDPBudget(PLENTY**2)
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_linenumber", budget=2 * budget)
    g = QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": ["A", "R"]}))
    v, d = s.evaluate(g.variance("l_linenumber", 1, 7, "v"), budget), s.evaluate(g.stdev("l_linenumber", 1, 7, "d"), budget)
    return rounded_(rounded_(v.join(d, "l_returnflag"), "v", 3), "d", 3)


@query(_gap_start(0.5))
def median_noisy(spark, sf):
    """Each gap off the median has a score of at least 1 less: a weight of exp(-5000) of it."""
    budget = PureDPBudget(PLENTY)
    s = rows(spark, sf, "lineitem", "l_returnflag", "l_quantity", budget=budget)
    out = s.evaluate(QueryBuilder("lineitem").groupby(KeySet.from_dict({"l_returnflag": FLAGS[:3]})).median("l_quantity", 0.0, 60.0, name="q"), budget)
    return out.select("l_returnflag", F.floor(F.least("q", F.lit(50.0))).alias("start"))


@query("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY ALL HAVING count(*) > 20")
def get_groups_finite(spark, sf):
    """Groups of at most 20 rows stay hidden at this budget, larger ones of these tables don't."""
    budget = ApproxDPBudget(PLENTY, 1e-9)
    return rows(spark, sf, "lineitem", "l_returnflag", "l_linestatus", budget=budget).evaluate(QueryBuilder("lineitem").get_groups(), budget)


@query("""SELECT query, what, mechanism, parameter::DOUBLE AS parameter FROM (VALUES ('id rows 1', 'count', 'GEOMETRIC', 1.0), ('id rows 2', 'count', 'GEOMETRIC', 2.0), ('id rows 5', 'count', 'GEOMETRIC', 5.0),
('rho rows 1', 'count', 'DISCRETE_GAUSSIAN', 0.5), ('rho rows 2', 'count', 'DISCRETE_GAUSSIAN', 2.0), ('rho rows 5', 'count', 'DISCRETE_GAUSSIAN', 12.5),
('average 1', 'sum', 'GEOMETRIC', 10.0), ('average 1', 'count', 'GEOMETRIC', 2.0), ('average 5', 'sum', 'GEOMETRIC', 50.0), ('average 5', 'count', 'GEOMETRIC', 10.0),
('rho average 5', 'sum', 'DISCRETE_GAUSSIAN', 625.0), ('rho average 5', 'count', 'DISCRETE_GAUSSIAN', 25.0)) t(query, what, mechanism, parameter)""")
def mechanism_parameters(spark, sf):
    """Noise of queries with known answers: budget 1, measures in [0, 10]."""
    out = []
    for label, budget in (("", PureDPBudget(1)), ("rho ", RhoZCDPBudget(1))):
        s = ids(spark, sf, "events", "user_id", "user_id", "event_id", budget=budget)
        for k in (1, 2, 5):
            q = QueryBuilder("events").enforce(MaxRowsPerID(k))
            asked = {f"{label or 'id '}rows {k}": q.count(), f"{label}average {k}": q.average("event_id", 0, 10)}
            for name, x in asked.items():
                if not (name.endswith("average 2") or name == "rho average 1"):
                    out += [(name, i["what"], i["mechanism"], float(i["parameter"])) for i in s._noise_info(x, budget)]
    return spark.createDataFrame(out, "query string, what string, mechanism string, parameter double")


# key sets

_NATION = "SELECT n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _nation(spark, sf) -> KeySet:
    return KeySet.from_dataframe(load(spark, sf, "nation", "n_name", "n_regionkey"))


@query("SELECT * FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (1), (2)) b(x)")
def keys_product(spark, sf):
    return (KeySet.from_dataframe(load(spark, sf, "lineitem", "l_returnflag")) * KeySet.from_dict({"x": [1, 2]})).dataframe()


@query("SELECT n_name, n_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def keys_join(spark, sf):
    return _nation(spark, sf).join(KeySet.from_dataframe(load(spark, sf, "region", "r_regionkey", "r_name").withColumnRenamed("r_regionkey", "n_regionkey"))).dataframe()


@query(f"SELECT * FROM ({_NATION}) WHERE n_regionkey NOT IN (1, 2)")
def keys_subtract(spark, sf):
    return (_nation(spark, sf) - KeySet.from_tuples([(1,), (2,)], ["n_regionkey"])).dataframe()


@query(f"SELECT n_regionkey FROM ({_NATION}) UNION SELECT * FROM (VALUES (3), (77))")
def keys_union(spark, sf):
    return _nation(spark, sf)["n_regionkey"].union(KeySet.from_dict({"n_regionkey": [3, 77]})).dataframe()


@query(f"SELECT DISTINCT n_regionkey FROM ({_NATION})")
def keys_project(spark, sf):
    return (_nation(spark, sf) * KeySet.from_dict({"x": list(range(50))}))["n_regionkey"].dataframe()


@query(f"SELECT * FROM ({_NATION}) WHERE n_regionkey > 2 AND length(n_name) > 6")
def keys_filter(spark, sf):
    return _nation(spark, sf).filter("n_regionkey > 2 AND length(n_name) > 6").dataframe()


@query("SELECT count(*) AS n, count(DISTINCT a) AS a FROM (VALUES (0), (1)) x(a), range(2000), range(2000)")
def keys_large_product(spark, sf):
    k = KeySet.from_dict({"a": [0, 1], "b": list(range(2000))}) * KeySet.from_dict({"c": list(range(2000))})
    return k.dataframe().agg(F.count("*").alias("n"), F.countDistinct("a").alias("a"))
