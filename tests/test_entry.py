"""The driver's contract, with and without the training-data pipeline."""

from __future__ import annotations

import ast
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quietframe import queries as own

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(own.QUERIES) <= set(__spark_entry__.queries())


def test_without_the_pipeline():
    """As if the pipeline's folders were gone."""
    code = "import sys\nsys.modules['quietframe.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert set(e.queries()) == set(e.own.QUERIES)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def imported(path: str) -> set[str]:
    """Modules that a file imports, with a dot before relative ones, and the names from them."""
    out = set()
    for node in ast.walk(ast.parse(open(path).read())):
        if isinstance(node, ast.Import):
            out |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            out |= {"." * node.level + (node.module or "")} | {f"{'.' * node.level}{node.module or ''}.{a.name}" for a in node.names}
    return out


def test_nothing_else_imports_the_pipeline():
    for d, _, names in os.walk(os.path.join(ROOT, "quietframe")):
        if "llm" not in os.path.relpath(d, ROOT).split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    found = imported(os.path.join(d, n))
                    assert not any("llm" in m.split(".") or "corpus_pipeline" in m for m in found), n


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    r = c.execute(own.ORACLE[name])
    cols = [d[0] for d in r.description]
    want = r.fetchall()
    got = own.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(x[k] for k in cols) for x in got.collect()))) == sorted(map(repr, want))


def made_rows(plan) -> list[int]:
    """Rows that each operator of a plan that ran has made, below its stages too."""
    name = plan.nodeName()
    inner = "plan" if name.endswith("QueryStage") else {"AdaptiveSparkPlan": "executedPlan", "ReusedExchange": "child"}.get(name)
    out = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else []
    children = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    return out + [n for c in children for n in made_rows(c)]


def test_no_join_grows_with_the_square(spark, tmp_path):
    """join_private_drop_excess over nations of 2,000 customers and 2,000 suppliers: no operator makes more rows than the tables have."""
    n, c = 2000, duckdb.connect()
    few = "UNION ALL SELECT 2, 'x' UNION ALL SELECT 3, 'x' UNION ALL SELECT NULL, 'x'"  # nation 2: one of each; 3 and 4: no partner; no nation
    parts = {
        "nation": "SELECT i::INT AS n_nationkey, 'n' || i AS n_name FROM range(6) t(i)",
        "customer": f"SELECT k::INT AS c_nationkey, b::DOUBLE AS c_acctbal FROM (SELECT i % 2 AS k, i AS b FROM range({2 * n}) t(i) {few.replace("'x'", '1')})",
        "supplier": f"SELECT k::INT AS s_nationkey, b AS s_name FROM (SELECT i % 2 AS k, 's' || i AS b FROM range({2 * n}) t(i) {few.replace('SELECT 3', 'SELECT 4')})",
    }
    for t, sql in parts.items():
        c.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = own.QUERIES["join_private_drop_excess"](spark, str(tmp_path)).select("n_name", "count")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(c.execute(f"SELECT n_name, count FROM ({own.ORACLE['join_private_drop_excess']})").fetchall()) == [("n0", 6), ("n1", 6), ("n2", 1)]
    rows = made_rows(df._jdf.queryExecution().executedPlan())
    assert 2 * n <= max(rows) <= 2 * n + 3, rows
