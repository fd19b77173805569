import glob
import os
import subprocess
import sys
from bisect import bisect_left
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__
from cartulary.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small.dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small.dir)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small.dir).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and [r.value for r in rows] == sorted((r.value for r in rows), reverse=True)


def test_imports_without_a_session_or_the_other_folders(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("cartulary.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(q.startswith("op") or q == "pipeline" for q in e.queries())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["conjunction_filter"](spark, small.dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_custkey" not in plan
    plan = QUERIES["rank_topk"](spark, small.dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "l_shipdate" not in plan and "o_totalprice" not in plan
    orders = plan[plan.index("o_orderdate") :]
    assert "GreaterThanOrEqual(o_orderdate" in orders and "LessThan(o_orderdate" in orders
    plan = QUERIES["flow_pair_total"](spark, small.dir)._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey" not in plan


def test_similar_names_against_the_library(spark, small):
    names = sorted(r.n_name for r in small("nation").collect())
    want = {(a, b): round(SequenceMatcher(None, a, b).ratio(), 6) for a in names for b in names if a < b}
    assert {(r.nation, r.other): r.ratio for r in QUERIES["sequence_similarity"](spark, small.dir).collect()} == want


def test_resolved_name(spark, small):
    assert [(r.value, r.score) for r in QUERIES["resolve_entity"](spark, small.dir).collect()] == [("NATION_0", 1.0)]


def test_approximate_figures_are_near(spark, small):
    r = QUERIES["approximate_summary"](spark, small.dir).first()
    prices = sorted(x.o_totalprice for x in small("orders").collect())
    assert abs(r["keys"] / small("orders").select("o_custkey").distinct().count() - 1) < 0.1
    for k, q in enumerate((r.q1, r.q2, r.q3), 1):
        assert abs(bisect_left(prices, q) / len(prices) - k / 4) < 0.03


@pytest.mark.parametrize(
    ("balances", "first"),
    [((6986.5, -219.5, 1702.5, 0.5, 1.005, 0.285, -0.004, 999.995, 1e12), 0), ((float("nan"), float("inf"), float("-inf"), None), 0), ((12.34, 1234.5), -2)],
    ids=["ties", "not finite", "negative keys"],
)
def test_money_shown_rounds_as_its_sql(spark, tmp_path, balances, first):
    rows = [(198 * k + m, "s", 0, b) for k, b in enumerate(balances, first) for m in range(11)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = dict(con.execute(SQL["money_shown"]).fetchall())
    assert {r.s_suppkey: r.shown for r in QUERIES["money_shown"](spark, str(tmp_path)).collect()} == want
