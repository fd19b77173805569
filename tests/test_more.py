import duckdb
import pytest
from pyspark.sql import functions as F

from cartulary.functions import parsing, places
from cartulary.operators import geo
from cartulary.plans import evaluate, gate, route
from cartulary.queries import SPENDING
from cartulary.sources.tables import register


def test_places(spark):
    df = spark.createDataFrame([(" Maryland",), ("wv",), ("DC",), ("nowhere",), (None,)], "s string")
    assert [r[0] for r in df.select(places.postal_code(F.col("s"))).collect()] == ["MD", "WV", "DC", None, None]
    assert places.state_in("top counties in West Virginia?") == "West Virginia" and places.state_in("virginian ham") is None


def test_parsing():
    assert parsing.years_of("2010–2013") == [2010, 2011, 2012, 2013]
    assert parsing.years_of("2009, 2012, 2015-2016") == [2009, 2012, 2015, 2016] and parsing.years_of("none") == []
    assert parsing.fenced_json('```json\n{"a": {"b": 1}}\n``` done') == {"a": {"b": 1}} and parsing.fenced_json("no { json") == {}
    assert parsing.canonical_key({"a": 1, "b": 2}) == parsing.canonical_key({"b": 2, "a": 1})


def test_features_meet_results(spark):
    features = spark.createDataFrame([("MD", 1), ("VA", 2), ("OH", 3)], "key string, shape int")
    rows = geo.latest_by_key(spark.createDataFrame([("MD", 5.0, 1), ("MD", 7.0, 2), (None, 1.0, 3), ("XX", 1.0, 4)], "key string, value double, n int"), "key", "n")
    assert [(r.key, r.value) for r in geo.highlighted(features, rows, "key").collect()] == [("MD", 7.0)]
    assert sorted((r.key, r.matched) for r in geo.backdrop(features, rows, "key").collect()) == [("MD", True), ("OH", False), ("VA", False)]
    assert [r.key for r in geo.within(features, rows, "key").collect()] == ["MD"]


def test_composites(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, 10.0, 4.0)], "Contracts double, Grants double, `Resident Wage` double, `# of household` double, `Income <$50K` double")
    assert df.select(geo.spending_total()).first()[0] == 3.0
    assert geo.with_complement(df, "Income >$50K", "# of household", "Income <$50K").select("`Income >$50K`").first()[0] == 6.0
    assert geo.with_complement(df, "Contracts", "a", "b") is df


def test_batches(spark, small):
    register(spark, small.dir)
    out = gate.batch(spark, {"a": "SELECT n_name FROM mart_nation", "b": "DROP TABLE x"}, 3)
    assert len(out["a"]["rows"]) == 3 and out["a"]["execution_ms"] >= 0 and "error" in out["b"]


def test_cases_against_independent_sql(spark, small):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small.dir}/{t}.parquet')")
    cases = [
        evaluate.Case("top 5 nations by revenue in 1999", "ANALYTICAL", ("spending_nation",), f"WITH {SPENDING} SELECT nation, revenue FROM spending WHERE period = '1999' ORDER BY 2 DESC LIMIT 5", {"row_count": 5, "top_label": True}),
        evaluate.Case("trend of revenue by year", "ANALYTICAL", ("spending_nation",), f"WITH {SPENDING} SELECT period, AVG(revenue) FROM spending WHERE length(period) = 4 GROUP BY 1 ORDER BY 1", {"min_rows": 7, "top_label": True}),
        evaluate.Case("bottom 3 nations by quantity", "ANALYTICAL", ("spending_nation",), f"WITH {SPENDING} SELECT nation, quantity FROM spending WHERE period = '2000' ORDER BY 2, 1 LIMIT 3", {"row_count": 3, "top_label": True}),
        evaluate.Case("what data is there", "META"),
        evaluate.Case("show me that", "CLARIFY"),
        evaluate.Case("write a poem", "OUT_OF_SCOPE"),
        evaluate.Case("top 10 rivers", "UNANSWERABLE"),
    ]
    shares = evaluate.evaluated(cases, lambda q: route.ask(spark, small.dir, q), lambda s: con.execute(s).fetchall())
    assert evaluate.passed(shares), shares


def test_cases_come_from_a_file(tmp_path):
    (tmp_path / "cases").write_text('{"question": "q", "intent": "META", "tables": ["a"], "expect": {"min_rows": 1}}\n\n')
    assert evaluate.load_cases(str(tmp_path / "cases")) == [evaluate.Case("q", "META", ("a",), None, {"min_rows": 1})]
    (tmp_path / "cases").write_text('{"question": "q", "intent": "META", "expect": {"rows": 1}}')
    with pytest.raises(ValueError, match="rows"):
        evaluate.load_cases(str(tmp_path / "cases"))


def test_what_a_case_expects():
    a = route.Answer("answered", "revenue: x 5", [{"label": "x", "value": 5.0}])
    case = lambda **e: evaluate.Case("q", "ANALYTICAL", expect=e)
    assert evaluate.holds(case(scalar=True, top_label=True, row_count=1, contains=["X", "5"]), a, [("x", 5.01)])
    assert not evaluate.holds(case(scalar=True), a, [("x", 6)]) and not evaluate.holds(case(top_label=True), a, [("y", 5)])
    assert not evaluate.holds(case(), a, [("x", 5)]) and not evaluate.holds(case(contains=["z"]), a, [])
