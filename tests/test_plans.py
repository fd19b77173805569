import pytest

from cartulary.plans import catalog, gate, resolve, route, visuals
from cartulary.plans.contract import Contract, compiled, composite
from cartulary.sources.tables import list_views, register


@pytest.fixture(scope="module")
def views(spark, small):
    return set(register(spark, small.dir))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT n_name FROM mart_nation",
        "select count(*) from mart_nation where n_name = 'DROP; -- it'",
        "WITH a AS (SELECT * FROM mart_nation) SELECT * FROM a JOIN mart_region r ON r.r_regionkey = a.n_regionkey;",
        "SELECT * FROM (SELECT n_nationkey FROM mart_nation UNION SELECT r_regionkey FROM mart_region)",
        "SELECT (SELECT MAX(r_name) FROM mart_region) FROM mart_nation",
        "SELECT n_name AS `created` FROM mart_nation /* no insert here */",
    ],
)
def test_gate_lets_queries_through(spark, views, sql):
    assert spark.sql(gate.checked(spark, sql)).count() > 0


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE mart_nation",
        "SELECT 1; SELECT 2",
        "SELECT 1",
        "SELECT * FROM nation",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM mart_nation UNION SELECT * FROM mart_nation",
        "SELECT * FROM mart_nation WHERE n_nationkey IN (SELECT x FROM secret)",
        "SELECT (SELECT MAX(x) FROM secret) FROM mart_nation",
        "SELECT * FROM mart_nation WHERE EXISTS (SELECT 1 FROM secret)",
        "WITH a AS (SELECT * FROM secret) SELECT * FROM a",
        "INSERT INTO mart_nation SELECT * FROM mart_nation",
        "SELECT * FROM range(10)",
        "SELECT reflect('java.lang.System', 'exit', 0) FROM mart_nation",
        "SELECT n_name FROM mart_nation " + " " * 10 + "-- " + "x" * 12_000,
        "SELEC n FROM mart_nation",
        "CREATE VIEW x AS SELECT * FROM mart_nation",
        "SELECT * FROM other.mart_nation",
    ],
)
def test_gate_refuses(spark, views, sql):
    with pytest.raises(gate.Refused):
        gate.checked(spark, sql)


def test_answers_are_bounded(spark, views):
    assert len(gate.answer(spark, "SELECT * FROM mart_customer", 7)) == 7
    assert list_views(spark) == sorted(views)


def test_contract_takes_open_slots_from_before():
    before = Contract("ranking", "spending_nation", "revenue", period="1999", limit=5)
    after = Contract(period="2000").merge(before)
    assert (after.operation, after.table, after.period, after.limit) == ("ranking", "spending_nation", "2000", 5)


def test_contract_refuses(spark, small):
    for c in (Contract("guess", "spending_nation"), Contract("compare", "spending_nation", names=("a",)), Contract("trend", "accounts_nation")):
        with pytest.raises(ValueError):
            compiled(spark, small.dir, c)
    for c in (Contract("lookup", "nothing"), Contract("lookup", "spending_nation", "debits"), Contract("lookup", "spending_nation", where=(("brand", "x"),))):
        with pytest.raises(KeyError):
            compiled(spark, small.dir, c)
    with pytest.raises(ValueError):
        catalog.join_key("flow_nation", "spending_nation")
    with pytest.raises(ValueError):
        composite(catalog.load(spark, small.dir, "accounts_nation"), "accounts_nation", ["credits", "customers"], "x")


def test_names_are_text_not_sql(spark, small):
    assert compiled(spark, small.dir, Contract("lookup", "spending_nation", names=("x' OR '1'='1",))).count() == 0


def test_a_period_is_never_counted_twice(spark, small):
    name = small("nation").first().n_name
    one = compiled(spark, small.dir, Contract("lookup", "spending_nation", names=(name.upper(), f" {name.lower()}")))
    assert one.count() == 1


def test_audit(spark, small):
    frames = {n: catalog.load(spark, small.dir, n) for n in catalog.TABLES}
    found = catalog.audit(frames)
    assert not found.missing and not found.unstated and found.coverage == 1.0
    found = catalog.audit({"accounts_nation": frames["accounts_nation"].drop("debits").withColumnRenamed("credits", "more")})
    assert found.missing == {"accounts_nation": ["credits", "debits"]} and found.unstated == {"accounts_nation": ["more"]}
    assert frames["accounts_nation"].schema["debits"].metadata["unit"] == "dollars"


def test_resolver_takes_the_longest_whole_name(spark):
    values = spark.createDataFrame([("virginia",), ("west virginia",), ("Department of Defense",), ("maryland",)], "value string")
    best = lambda q: [r.value for r in resolve.resolved(values, q).collect()]
    assert best("grants in West Virginia") == ["west virginia"]
    assert best("grants in virginia") == ["virginia"]
    assert best("what does the DoD spend") == ["Department of Defense"]
    assert best("grants in Marylnd") == ["maryland"]
    assert best("nothing here") == []


def test_the_resolver_ranks_mentions_aliases_words_and_likeness(spark):
    values = spark.createDataFrame([("Department of Veterans Affairs",), ("Veterans Affairs Hospital",), ("maryland",)], "value string")
    score = lambda q: {r.value: r.score for r in resolve.scored(values, q).collect()}
    assert score("maryland")["maryland"] == 1.0
    assert score("grants of the VA")["Department of Veterans Affairs"] == resolve.ALIAS_SCORE
    assert score("affairs of veterans")["Department of Veterans Affairs"] == resolve.WORDS_SCORE
    assert resolve.THRESHOLD < score("marylnd")["maryland"] < resolve.WORDS_SCORE


def test_all_values_can_be_resolved(spark):
    values = resolve.values_of(spark.range(3000).selectExpr("concat('value ', lpad(id, 5, '0')) as v"), "v")
    assert [r.value for r in resolve.resolved(values, "what of value 02999").collect()] == ["value 02999"]


def test_tables_of_a_question():
    assert route.tables_for("revenue by nation") == ["spending_nation"]
    assert route.tables_for("revenue by brand") == ["spending_nation_brand"]
    assert route.tables_for("revenue and balance by nation") == ["spending_nation", "accounts_nation"]
    assert route.tables_for("cash flow of nations") == ["accounts_nation"]
    assert route.tables_for("flows between nations") == ["flow_nation"]
    assert route.tables_for("rivers") == []


def test_grounding(spark, small):
    g = route.ground(spark, small.dir, "revenue and balance of NATION_3 in 1999")
    assert g.tables == ["spending_nation", "accounts_nation"] and g.joins == {("spending_nation", "accounts_nation"): ("nation", "nation")}
    assert g.schema["spending_nation"]["revenue"] == "dollars" and g.schema["spending_nation"]["period"] == "period"
    assert g.values["nation"] == "NATION_3" and g.periods == {"spending_nation": "1999"}
    assert any("accounts_nation has no periods" in w for w in g.warnings)
    assert route.ground(spark, small.dir, "revenue").periods == {"spending_nation": "2000"}


def test_questions(spark, small):
    a = route.ask(spark, small.dir, "top 3 nations by revenue in 1999")
    assert a.resolution == "answered" and len(a.rows) == 3 and a.contract.period == "1999"
    assert a.charts[0]["kind"] == "ranking" and route.faithful(a.text, a.rows)
    b = route.ask(spark, small.dir, "trend of revenue over time")
    assert b.contract.operation == "trend" and len(b.rows) == 7
    both = route.ask(spark, small.dir, "revenue and balance by nation")
    assert both.contract.operation == "cross_metric" and set(both.rows[0]) == {"label", "value", "other_value"} and len(both.rows) == 25
    assert route.ask(spark, small.dir, "show me that").resolution == "needs_clarification"
    assert route.ask(spark, small.dir, "show me that", Contract("ranking", "spending_nation", "revenue", limit=2)).rows
    assert route.ask(spark, small.dir, "write a poem").resolution == "unsupported"
    assert route.ask(spark, small.dir, "what data is there").resolution == "answered"
    assert not route.faithful("revenue: 12345", a.rows)
    few = route.ask(spark, small.dir, "top 9 nations by revenue", most=4)
    assert few.more and len(few.rows) == 4 and not a.more


def test_the_better_rank_of_a_measure():
    ground = lambda q: route.Grounding(route.tables_for(q))
    largest = lambda q: route.contract_for(q, ground(q)).largest
    assert largest("best nations by revenue") and not largest("best nations by debits")
    assert largest("worst nations by debits") and not largest("worst nations by revenue")


def test_flow_and_metadata_contracts(spark, small):
    pairs = compiled(spark, small.dir, Contract("flow_pair_total", "flow_nation"))
    assert pairs.columns == ["origin", "destination", "amount", "n_flows"]
    assert sum(r.share for r in compiled(spark, small.dir, Contract("flow_share", "flow_nation")).collect()) == pytest.approx(100, abs=1e-3)
    assert compiled(spark, small.dir, Contract("metadata_answer")).count() == len(catalog.TABLES)
    with pytest.raises(ValueError):
        compiled(spark, small.dir, Contract("flow_share", "accounts_nation"))


def test_values_carry_columns_and_go_by_pages(spark, small):
    whole = compiled(spark, small.dir, Contract("values", "spending_nation", "revenue", carry=("region",))).collect()
    assert len(whole) == 25 and set(whole[0].asDict()) == {"label", "value", "region"}
    pages = [r for k in range(0, 30, 10) for r in compiled(spark, small.dir, Contract("values", "spending_nation", "revenue", carry=("region",), limit=10, offset=k)).collect()]
    assert pages == whole
    with pytest.raises(KeyError):
        compiled(spark, small.dir, Contract("values", "spending_nation", carry=("brand",)))


def test_rows_of_the_catalog(spark, small):
    n = {r["name"]: r.n_rows for r in catalog.total_rows(spark, small.dir).collect()}
    assert set(n) == {None, *catalog.TABLES} and n[None] == sum(v for k, v in n.items() if k)


RANKING = [{"label": f"NATION_{k}", "value": 9.0 - k} for k in range(4)]


def test_a_ranking_is_bars_and_places_on_a_map():
    c = Contract("ranking", "spending_nation", "revenue", limit=4)
    drawn = visuals.charts(c, RANKING)[0]
    assert drawn["kind"] == "ranking" and drawn["spec"]["encoding"]["y"]["field"] == "label" and drawn["spec"]["encoding"]["x"]["axis"]["format"] == "$,.3s"
    assert visuals.map_for(c, RANKING) == {"enabled": True, "kind": "first places", "level": "nation", "metric": "revenue", "n": 4}
    many = [{"label": str(k), "value": k} for k in range(60)]
    assert len(visuals.charts(c, many)[0]["spec"]["data"]["values"]) == visuals.NAMED


def test_a_comparison_has_colours_and_names_its_places():
    c = Contract("compare", "accounts_nation", "balance", names=("NATION_0", "NATION_1"))
    assert visuals.charts(c, RANKING[:2])[0]["spec"]["encoding"]["color"]["field"] == "label"
    assert visuals.map_for(c, RANKING[:2])["places"] == ["NATION_0", "NATION_1"]


def test_a_trend_is_a_line_and_values_a_distribution_of_all():
    assert visuals.charts(Contract("trend", "spending_nation", "revenue"), RANKING)[0]["spec"]["mark"]["type"] == "line"
    assert not visuals.map_for(Contract("trend", "spending_nation", "revenue"), RANKING)["enabled"]
    rows = [{"label": str(k), "value": k / 10} for k in range(60)] + [{"label": "x", "value": None}]
    drawn = visuals.charts(Contract("values", "accounts_nation", "debit_ratio"), rows)[0]
    assert drawn["spec"]["encoding"]["x"]["bin"] and len(drawn["spec"]["data"]["values"]) == 60


def test_two_metrics_are_points_and_flows_a_grid():
    c = Contract("cross_metric", "spending_nation", "revenue", other_table="accounts_nation", other_metric="balance")
    drawn = visuals.charts(c, [{**r, "other_value": 1.0} for r in RANKING])[0]
    assert drawn["kind"] == "relation" and drawn["spec"]["encoding"]["y"]["title"] == "Balance"
    f = Contract("flow_pair_total", "flow_nation", "amount")
    rows = [{"origin": "a", "destination": b, "amount": 1.0, "n_flows": 2} for b in "bc"]
    assert visuals.charts(f, rows)[0]["spec"]["mark"]["type"] == "rect" and visuals.map_for(f, rows)["kind"] == "flows"


def test_what_no_place_has_is_not_on_a_map():
    c = Contract("breakout", "spending_nation_brand", "revenue", entity="brand", where=(("nation", "NATION_0"),))
    assert visuals.charts(c, RANKING) and not visuals.map_for(c, RANKING)["enabled"]
    c = Contract("ranking", "spending_nation", "revenue", where=(("region", "REGION_1"),))
    assert visuals.map_for(c, RANKING)["focus"] == "REGION_1"
    assert visuals.charts(c, RANKING[:1]) == [] and visuals.charts(c, []) == [] and not visuals.map_for(c, [])["enabled"]
    assert visuals.charts(Contract("metadata_answer"), RANKING) == [] and not visuals.map_for(Contract("metadata_answer"), RANKING)["enabled"]


def test_the_measure_of_interest_is_the_catalogs():
    c = Contract("values", "accounts_nation", "balance")
    assert visuals.measure_of_interest(c, RANKING) == "value"
    assert visuals.measure_of_interest(Contract("values", "accounts_nation"), [{"nation": "a", "rank": 1, "debits": 2.0, "customers": None}]) == "debits"
    assert visuals.measure_of_interest(c, []) is None and visuals.highest(RANKING, "value")["label"] == "NATION_0"
    assert visuals.with_where(Contract("ranking", "spending_nation", where=(("region", "R"),)), [{"label": "a"}]) == [{"region": "R", "label": "a"}]
