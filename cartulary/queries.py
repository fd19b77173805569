"""Queries over the library's own operators, each with the same in ANSI SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import places, text
from .operators import finance, flows, geo, joins, stats
from .plans import catalog, gate, resolve
from .plans.contract import Contract, compiled, composite
from .sources import marts
from .sources.stored import fresh_path
from .sources.tables import append_json_lines, extent, nan_to_null, payload, register, scan
from .streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Names that questions ask about: the first and the last nation.
FIRST, LAST = "NATION_0", "NATION_9"

SALES = """sales AS (
  SELECT n.n_name AS nation, r.r_name AS region, CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(year(o.o_orderdate) AS VARCHAR) AS period,
         l.l_suppkey AS supplier_key, l.l_partkey AS part_key, c.c_mktsegment AS segment,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l.l_quantity AS DECIMAL(18,2)) AS quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
SPENDING = SALES + """, years AS (
  SELECT nation, region, period, SUM(amount) AS revenue, SUM(quantity) AS quantity, COUNT(*) AS items FROM sales GROUP BY ALL
), spending AS (
  SELECT nation, region, period, CAST(revenue AS DOUBLE) AS revenue, CAST(quantity AS DOUBLE) AS quantity, CAST(items AS BIGINT) AS items FROM years
  UNION ALL SELECT nation, region, '1995-2001', CAST(SUM(revenue) AS DOUBLE), CAST(SUM(quantity) AS DOUBLE), CAST(SUM(items) AS BIGINT) FROM years GROUP BY nation, region)"""
BRANDS = SALES + """, brands AS (
  SELECT nation, p.p_brand AS brand, period, CAST(SUM(amount) AS DOUBLE) AS revenue FROM sales JOIN part p ON part_key = p.p_partkey GROUP BY ALL)"""
ACCOUNTS = """accounts AS (
  SELECT n.n_name AS nation, r.r_name AS region, CAST(COUNT(*) AS BIGINT) AS customers,
         CAST(SUM(greatest(CAST(c_acctbal AS DECIMAL(18,2)), 0)) AS DOUBLE) AS credits, CAST(SUM(-least(CAST(c_acctbal AS DECIMAL(18,2)), 0)) AS DOUBLE) AS debits,
         CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name)"""
_ENDS = """s.year, s.amount FROM sales s JOIN supplier su ON s.supplier_key = su.s_suppkey JOIN nation sn ON su.s_nationkey = sn.n_nationkey"""
#: Flows without brands, which don't read the parts, and with them.
PLAIN_FLOWS = SALES + f""", flows AS (
  SELECT sn.n_name AS origin, s.nation AS destination, {_ENDS})"""
FLOWS = SALES + f""", flows AS (
  SELECT p.p_brand AS brand, sn.n_name AS origin, s.nation AS destination, {_ENDS} JOIN part p ON s.part_key = p.p_partkey)"""


def query(sql: str | None = None, before: str = ""):
    """Registers a function under its name, with its SQL after the common tables it needs."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {before} {sql}" if before else sql
        return f

    return put


def contract(spark: SparkSession, d: str, operation: str, table: str, **slots) -> DataFrame:
    return compiled(spark, d, Contract(operation=operation, table=table, **slots))


# --- scans, projections, filters ---


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem")
def parquet_scan_count(spark, d):
    return scan(spark, d, "lineitem").agg(F.count("*").alias("n"), marts.total(marts.money("l_quantity")).alias("quantity"))


@query("SELECT nation AS label, revenue AS value FROM spending WHERE period = '2000' ORDER BY revenue DESC, nation LIMIT 10", SPENDING)
def rank_topk(spark, d):
    return contract(spark, d, "ranking", "spending_nation", metric="revenue", limit=10)


@query("SELECT nation AS label, revenue AS value FROM spending WHERE period = '2000' ORDER BY revenue, nation LIMIT 5", SPENDING)
def rank_bottomk(spark, d):
    return contract(spark, d, "ranking", "spending_nation", metric="revenue", limit=5, largest=False)


@query("SELECT nation AS label, revenue AS value FROM spending WHERE period = '1995-2001' ORDER BY revenue DESC, nation LIMIT 1", SPENDING)
def top1_entity(spark, d):
    return contract(spark, d, "ranking", "spending_nation", metric="revenue", limit=1, period=marts.ALL_YEARS)


@query("SELECT nation AS label, revenue AS value FROM spending WHERE period = '2000' AND lower(nation) = 'nation_0'", SPENDING)
def lookup_scalar(spark, d):
    return contract(spark, d, "lookup", "spending_nation", metric="revenue", names=(f" {FIRST.lower()} ",))


@query("SELECT nation AS label, revenue AS value FROM spending WHERE period = '2000' AND nation IN ('NATION_0', 'NATION_1') ORDER BY revenue DESC", SPENDING)
def compare_in(spark, d):
    return contract(spark, d, "compare", "spending_nation", metric="revenue", names=(FIRST, "NATION_1"))


@query("SELECT period AS label, ROUND(AVG(revenue), 6) AS value FROM spending WHERE length(period) = 4 GROUP BY period", SPENDING)
def trend_avg(spark, d):
    return contract(spark, d, "trend", "spending_nation", metric="revenue")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def prefix_filter(spark, d):
    return scan(spark, d, "customer").filter(F.startswith("c_name", F.lit("Customer#00000001"))).select("c_custkey", "c_name")


@query("SELECT n_name AS nation, ROUND(n.total * (100.0 * n.building / n.total) / 100.0, 6) AS building_customers FROM (SELECT c_nationkey, COUNT(*) AS total, SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS building FROM customer GROUP BY 1) n JOIN nation ON c_nationkey = n_nationkey")
def derived_count(spark, d):
    n = scan(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count(F.when(F.col("c_mktsegment") == "BUILDING", 1)).alias("building"))
    n = n.join(F.broadcast(marts.nations(spark, d)), F.col("c_nationkey") == F.col("nation_key"))
    share = 100.0 * F.col("building") / F.col("total")
    return n.select("nation", F.round(F.col("total") * share / 100.0, 6).alias("building_customers"))


@query("SELECT c_mktsegment AS segment, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def share_pct(spark, d):
    c = scan(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(c.agg(F.count("*").alias("whole")))).select("segment", F.round(100.0 * F.col("n") / F.col("whole"), 6).alias("share"))


@query("SELECT nation, ROUND(debits / NULLIF(credits, 0), 6) AS debit_ratio, ROUND(balance / NULLIF(customers, 0), 6) AS balance_per_customer FROM accounts", ACCOUNTS)
def ratio_metric(spark, d):
    return catalog.load(spark, d, "accounts_nation").select("nation", "debit_ratio", "balance_per_customer")


@query("SELECT nation, CAST(COALESCE(credits, 0) + COALESCE(debits, 0) AS DOUBLE) AS turnover FROM accounts", ACCOUNTS)
def composite_measure(spark, d):
    return composite(catalog.load(spark, d, "accounts_nation"), "accounts_nation", ["credits", "debits"], "turnover").select("nation", "turnover")


@query("SELECT nation, period, items FROM spending WHERE period = '1996'", SPENDING)
def period_label_filter(spark, d):
    return catalog.load(spark, d, "spending_nation", "1996").filter(F.col("period").cast("string") == "1996").select("nation", "period", "items")


@query("SELECT nation, period, items FROM spending WHERE period = '1995-2001'", SPENDING)
def period_multi_year(spark, d):
    return catalog.load(spark, d, "spending_nation", marts.ALL_YEARS).filter(F.col("period") == marts.ALL_YEARS).select("nation", "period", "items")


@query("SELECT nation AS label, revenue AS value FROM spending WHERE period = '2000' ORDER BY nation LIMIT 5000", SPENDING)
def values_endpoint(spark, d):
    return contract(spark, d, "values", "spending_nation", metric="revenue")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_totalprice <> 0")
def conjunction_filter(spark, d):
    o = scan(spark, d, "orders")
    return o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_totalprice") != 0)).select("o_orderkey", "o_totalprice")


@query("WITH big AS (SELECT o_custkey, MAX(o_totalprice) AS most FROM orders GROUP BY 1) SELECT o_custkey, most FROM big WHERE most > (SELECT AVG(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def gated_sql(spark, d):
    register(spark, d)
    sql = """WITH big AS (SELECT o_custkey, MAX(o_totalprice) AS most FROM mart_orders GROUP BY 1)
      SELECT o_custkey, most FROM big WHERE most > (SELECT AVG(CAST(o_totalprice AS DECIMAL(18,2))) FROM mart_orders)
      AND o_custkey IN (SELECT c_custkey FROM mart_customer WHERE c_acctbal < 0)"""
    return spark.sql(gate.checked(spark, sql))


# --- joins ---


@query("SELECT s.nation AS label, s.revenue AS value, a.balance AS other_value FROM spending s JOIN accounts a ON lower(s.nation) = lower(a.nation) WHERE s.period = '2000'", f"{SPENDING}, {ACCOUNTS}")
def cross_metric_join(spark, d):
    return contract(spark, d, "cross_metric", "spending_nation", metric="revenue", other_table="accounts_nation", other_metric="balance")


@query("SELECT c_custkey, c_acctbal, o.total FROM customer JOIN (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey")
def fk_join_two_metrics(spark, d):
    o = scan(spark, d, "orders").groupBy("o_custkey").agg(marts.total(marts.money("o_totalprice")).alias("total"))
    return scan(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_acctbal", "total")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark, d):
    o = scan(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return scan(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, d):
    o = scan(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return scan(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n.n_name AS nation, s.n AS suppliers, c.n AS rich FROM nation n FULL OUTER JOIN (SELECT s_nationkey, CAST(COUNT(*) AS BIGINT) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey FULL OUTER JOIN (SELECT c_nationkey, CAST(COUNT(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) c ON n_nationkey = c_nationkey")
def outer_join(spark, d):
    s = scan(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = scan(spark, d, "customer").filter("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count("*").alias("rich"))
    n = scan(spark, d, "nation")
    return n.join(s, n.n_nationkey == s.s_nationkey, "full").join(c, n.n_nationkey == c.c_nationkey, "full").select(F.col("n_name").alias("nation"), "suppliers", "rich")


@query("SELECT n_name AS nation, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS matched FROM nation")
def matched_flag(spark, d):
    bad = scan(spark, d, "supplier").filter("s_acctbal < 0").select("s_nationkey").distinct().withColumn("hit", F.lit(True))
    n = scan(spark, d, "nation")
    return n.join(bad, n.n_nationkey == bad.s_nationkey, "left").select(F.col("n_name").alias("nation"), F.coalesce("hit", F.lit(False)).alias("matched"))


@query("SELECT e.event_id, p.value AS last_value FROM events e ASOF JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'")
def asof_last(spark, d):
    e = scan(spark, d, "events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return stats.as_of(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["last_value"]).filter("last_value is not null").select("event_id", "last_value")


# --- aggregates ---


@query("SELECT brand AS label, revenue AS value FROM brands WHERE period = '2000' AND nation = 'NATION_0' ORDER BY revenue DESC, brand LIMIT 10", BRANDS)
def agency_breakout(spark, d):
    return contract(spark, d, "breakout", "spending_nation_brand", metric="revenue", entity="brand", where=(("nation", FIRST),))


@query("SELECT CAST(COUNT(revenue) AS BIGINT) AS n, MIN(revenue) AS least, MAX(revenue) AS most, ROUND(AVG(revenue), 6) AS mean, ROUND(MEDIAN(revenue), 6) AS median FROM spending WHERE period = '2000'", SPENDING)
def summary_stats(spark, d):
    return contract(spark, d, "summary", "spending_nation", metric="revenue")


@query()
def approximate_summary(spark, d):
    """About how many customers order, and about the quartiles of their orders' prices; a test holds it to the exact ones."""
    return stats.approximate_summary(scan(spark, d, "orders"), "o_totalprice", "o_custkey")


@query("SELECT nation, balance, (SELECT ROUND(AVG(balance), 6) FROM accounts) AS mean, (SELECT ROUND(MEDIAN(balance), 6) FROM accounts) AS median FROM accounts WHERE nation = 'NATION_9'", ACCOUNTS)
def entity_vs_national(spark, d):
    return stats.against_all(marts.accounts(spark, d).select("nation", "balance"), "balance", F.col("nation") == LAST)


@query("SELECT ROUND(CORR(s.revenue, a.balance), 4) AS r FROM spending s JOIN accounts a ON s.nation = a.nation WHERE s.period = '2000'", f"{SPENDING}, {ACCOUNTS}")
def correlation(spark, d):
    return cross_metric_join(spark, d).agg(F.round(F.corr("value", "other_value"), 4).alias("r"))


@query("SELECT s.nation FROM spending s JOIN accounts a ON s.nation = a.nation WHERE s.period = '2000' AND s.revenue > (SELECT MEDIAN(revenue) FROM spending WHERE period = '2000') AND a.balance < (SELECT MEDIAN(balance) FROM accounts)", f"{SPENDING}, {ACCOUNTS}")
def high_low_filter(spark, d):
    both = cross_metric_join(spark, d)
    middle = both.agg(F.median("value").alias("v"), F.median("other_value").alias("o"))
    return both.crossJoin(F.broadcast(middle)).filter("value > v and other_value < o").select(F.col("label").alias("nation"))


@query("SELECT COALESCE(r.r_name, '*') AS region, COALESCE(c_mktsegment, '*') AS segment, CAST(COUNT(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY ROLLUP (r.r_name, c_mktsegment)")
def rollup(spark, d):
    c = scan(spark, d, "customer").join(F.broadcast(marts.nations(spark, d)), F.col("c_nationkey") == F.col("nation_key"))
    return c.rollup("region", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).select(F.coalesce("region", F.lit("*")).alias("region"), F.coalesce("segment", F.lit("*")).alias("segment"), "n")


@query("SELECT COALESCE(l_returnflag, '*') AS flag, COALESCE(l_linestatus, '*') AS status, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    rows = scan(spark, d, "lineitem").select("l_returnflag", "l_linestatus", marts.money("l_extendedprice").alias("m"))
    return rows.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), marts.total("m").alias("amount")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "amount")


@query("SELECT p_brand AS brand, CAST(COUNT(DISTINCT p_type) AS BIGINT) AS types, CAST(COUNT(*) FILTER (WHERE p_size > 25) AS BIGINT) AS large, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY 1 HAVING COUNT(*) > 10")
def having_distinct_listagg(spark, d):
    p = scan(spark, d, "part")
    rows = p.groupBy(F.col("p_brand").alias("brand")).agg(F.countDistinct("p_type").alias("types"), F.count(F.when(F.col("p_size") > 25, 1)).alias("large"), F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"), F.count("*").alias("n"))
    return rows.filter("n > 10").drop("n")


# --- flows ---


@query("SELECT CAST(SUM(amount) AS DOUBLE) AS amount FROM flows WHERE lower(destination) = 'nation_0'", PLAIN_FLOWS)
def flow_inflow(spark, d):
    return flows.amount_of(flows.filtered(marts.flows(spark, d, brands=False), destination=FIRST))


@query("SELECT CAST(SUM(amount) AS DOUBLE) AS amount FROM flows WHERE origin = 'NATION_0' AND year BETWEEN 1996 AND 1998 AND brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')", FLOWS)
def flow_outflow_filtered(spark, d):
    return flows.amount_of(flows.filtered(marts.flows(spark, d, years=(1996, 1998)), origin=FIRST, years=(1996, 1998), brands=["Brand#11", "Brand#12", "Brand#13", "Brand#21"]))


@query("SELECT origin, destination, CAST(SUM(amount) AS DOUBLE) AS amount, CAST(COUNT(*) AS BIGINT) AS n_flows FROM flows GROUP BY 1, 2", PLAIN_FLOWS)
def flow_pair_total(spark, d):
    return flows.pairs(marts.flows(spark, d, brands=False))


@query("SELECT destination, CAST(SUM(amount) AS DOUBLE) AS amount, ROUND(CAST(SUM(amount) AS DOUBLE) * 100 / (SELECT CAST(SUM(amount) AS DOUBLE) FROM flows), 6) AS share FROM flows GROUP BY 1", PLAIN_FLOWS)
def flow_share(spark, d):
    return flows.shares(marts.flows(spark, d, brands=False))


@query("SELECT origin = destination AS internal, CAST(SUM(amount) AS DOUBLE) AS amount, CAST(COUNT(*) AS BIGINT) AS n_flows FROM flows GROUP BY 1", PLAIN_FLOWS)
def flow_internal_split(spark, d):
    return flows.internal_split(marts.flows(spark, d, brands=False))


@query("SELECT origin, destination, brand, amount FROM (SELECT origin, destination, brand, CAST(SUM(amount) AS DOUBLE) AS amount, row_number() OVER (PARTITION BY origin, destination ORDER BY SUM(amount) DESC, brand) AS n FROM flows GROUP BY 1, 2, 3) WHERE n = 1", FLOWS)
def flow_top_contributor(spark, d):
    return flows.top_contributors(marts.flows(spark, d))


@query("SELECT CAST(SUM(amount) AS DOUBLE) AS amount, CAST(COUNT(*) AS BIGINT) AS n_flows, CAST(SUM(amount) FILTER (WHERE origin = destination) AS DOUBLE) AS internal_amount, CAST(COUNT(*) FILTER (WHERE origin = destination) AS BIGINT) AS n_internal, (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT origin FROM flows UNION SELECT destination FROM flows)) AS n_places, ROUND(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 6) AS mean_amount FROM flows", PLAIN_FLOWS)
def flow_summary(spark, d):
    return flows.summary(marts.flows(spark, d, brands=False))


@query("SELECT bucket, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN a <= 1e6 THEN '<=1M' WHEN a <= 1e7 THEN '1-10M' WHEN a <= 1e8 THEN '10-100M' WHEN a <= 1e9 THEN '100M-1B' ELSE '>1B' END AS bucket FROM (SELECT CAST(SUM(amount) AS DOUBLE) AS a FROM flows GROUP BY origin, destination)) GROUP BY 1", PLAIN_FLOWS)
def flow_buckets(spark, d):
    return flows.pairs(marts.flows(spark, d, brands=False)).groupBy(stats.stepped(F.col("amount"), stats.FLOW_STEPS, stats.FLOW_LAST).alias("bucket")).agg(F.count("*").alias("n"))


# --- ranks and classes ---

_CLASSED = """SELECT nation, revenue, CAST(CASE WHEN revenue < b1 THEN 1 WHEN revenue < b2 THEN 2 WHEN revenue < b3 THEN 3 WHEN revenue < b4 THEN 4 ELSE 5 END AS BIGINT) AS quintile
FROM (SELECT nation, revenue FROM spending WHERE period = '2000') CROSS JOIN (SELECT {} FROM (SELECT list(revenue ORDER BY revenue) AS v, COUNT(*) AS n FROM spending WHERE period = '2000'))"""


@query(_CLASSED.format(", ".join(f"v[1 + CAST(least(n - 1, floor(n * {s} / 5.0)) AS BIGINT)] AS b{s}" for s in range(1, 5))), SPENDING)
def quintile_rule_a(spark, d):
    return stats.classed(marts.spending(spark, d, "2000").select("nation", "revenue"), "revenue", "floor")


@query(_CLASSED.format(", ".join(f"v[1 + CAST(floor({s} / 5.0 * (n - 1)) AS BIGINT)] AS b{s}" for s in range(1, 5))), SPENDING)
def quintile_rule_b(spark, d):
    return stats.classed(marts.spending(spark, d, "2000").select("nation", "revenue"), "revenue", "rank")


@query("SELECT c_custkey, c_acctbal, c_name, CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS BIGINT) AS rank FROM customer")
def full_ranking(spark, d):
    return stats.ranked(scan(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name"), "c_acctbal", "c_custkey")


@query("SELECT nation, region, revenue, CAST(rank() OVER w AS INTEGER) AS place, ROUND(percent_rank() OVER w, 6) AS percentile FROM spending WHERE period = '2000' WINDOW w AS (PARTITION BY region ORDER BY revenue DESC)", SPENDING)
def rank_percentile(spark, d):
    w = Window.partitionBy("region").orderBy(F.desc("revenue"))
    return marts.spending(spark, d, "2000").select("nation", "region", "revenue", F.rank().over(w).alias("place"), F.round(F.percent_rank().over(w), 6).alias("percentile"))


@query("SELECT CAST(CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 12 ELSE 1 + floor((c_acctbal + 1000) / 1000) END AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1")
def histogram(spark, d):
    return stats.histogram(scan(spark, d, "customer"), "c_acctbal", -1000.0, 10000.0, 11)


@query("SELECT nation, period, CAST(revenue AS DOUBLE) AS revenue, lag(revenue) OVER w AS before, CAST(SUM(items) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS items_3y FROM spending WHERE length(period) = 4 WINDOW w AS (PARTITION BY nation ORDER BY period)", SPENDING)
def moving_frame(spark, d):
    w = Window.partitionBy("nation").orderBy("period")
    return marts.spending(spark, d).filter(F.length("period") == 4).select("nation", "period", "revenue", F.lag("revenue").over(w).alias("before"), F.sum("items").over(w.rowsBetween(-2, 0)).alias("items_3y"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def last_write_wins(spark, d):
    return stats.last_by(scan(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT conv_id, turn, substring(text, 1, 200) AS start FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def last_messages(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return spark.read.parquet(f"{d}/conversations.parquet").withColumn("n", F.row_number().over(w)).filter("n <= 4").select("conv_id", "turn", F.substring("text", 1, 200).alias("start"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recency_sort(spark, d):
    return scan(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_custkey", "o_orderdate")


# --- sets and the catalog ---


@query("SELECT DISTINCT CAST(p_brand AS VARCHAR) AS value FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 2000")
def distinct_values(spark, d):
    return resolve.distinct_values(scan(spark, d, "part"), "p_brand")


@query("SELECT s_nationkey AS key FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all(spark, d):
    return scan(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).union(scan(spark, d, "customer").select("c_nationkey"))


@query("SELECT s_nationkey AS key FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def intersect(spark, d):
    return scan(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).intersect(scan(spark, d, "customer").filter("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT n_nationkey AS key FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_(spark, d):
    return scan(spark, d, "nation").select(F.col("n_nationkey").alias("key")).subtract(scan(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def catalog_anti(spark, d):
    sold = scan(spark, d, "lineitem").filter("l_quantity > 45")
    return scan(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""SELECT * FROM (VALUES ('accounts','accounts_nation','nation',8,NULL), ('flow','flow_nation','line item',5,NULL), ('spending','spending_nation','nation',6,'2000'), ('spending','spending_nation_brand','nation by brand',4,'2000')) t(family, name, grain, n_columns, default_period)""")
def metadata_answer(spark, d):
    return catalog.listing(spark)


# --- scalar functions ---


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part")
def text_normalize(spark, d):
    return scan(spark, d, "part").select("p_partkey", text.normalized(F.concat_ws(" #", "p_name", "p_brand")).alias("name"))


@query("""SELECT p_partkey, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect(w, ['steel', 'small', 'brand', 'large', 'copper'])) AS DOUBLE) / len(w) END AS share FROM (
  SELECT p_partkey, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN ('department','of','the','and','office','us','u','s'))) AS w FROM part)""")
def token_overlap(spark, d):
    words = text.content_words(F.concat_ws(" ", "p_type", "p_name"))
    asked = F.array(*map(F.lit, ("steel", "small", "brand", "large", "copper")))
    return scan(spark, d, "part").select("p_partkey", text.overlap(words, asked).alias("share"))


@query("SELECT o_orderkey, CAST(len(regexp_extract_all(t, '-?[0-9][0-9,]*\\.?[0-9]*')) AS INTEGER) AS n, CAST(replace(regexp_extract_all(t, '-?[0-9][0-9,]*\\.?[0-9]*')[1], ',', '') AS DOUBLE) AS first FROM (SELECT o_orderkey, 'order ' || o_orderkey || ' of customer ' || o_custkey || ', priority ' || o_orderpriority AS t FROM orders)")
def number_extract(spark, d):
    found = text.numbers_in(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "), F.col("o_custkey").cast("string"), F.lit(", priority "), F.col("o_orderpriority")))
    return scan(spark, d, "orders").select("o_orderkey", F.size(found).alias("n"), found[0].alias("first"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'MD-' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') WHEN s_suppkey % 3 = 1 THEN 'VA-' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') END AS district FROM supplier")
def district_normalize(spark, d):
    n = (F.col("s_suppkey") % 60).cast("string")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" md-"), n)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("VA"), F.lpad(n, 2, "0"))).otherwise(F.concat(F.lit("Virginia "), n))
    return scan(spark, d, "supplier").select("s_suppkey", text.district(raw).alias("district"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN ROUND(l_tax / l_discount, 6) END AS x FROM lineitem")
def nan_to_null_rows(spark, d):
    x = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.round(F.try_divide(F.col("l_tax"), F.col("l_discount")), 6))
    return nan_to_null(scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")))


#: Supplier balances over nine magnitudes and both signs, and none for every eleventh.
_AMOUNT = "CASE WHEN s_suppkey % 11 <> 10 THEN ROUND(s_acctbal * [0.01, 1, 10, 100, 1000, 10000, 100000, 1000000, 10000000][1 + s_suppkey % 9], 2) END"


@query(f"""SELECT s_suppkey, CASE WHEN a IS NULL THEN 'N/A' ELSE CASE WHEN a < 0 THEN '-' ELSE '' END || '$' || CASE
    WHEN abs(a) >= 1e9 THEN printf('%.2f', abs(a) / 1e9) || 'B' WHEN abs(a) >= 1e6 THEN printf('%.2f', abs(a) / 1e6) || 'M'
    WHEN abs(a) >= 1e3 THEN format('{{:,}}', CAST(round_even(abs(a), 0) AS BIGINT)) ELSE printf('%.2f', abs(a)) END END AS shown
  FROM (SELECT s_suppkey, {_AMOUNT} AS a FROM supplier)""")
def money_shown(spark, d):
    steps = F.array(*(F.lit(x) for x in (0.01, 1.0, 10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e7)))
    step = F.try_element_at(steps, F.nullif((1 + F.col("s_suppkey") % 9).cast("int"), F.lit(0)))  # negative keys count from the end, as in the SQL
    exact = scan(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 11 != 10, F.col("s_acctbal") * step).alias("a"))
    amounts = exact.select("s_suppkey", text.rounded("a", 2).alias("a"))  # columns of their own: each is used several times
    return amounts.select("s_suppkey", text.shown(F.lit("grants"), "a").alias("shown"))


@query("SELECT nation, sha256(nation || ':' || CAST(customers AS VARCHAR)) AS key FROM accounts", ACCOUNTS)
def hash_key(spark, d):
    return marts.accounts(spark, d).select("nation", F.sha2(F.concat(F.col("nation"), F.lit(":"), F.col("customers").cast("string")), 256).alias("key"))


@query()
def sequence_similarity(spark, d):
    """Similarity of every two nations' names that are alike at all; SQL has no such function."""
    n = marts.nations(spark, d).select("nation")  # of a fixed size
    both = n.join(F.broadcast(n.withColumnRenamed("nation", "other")), F.col("nation") < F.col("other"))
    return both.select("nation", "other", F.round(text.sequence_ratio("nation", "other"), 6).alias("ratio"))


@query()
def resolve_entity(spark, d):
    return resolve.resolved(resolve.distinct_values(marts.nations(spark, d), "nation"), f"how much did {FIRST.title()} receive")


# --- sources, features, pages and formats ---


@query("SELECT MIN(c_acctbal) AS min_lon, MIN(c_custkey) AS min_lat, MAX(c_acctbal) AS max_lon, MAX(c_custkey) AS max_lat FROM customer")
def bounding_box(spark, d):
    return extent(scan(spark, d, "customer"), "c_acctbal", "c_custkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.other') AS VARCHAR) AS other FROM events")
def json_payloads(spark, d):
    found = payload("props", "k int, other string")
    return scan(spark, d, "events").select("event_id", found["k"].alias("k"), found["other"].alias("other"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_lines_round_trip(spark, d):
    at = fresh_path(spark, "lines")
    append_json_lines(scan(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), at)
    return spark.read.schema("n_nationkey long, n_name string, n_regionkey long").json(at)


_FEATURES = "features AS (SELECT n_name AS key, n_nationkey AS shape FROM nation), results AS (SELECT n.n_name AS key, MAX(s_acctbal) AS value FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey WHERE s_acctbal > 5000 GROUP BY 1)"


def _features(spark, d):
    n = scan(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("key"))
    rich = scan(spark, d, "supplier").filter("s_acctbal > 5000").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are 25
    return n.select("key", F.col("n_nationkey").alias("shape")), rich.groupBy("key").agg(F.max("s_acctbal").alias("value"))


@query("SELECT key, shape, value FROM features JOIN results USING (key)", _FEATURES)
def features_highlighted(spark, d):
    return geo.highlighted(*_features(spark, d), "key")


@query("SELECT key, shape, value, value IS NOT NULL AS matched FROM features LEFT JOIN results USING (key)", _FEATURES)
def features_backdrop(spark, d):
    return geo.backdrop(*_features(spark, d), "key")


@query("SELECT key, shape FROM features WHERE key IN (SELECT key FROM results)", _FEATURES)
def features_within(spark, d):
    return geo.within(*_features(spark, d), "key")


@query("SELECT nation AS label, revenue AS value, region FROM spending WHERE period = '2000' ORDER BY nation LIMIT 10 OFFSET 10", SPENDING)
def values_page(spark, d):
    return contract(spark, d, "values", "spending_nation", metric="revenue", carry=("region",), limit=10, offset=10)


@query("SELECT CAST(NULL AS VARCHAR) AS name, CAST(a + b + c + e AS BIGINT) AS n_rows FROM n UNION ALL SELECT unnest(['accounts_nation', 'flow_nation', 'spending_nation', 'spending_nation_brand']), unnest([a, b, c, e]) FROM n", f"{FLOWS}, years AS (SELECT nation, region, period FROM sales GROUP BY ALL), n AS (SELECT (SELECT CAST(COUNT(DISTINCT c_nationkey) AS BIGINT) FROM customer) AS a, (SELECT CAST(COUNT(*) AS BIGINT) FROM flows) AS b, (SELECT CAST(COUNT(*) AS BIGINT) + COUNT(DISTINCT nation) FROM years) AS c, (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT DISTINCT nation, p_brand, period FROM sales JOIN part ON part_key = p_partkey)) AS e)")
def catalog_rows(spark, d):
    return catalog.total_rows(spark, d)


@query("SELECT COUNT(*) AS n_shown, CAST(SUM(a) AS DOUBLE) AS shown_amount FROM (SELECT SUM(amount) AS a FROM flows GROUP BY origin, destination ORDER BY a DESC, origin, destination LIMIT 25)", PLAIN_FLOWS)
def flows_displayed(spark, d):
    return flows.summary(marts.flows(spark, d, brands=False), shown=25).select("n_shown", "shown_amount")


@query("SELECT nation, revenue, MAX(revenue) OVER () - MIN(revenue) OVER () AS spread FROM spending WHERE period = '2000'", SPENDING)
def spread(spark, d):
    rows = marts.spending(spark, d, "2000").select("nation", "revenue")
    return rows.crossJoin(F.broadcast(rows.agg((F.max("revenue") - F.min("revenue")).alias("spread"))))  # of one row


@query("SELECT nation, period, lead(revenue) OVER w AS after, CAST(ntile(3) OVER w AS INTEGER) AS third, CAST(SUM(items) OVER (PARTITION BY nation ORDER BY CAST(period AS INTEGER) RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS items_around FROM spending WHERE length(period) = 4 WINDOW w AS (PARTITION BY nation ORDER BY period)", SPENDING)
def lead_ntile_range(spark, d):
    w = Window.partitionBy("nation").orderBy("period")
    around = Window.partitionBy("nation").orderBy(F.col("period").try_cast("int")).rangeBetween(-1, 1)
    return marts.spending(spark, d).filter(F.length("period") == 4).select("nation", "period", F.lead("revenue").over(w).alias("after"), F.ntile(3).over(w).alias("third"), F.sum("items").over(around).alias("items_around"))


@query("SELECT COALESCE(l_returnflag, '*') AS flag, COALESCE(l_linestatus, '*') AS status, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return scan(spark, d, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n")).select(F.coalesce(flag, F.lit("*")).alias("flag"), F.coalesce(status, F.lit("*")).alias("status"), "n")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 5")
def interval_join(spark, d):
    ranges = scan(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return joins.interval_join(scan(spark, d, "customer").select("c_custkey", "c_acctbal"), ranges, "c_acctbal", "low", "high", 5.0).select("c_custkey", "s_suppkey")


@query("SELECT n_name AS nation, o.o_orderkey, o.o_totalprice FROM nation JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o ON true")
def top_of_each(spark, d):
    o = scan(spark, d, "orders").join(scan(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    first = o.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    return first.join(F.broadcast(scan(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "o_orderkey", "o_totalprice")


@query("SELECT nation, credits + debits AS total FROM accounts", ACCOUNTS)
def spending_composite(spark, d):
    rows = marts.accounts(spark, d).select("nation", F.col("credits").alias("Contracts"), F.col("debits").alias("Grants"), F.lit(None).cast("double").alias("Resident Wage"))
    return rows.select("nation", geo.spending_total().alias("total"))


@query("SELECT nation, credits, debits, credits - debits AS rest FROM accounts", ACCOUNTS)
def complement(spark, d):
    return geo.with_complement(marts.accounts(spark, d).select("nation", "credits", "debits"), "rest", "credits", "debits")


@query(r"SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('St. ' || c_mktsegment || ' County, ' || c_name), '\bcounty\b', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g')) AS county FROM customer")
def county_normalize(spark, d):
    return scan(spark, d, "customer").select("c_custkey", text.county(F.concat(F.lit("St. "), F.col("c_mktsegment"), F.lit(" County, "), F.col("c_name"))).alias("county"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def title_case(spark, d):
    return scan(spark, d, "part").select("p_partkey", text.title(F.concat_ws(" ", "p_name", "p_type")).alias("title"))


@query("SELECT nation, credits - debits AS net_position, ROUND(debits / NULLIF(credits, 0), 6) AS debt_ratio, ROUND(credits / NULLIF(debits, 0), 6) AS current_ratio, ROUND(credits - debits - 100.0, 6) AS free_cash_flow, ROUND(balance / NULLIF(customers, 0), 6) AS per_capita FROM accounts", ACCOUNTS)
def finance_metrics(spark, d):
    rounded = lambda c, name: F.round(c, 6).alias(name)
    return marts.accounts(spark, d).select(
        "nation",
        finance.net_position("credits", "debits").alias("net_position"),
        rounded(finance.debt_ratio("debits", "credits"), "debt_ratio"),
        rounded(finance.current_ratio("credits", "debits"), "current_ratio"),
        rounded(finance.free_cash_flow("credits", "debits", F.lit(None).cast("double"), F.lit(100.0)), "free_cash_flow"),
        rounded(finance.per_capita("balance", "customers"), "per_capita"),
    )


@query("SELECT o_custkey, CAST(MIN(date_trunc('month', o_orderdate)) AS TIMESTAMP) AS first_month, CAST(date_diff('day', MIN(o_orderdate), MAX(o_orderdate)) AS INTEGER) AS days, array_to_string(list_sort(list(DISTINCT substring(o_orderpriority, 1, 1))), '>') AS priorities, CAST(len(list_filter(list(o_totalprice), lambda x: x > 200000)) AS INTEGER) AS large FROM orders GROUP BY 1")
def dates_and_arrays(spark, d):
    o = scan(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.date_trunc("month", "o_orderdate")).cast("timestamp_ntz").alias("first_month"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("p"), F.collect_list("o_totalprice").alias("t"))
    return o.select("o_custkey", "first_month", "days", F.array_join(F.array_sort("p"), ">").alias("priorities"), F.size(F.filter("t", lambda x: x > 200000)).alias("large"))


_STATES = list(places.STATES)


@query(f"SELECT s_suppkey, m.code FROM supplier LEFT JOIN (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate(places.STATES.values()))}) m(k, code) ON s_suppkey % 53 = m.k")
def state_codes(spark, d):
    names = F.array(*(F.lit(f" {n.title()}" if k % 2 else places.STATES[n].lower()) for k, n in enumerate(_STATES)), F.lit("nowhere"), F.lit(None).cast("string"))
    return scan(spark, d, "supplier").select("s_suppkey", places.postal_code(names[(F.col("s_suppkey") % 53).cast("int")]).alias("code"))


@query("SELECT o_orderkey, CAST(o_orderkey * 1001 AS DOUBLE) / 4 AS number, CAST(NULL AS DOUBLE) AS none FROM orders")
def number_parse(spark, d):
    shown = F.format_number(F.col("o_orderkey") * 1001 / 4, 2)
    return scan(spark, d, "orders").select("o_orderkey", text.number_of(shown).alias("number"), text.number_of(F.concat(shown, F.lit("x"))).alias("none"))


@query("SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) <= 0.02 * greatest(1.0, abs(l_discount)) AS close FROM lineitem")
def tolerance_compare(spark, d):
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.close(F.col("l_tax"), F.col("l_discount"), 0.02).alias("close"))


_KINDS = "".join(f" WHEN regexp_matches(name, '{p}') THEN '{k}'" for k, p in text.METRIC_KINDS.items())
_METRICS = ("Total_Assets", "Below poverty", "# of household", "cash_position", "Owner occupied", "Employees", "other")


@query(f"SELECT p_partkey, CASE{_KINDS} ELSE 'generic' END AS kind FROM (SELECT p_partkey, lower(list_extract({list(_METRICS)}, 1 + p_partkey % {len(_METRICS)})) AS name FROM part)")
def metric_kinds(spark, d):
    name = F.array(*map(F.lit, _METRICS))[(F.col("p_partkey") % len(_METRICS)).cast("int")]
    return scan(spark, d, "part").select("p_partkey", text.metric_kind(name).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 100 ELSE l_quantity END) || '%' AS percent, format('{:,}', CAST(l_quantity AS BIGINT) * 1000) AS count FROM lineitem")
def percent_and_count_shown(spark, d):
    share = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity"))
    share = F.when((F.col("l_linenumber") % 2 == 1) & (share <= 1.5), share / 100).otherwise(share)  # percents are from 1.5 up
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.shown(F.lit("poverty"), share).alias("percent"), text.shown(F.lit("population"), F.col("l_quantity") * 1000).alias("count"))


# --- extension: windows over events, as on a stream ---


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = scan(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_SESSIONS = """starts AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events
), numbered AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM starts)"""


@query("SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS end, CAST(COUNT(*) AS BIGINT) AS n FROM numbered GROUP BY user_id, s", _SESSIONS)
def event_sessions(spark, d):
    e = scan(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def events_once(spark, d):
    e = scan(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.once(e.unionByName(e)).select("event_id", "user_id", "event_type")
