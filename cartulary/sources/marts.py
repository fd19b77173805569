"""Tables by geography and period, and directed flows, made from the star schema.

Dimensions of a fixed size (nation, region) are broadcast; customers, suppliers,
parts and orders grow with the data, so how they join is left to the optimiser.
Money is summed as DECIMAL(18, 2), so sums don't depend on their order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import scan

ALL_YEARS = "1995-2001"


def money(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def total(column: Column | str) -> Column:
    return F.sum(column).cast("double")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_key, nation, region."""
    n, r = scan(spark, sf_dir, "nation"), scan(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def dated(orders: DataFrame, years: tuple[int, int] | None) -> DataFrame:
    """Orders of a range of years, by a range of dates, which reaches the scan."""
    if years is None:
        return orders
    day = lambda y: F.lit(f"{y:04d}-01-01").cast("timestamp_ntz")
    return orders.filter((F.col("o_orderdate") >= day(years[0])) & (F.col("o_orderdate") < day(years[1] + 1)))


def buyers(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None) -> DataFrame:
    """order_key, year, nation_key, segment: one row an order."""
    orders = dated(scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), years).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = scan(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("o_orderkey").alias("order_key"), "year", F.col("c_nationkey").alias("nation_key"), "segment")


def sales(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """One row a line item: nation and region of the customer, year as text, order, amount, quantity, keys."""
    items = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_partkey", "l_suppkey", money("l_extendedprice").alias("amount"), money("l_quantity").alias("quantity"))
    rows = items.join(buyers(spark, sf_dir, years), "order_key")
    return rows.join(F.broadcast(nations(spark, sf_dir)), "nation_key").select("nation", "region", "year", F.col("year").cast("string").alias("period"), "segment", "order_key", F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_key"), "amount", "quantity")


def years_of_period(period: str | None) -> tuple[int, int] | None:
    """The years that a period's rows can be of; None: any."""
    return (int(period), int(period)) if period and re.fullmatch(r"[0-9]{4}", period) else None


def spending(spark: SparkSession, sf_dir: str, period: str | None = None) -> DataFrame:
    """nation, region, period, revenue, quantity, items: each year, and all years under a label of their own.

    A `period` gives the rows of that label alone; a year reads only its orders.
    Items are added up by order before they meet the orders.
    """
    items = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), money("l_extendedprice").alias("amount"), money("l_quantity").alias("quantity"))
    by_order = items.groupBy("order_key").agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"), F.count("*").alias("n"))
    rows = by_order.join(buyers(spark, sf_dir, years_of_period(period)), "order_key")
    sums = rows.groupBy("nation_key", F.col("year").cast("string").alias("period")).agg(F.sum("amount").alias("revenue"), F.sum("quantity").alias("quantity"), F.sum("n").alias("items"))
    years = sums.join(F.broadcast(nations(spark, sf_dir)), "nation_key").select("nation", "region", "period", "revenue", "quantity", "items")
    every = years.groupBy("nation", "region").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.sum("items").alias("items")).withColumn("period", F.lit(ALL_YEARS))
    if period == ALL_YEARS:
        found = every
    else:
        found = years.unionByName(every) if period is None else years.filter(F.col("period") == period)
    return found.select("nation", "region", "period", F.col("revenue").cast("double").alias("revenue"), F.col("quantity").cast("double").alias("quantity"), "items")


def spending_by_brand(spark: SparkSession, sf_dir: str, period: str | None = None) -> DataFrame:
    """nation, brand, period, revenue."""
    parts = scan(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    rows = sales(spark, sf_dir, years_of_period(period))
    rows = rows if period is None else rows.filter(F.col("period") == period)
    return rows.join(parts, F.col("part_key") == F.col("p_partkey")).groupBy("nation", "brand", "period").agg(total("amount").alias("revenue"))


def accounts(spark: SparkSession, sf_dir: str, period: str | None = None) -> DataFrame:
    """nation, region, customers, credits, debits (of customers' balances) and balance; there are no periods."""
    c = scan(spark, sf_dir, "customer").select("c_nationkey", money("c_acctbal").alias("balance"))
    sums = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum(F.greatest("balance", money(F.lit(0)))).cast("double").alias("credits"), F.sum(-F.least("balance", money(F.lit(0)))).cast("double").alias("debits"), total("balance").alias("balance"))
    n = nations(spark, sf_dir)
    return sums.join(F.broadcast(n), sums.c_nationkey == n.nation_key).select("nation", "region", "customers", "credits", "debits", "balance")


def flows(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None, brands: bool = True) -> DataFrame:
    """origin (supplier's nation), destination (customer's nation), year, brand, amount: one row a line item.

    Without `brands` there is no brand, and the parts aren't read.
    """
    n = nations(spark, sf_dir).select("nation_key", F.col("nation").alias("origin"))
    suppliers = scan(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    suppliers = suppliers.join(F.broadcast(n), suppliers.s_nationkey == n.nation_key).select("s_suppkey", "origin")
    s = sales(spark, sf_dir, years)
    rows = s.join(suppliers, s.supplier_key == suppliers.s_suppkey)
    names = ["origin", F.col("nation").alias("destination"), "year", "amount"]
    if not brands:
        return rows.select(*names)
    parts = scan(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return rows.join(parts, rows.part_key == parts.p_partkey).select(*names, "brand")
