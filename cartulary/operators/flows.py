"""Operators on directed flows: rows with origin, destination, year, brand and amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(name: str = "amount") -> Column:
    return F.sum("amount").cast("double").alias(name)


def filtered(flows: DataFrame, origin: str | None = None, destination: str | None = None, years: tuple[int, int] | None = None, brands: list[str] | None = None) -> DataFrame:
    """Rows of an origin, a destination, a range of years and brands; what is None doesn't matter."""
    if origin is not None:
        flows = flows.filter(F.lower("origin") == origin.lower())
    if destination is not None:
        flows = flows.filter(F.lower("destination") == destination.lower())
    if years is not None:
        flows = flows.filter(F.col("year").between(*years))
    return flows if brands is None else flows.filter(F.col("brand").isin(brands))


def amount_of(flows: DataFrame) -> DataFrame:
    return flows.agg(total("amount"))


def pairs(flows: DataFrame) -> DataFrame:
    """origin, destination, amount, n_flows of each pair."""
    return flows.groupBy("origin", "destination").agg(total("amount"), F.count("*").alias("n_flows"))


def shares(flows: DataFrame) -> DataFrame:
    """Each destination's amount and its share of all, in percent."""
    sums = flows.groupBy("destination").agg(total("amount"))
    whole = sums.agg(F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select("destination", "amount", F.round(F.try_divide(F.col("amount") * 100, "whole"), 6).alias("share"))


def internal_split(flows: DataFrame) -> DataFrame:
    """Amount and flows inside one nation and between two."""
    inside = F.col("origin") == F.col("destination")
    return flows.groupBy(inside.alias("internal")).agg(total("amount"), F.count("*").alias("n_flows"))


def top_contributors(flows: DataFrame) -> DataFrame:
    """The brand with the largest amount of each pair; ties by name."""
    sums = flows.groupBy("origin", "destination", "brand").agg(total("amount"))
    w = Window.partitionBy("origin", "destination").orderBy(F.desc("amount"), "brand")
    return sums.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def summary(flows: DataFrame, shown: int | None = None) -> DataFrame:
    """One row: amount, flows, mean amount, places, and what stays inside a place; all from the sums of pairs.

    `shown` adds how many of the largest pairs are shown and what they amount to.
    """
    sums = flows.groupBy("origin", "destination").agg(F.sum("amount").alias("amount"), F.count("*").alias("n_flows"))
    inside = F.col("origin") == F.col("destination")
    if shown is not None:
        largest = sums.orderBy(F.desc_nulls_last("amount"), "origin", "destination").limit(shown).agg(F.count("*").alias("n_shown"), total("shown_amount"))
    end = lambda place, counts: F.struct(F.col(place).alias("place"), *(F.when(F.lit(counts), c).alias(n) for n, c in (("amount", F.col("amount")), ("n", F.col("n_flows")), ("own", F.when(inside, F.col("amount"))), ("n_own", F.when(inside, F.col("n_flows"))))))
    ends = sums.select(F.explode(F.array(end("origin", True), end("destination", False))).alias("e")).select("e.*")
    by_place = ends.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("amount", "n", "own", "n_own")))
    none = F.lit(0).cast("long")
    out = by_place.agg(total("amount"), F.coalesce(F.sum("n"), none).alias("n_flows"), F.sum("own").cast("double").alias("internal_amount"), F.coalesce(F.sum("n_own"), none).alias("n_internal"), F.count("*").alias("n_places"))
    out = out.withColumn("mean_amount", F.round(F.try_divide("amount", "n_flows"), 6))
    return out if shown is None else out.crossJoin(F.broadcast(largest))  # of one row each
