"""Results on the features of a map: rows with a key on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order; keys that are null drop out."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def highlighted(features: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Features that a row has the key of, with the row's columns."""
    return features.join(rows, key)


def backdrop(features: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All features, with `matched` and the columns of rows where there are any."""
    return features.join(rows.withColumn("__hit", F.lit(True)), key, "left").withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__hit")


def within(features: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Features that a row has the key of, as they are."""
    return features.join(rows.select(key), key, "left_semi")


def spending_total(contracts: str = "Contracts", grants: str = "Grants", wages: str = "Resident Wage") -> Column:
    """Money that adds up; payments to persons and counts of persons don't belong to it."""
    part = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0))
    return part(contracts) + part(grants) + part(wages)


def with_complement(df: DataFrame, column: str, whole: str, part: str) -> DataFrame:
    """df with `column`; where it lacks it, what is left of `whole` after `part`."""
    return df if column in df.columns else df.withColumn(column, F.col(f"`{whole}`") - F.col(f"`{part}`"))
