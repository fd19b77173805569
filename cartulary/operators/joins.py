"""Joins by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the intervals that hold them: low <= value < high.

    Both sides go to steps of a `width` and join on them: a point to its own step,
    an interval to each that it touches, so a pair meets once and no side is broadcast
    or multiplied out.  A width near that of the intervals is best.  Nulls and empty
    intervals meet nothing.
    """
    step = lambda c: F.floor(F.col(c) / width)
    there = intervals.filter(F.col(low) < F.col(high)).withColumn("__step", F.explode(F.sequence(step(low), step(high))))
    met = points.withColumn("__step", step(value)).join(there, "__step")
    return met.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__step")
