"""Typed questions that compile to DataFrame plans.

A contract names an operation, a table, metrics and slots.  Slots that a
follow-up leaves open come from the question before.  Text comes in as literals,
never as SQL; filters are on the *_norm columns, which stay in one case.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flows, stats
from .catalog import TABLES, join_key, listing, load

OPERATIONS = ("lookup", "ranking", "compare", "trend", "cross_metric", "breakout", "summary", "values", "flow_pair_total", "flow_share", "metadata_answer")
#: Rows that "values" gives unless a limit or page asks for others: a bound for callers outside Spark.
VALUES_ROWS = 5000


@dataclass(frozen=True)
class Contract:
    operation: str | None = None
    table: str | None = None
    metric: str | None = None
    entity: str | None = None  # the dimension that rows are about
    names: tuple[str, ...] | None = None  # of the entity
    prefix: str | None = None
    where: tuple[tuple[str, str], ...] | None = None  # further dimensions
    period: str | None = None
    other_table: str | None = None
    other_metric: str | None = None
    limit: int | None = None
    offset: int | None = None  # rows that pages before have shown
    largest: bool | None = None
    carry: tuple[str, ...] | None = None  # further dimensions that "values" shows

    def merge(self, before: Contract) -> Contract:
        """This contract, with what it leaves open taken from the one before."""
        return replace(self, **{f.name: getattr(before, f.name) for f in fields(self) if getattr(self, f.name) is None})


def periods(table: str, contract: Contract) -> Column | None:
    """The one period that rows are of: what is asked for, else the table's default.

    Periods are compared as text: a year and a range of years are two labels.  A
    table without a default isn't filtered unless a period is asked for.
    """
    t = TABLES[table]
    if t.period is None:
        return None
    wanted = contract.period or t.default_period
    return None if wanted is None else F.col(t.period).cast("string") == wanted


def rows_of(spark: SparkSession, sf_dir: str, table: str, contract: Contract, by_period: bool = True) -> DataFrame:
    entity = contract.entity or TABLES[table].dimensions[0]
    tests: list[Column] = []
    if contract.names:
        tests.append(F.col(f"{entity}_norm").isin([n.strip().upper() for n in contract.names]))
    if contract.prefix:
        tests.append(F.startswith(F.col(f"{entity}_norm"), F.lit(contract.prefix.upper())))
    for dimension, value in contract.where or ():
        if dimension not in TABLES[table].dimensions:
            raise KeyError(f"{table} has no dimension {dimension}")
        tests.append(F.col(f"{dimension}_norm") == value.strip().upper())
    if by_period and (p := periods(table, contract)) is not None:
        tests.append(p)
    df = load(spark, sf_dir, table, (contract.period or TABLES[table].default_period) if by_period else None)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def compiled(spark: SparkSession, sf_dir: str, contract: Contract) -> DataFrame:
    """The plan of a contract; rows have label and value, and what the operation adds."""
    c = contract
    if c.operation not in OPERATIONS:
        raise ValueError(f"no such operation: {c.operation}")
    if c.operation == "metadata_answer":
        return listing(spark)
    if c.table not in TABLES:
        raise KeyError(f"no such table: {c.table}")
    t = TABLES[c.table]
    metric = t.metric(c.metric or t.metrics[0].name)
    entity = c.entity or t.dimensions[0]
    if entity not in t.dimensions:
        raise KeyError(f"{c.table} has no dimension {entity}")
    total = (F.sum(F.col(metric.name).cast("decimal(28,2)")).cast("double") if metric.aggregation == "sum" else F.round(F.avg(metric.name), 6)).alias("value")
    label = F.col(entity).alias("label")

    if c.operation == "trend":
        if t.period is None:
            raise ValueError(f"{c.table} has no periods")
        rows = rows_of(spark, sf_dir, c.table, c, by_period=False).filter(F.length(F.col(t.period).cast("string")) == 4)  # years, not ranges
        return rows.groupBy(F.col(t.period).cast("string").alias("label")).agg(F.round(F.avg(metric.name), 6).alias("value")).orderBy("label")
    if c.operation == "cross_metric":
        left, right = join_key(c.table, c.other_table)
        other = TABLES[c.other_table].metric(c.other_metric)
        a = rows_of(spark, sf_dir, c.table, c).select(label, F.col(f"{left}_norm").alias("key"), F.col(metric.name).alias("value"))
        b = rows_of(spark, sf_dir, c.other_table, Contract(period=c.period)).select(F.col(f"{right}_norm").alias("key"), F.col(other.name).alias("other_value"))
        return a.join(b, "key").select("label", "value", "other_value")
    if c.operation.startswith("flow_") and not {"origin", "destination"} <= set(t.dimensions):
        raise ValueError(f"{c.table} has no flows")
    rows = rows_of(spark, sf_dir, c.table, c)
    if c.operation == "summary":
        return stats.summary(rows, metric.name)
    if c.operation == "values":
        if unknown := set(c.carry or ()) - set(t.dimensions):
            raise KeyError(f"{c.table} has no dimensions {sorted(unknown)}")
        rows = rows.select(label, F.col(metric.name).alias("value"), *(c.carry or ())).orderBy("label", *(c.carry or ()), "value")
        return rows.offset(c.offset or 0).limit(c.limit or VALUES_ROWS)
    if c.operation == "flow_pair_total":
        return flows.pairs(rows)
    if c.operation == "flow_share":
        return flows.shares(rows)
    if c.operation == "lookup":
        return rows.groupBy(label).agg(total)
    if c.operation == "compare":
        if not c.names or len(c.names) < 2:
            raise ValueError("a comparison needs two names")
        return rows.groupBy(label).agg(total).orderBy(F.desc_nulls_last("value"), "label")
    if c.operation == "breakout":
        rest = [d for d in t.dimensions if d != (c.where[0][0] if c.where else None)]
        label = F.col(c.entity or rest[-1]).alias("label")
    return stats.top(rows.groupBy(label).agg(total), "value", "label", c.limit or 10, c.largest is not False)


def composite(df: DataFrame, table: str, metrics: list[str], name: str) -> DataFrame:
    """A sum of metrics of one unit, nulls as 0.  Metrics of different units don't add up."""
    if len(units := {TABLES[table].metric(m).unit for m in metrics}) != 1:
        raise ValueError(f"metrics of different units: {sorted(units)}")
    return df.withColumn(name, reduce(lambda a, b: a + b, (F.coalesce(F.col(m), F.lit(0.0)) for m in metrics)))
