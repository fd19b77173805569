"""The semantic catalog: which tables there are, what their columns mean, how they join.

A metric states its expression, unit and default aggregation; a table states its
periods and the one that holds if a question names none.  Everything that builds
queries reads this, so a unit can't be mixed or a period counted twice silently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import marts


@dataclass(frozen=True)
class Metric:
    name: str
    unit: str  # dollars, count, share or ratio
    aggregation: str  # sum or avg
    label: str = ""
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    family: str
    build: Callable[[SparkSession, str, str | None], DataFrame]  # of one period, or of all
    dimensions: tuple[str, ...]
    metrics: tuple[Metric, ...]
    grain: str
    period: str | None = None
    default_period: str | None = None
    synonyms: tuple[str, ...] = ()

    def metric(self, name: str) -> Metric:
        found = [m for m in self.metrics if m.name == name]
        if not found:
            raise KeyError(f"{self.name} has no metric {name}")
        return found[0]

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.dimensions, *((self.period,) if self.period else ()), *(m.name for m in self.metrics))


_REVENUE = Metric("revenue", "dollars", "sum", "Revenue", ("sales", "spending"))


def _accounts(spark: SparkSession, sf_dir: str, period: str | None = None) -> DataFrame:
    rows = marts.accounts(spark, sf_dir)
    ratio = F.round(F.try_divide(F.col("debits"), F.col("credits")), 6)
    return rows.withColumn("debit_ratio", ratio).withColumn("balance_per_customer", F.round(F.try_divide(F.col("balance"), F.col("customers")), 6))


def _flows(spark: SparkSession, sf_dir: str, period: str | None = None) -> DataFrame:
    return marts.flows(spark, sf_dir, marts.years_of_period(period))


#: Dimensions that name places, and the level of each on a map.
PLACES = {"nation": "nation", "region": "region", "origin": "nation", "destination": "nation"}

TABLES = {
    t.name: t
    for t in (
        Table("spending_nation", "spending", marts.spending, ("nation", "region"), (_REVENUE, Metric("quantity", "count", "sum", "Quantity"), Metric("items", "count", "sum", "Line items", ("lines",))), "nation", "period", "2000", ("revenue", "sales")),
        Table("spending_nation_brand", "spending", marts.spending_by_brand, ("nation", "brand"), (_REVENUE,), "nation by brand", "period", "2000", ("brand", "brands")),
        Table("accounts_nation", "accounts", _accounts, ("nation", "region"), (Metric("customers", "count", "sum", "Customers"), Metric("credits", "dollars", "sum", "Credits"), Metric("debits", "dollars", "sum", "Debits"), Metric("balance", "dollars", "sum", "Balance"), Metric("debit_ratio", "ratio", "avg", "Debit ratio", ("debt",)), Metric("balance_per_customer", "dollars", "avg", "Balance per customer", ("per capita",))), "nation", synonyms=("account", "balance")),
        Table("flow_nation", "flow", _flows, ("origin", "destination", "brand"), (Metric("amount", "dollars", "sum", "Amount"),), "line item", "year", None, ("flow", "flows", "inflow", "outflow")),
    )
}

#: Keys that two tables may be joined by, as (left column, right column); nothing else may be.
JOINS = {("spending_nation", "accounts_nation"): ("nation", "nation"), ("spending_nation_brand", "spending_nation"): ("nation", "nation"), ("spending_nation_brand", "accounts_nation"): ("nation", "nation"), ("flow_nation", "accounts_nation"): ("destination", "nation")}


def join_key(left: str, right: str) -> tuple[str, str]:
    if (left, right) in JOINS:
        return JOINS[left, right]
    if (right, left) in JOINS:
        return JOINS[right, left][::-1]
    raise ValueError(f"{left} and {right} have no common key")


def load(spark: SparkSession, sf_dir: str, name: str, period: str | None = None) -> DataFrame:
    """A table with what its columns mean as metadata, and its text dimensions in one case as *_norm.

    With a `period` only what that period can hold is read; callers still filter by it.
    """
    t = TABLES[name]
    df = t.build(spark, sf_dir, period)
    about: dict[str, dict] = {d: {"role": "dimension"} for d in t.dimensions} | {m.name: {"role": "metric", "unit": m.unit, "agg": m.aggregation} for m in t.metrics}
    if t.period:
        about[t.period] = {"role": "period", "default": t.default_period or ""}
    columns: list[Column] = [F.col(c).alias(c, metadata=about.get(c, {})) for c in df.columns]
    return df.select(*columns, *(F.upper(F.trim(d)).alias(f"{d}_norm") for d in t.dimensions))


def listing(spark: SparkSession) -> DataFrame:
    """One row for each table: family, name, grain, number of columns, default period."""
    rows = [(t.family, t.name, t.grain, len(t.columns), t.default_period) for t in TABLES.values()]
    return spark.createDataFrame(rows, "family string, name string, grain string, n_columns int, default_period string")


def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, n_rows of every table, and of all together (name null)."""
    counts = [load(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in TABLES]
    return reduce(DataFrame.unionByName, counts).rollup("name").agg(F.sum("n_rows").alias("n_rows"))


@dataclass(frozen=True)
class Audit:
    missing: dict[str, list[str]] = field(default_factory=dict)  # stated, not there
    unstated: dict[str, list[str]] = field(default_factory=dict)  # there, not stated
    without_synonyms: list[str] = field(default_factory=list)
    coverage: float = 1.0


def audit(frames: dict[str, DataFrame]) -> Audit:
    """The catalog against the columns that tables really have."""
    missing, unstated, stated, there = {}, {}, 0, 0
    for name, df in frames.items():
        own, wanted = set(df.columns), set(TABLES[name].columns)
        real = {c for c in own if not c.endswith("_norm")}
        if gone := sorted(wanted - own):
            missing[name] = gone
        if more := sorted(real - wanted):
            unstated[name] = more
        stated, there = stated + len(real & wanted), there + len(real)
    bare = [f"{n}.{m.name}" for n in frames for m in TABLES[n].metrics if not m.synonyms]
    return Audit(missing, unstated, bare, round(stated / there, 4) if there else 1.0)
