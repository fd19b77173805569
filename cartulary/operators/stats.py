"""Rankings, quantile classes, summaries and comparisons over rows of a result.

Ranks over a whole column need all its rows in order.  Where a column may be long,
``ranked`` numbers rows without a single-task window: rows are range-partitioned
and sorted once, each takes its place within its partition, and that is stored.
The stored partitions' sizes, one row each, give the offsets, so places and offsets
always come from one and the same partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import saved


def top(df: DataFrame, measure: str, key: str, k: int, largest: bool = True) -> DataFrame:
    """The k rows with the largest (or smallest) measure; nulls last, ties by key."""
    order = F.desc_nulls_last(measure) if largest else F.asc_nulls_last(measure)
    return df.orderBy(order, F.asc_nulls_last(key)).limit(k)


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df stored in order, with __part (a range of the order; ties may be split) and __place (from 1 within it)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1  # the id holds the partition's number over 33 bits of the row's
    return saved(dealt.select(*df.columns, F.shiftright("__at", 33).alias("__part"), place.alias("__place")), name)


def ranked(df: DataFrame, measure: str, key: str, name: str = "rank", largest: bool = True) -> DataFrame:
    """Every row, whatever its further columns, with its place from 1; nulls last, ties by key."""
    order = [F.desc_nulls_last(measure) if largest else F.asc_nulls_last(measure), F.asc_nulls_last(key)]
    placed = in_order(df, order, "ranked")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before")


def class_breaks(df: DataFrame, value: str, rule: str, classes: int = 5) -> DataFrame:
    """One row of breaks b1..b4, of the sorted values that aren't null.

    Rule "floor": place min(n - 1, floor(n * s / classes)).  Rule "rank":
    place floor(p * (n - 1)).  Places count from 0; nothing is interpolated.
    """
    rows = ranked(df.filter(F.col(value).isNotNull()).select(value).withColumn("__tie", F.lit(0)), value, "__tie", "__rank", largest=False)
    n = rows.agg(F.count("*").alias("__n"))
    joined = rows.crossJoin(F.broadcast(n))  # of one row
    place = {"floor": lambda s: F.least(F.col("__n") - 1, F.floor(F.col("__n") * s / classes)), "rank": lambda s: F.floor(F.lit(s) / classes * (F.col("__n") - 1))}[rule]
    return joined.agg(*(F.max(F.when(F.col("__rank") - 1 == place(s), F.col(value))).alias(f"b{s}") for s in range(1, classes)))


def classed(df: DataFrame, value: str, rule: str, name: str = "quintile", classes: int = 5) -> DataFrame:
    """Rows with the class of their value: the first break it is below, else the last class."""
    rows = saved(df.filter(F.col(value).isNotNull()), "classed")  # read again for the breaks
    breaks = class_breaks(rows, value, rule, classes)
    steps = reduce(lambda rest, s: F.when(F.col(value) < F.col(f"b{s}"), s).otherwise(rest), reversed(range(1, classes)), F.lit(classes))
    return rows.crossJoin(F.broadcast(breaks)).withColumn(name, steps.cast("long")).drop(*(f"b{s}" for s in range(1, classes)))


def summary(df: DataFrame, value: str) -> DataFrame:
    """count, min, max, unweighted mean and median of the values that aren't null."""
    return df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"))


def approximate_summary(df: DataFrame, value: str, key: str, error: float = 0.02) -> DataFrame:
    """One row: about how many different keys, and about the quartiles of the values, in bounded memory.

    `error` is the relative error of the count (one standard deviation) and of the quartiles' ranks.
    """
    quartiles = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(round(1 / error)))
    return df.agg(F.approx_count_distinct(key, error).alias("keys"), quartiles.alias("q")).select("keys", *(F.col("q")[k].alias(f"q{k + 1}") for k in range(3)))


def against_all(df: DataFrame, value: str, is_entity: Column) -> DataFrame:
    """The entity's rows with the mean and median over all rows."""
    whole = df.agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"))
    return df.filter(is_entity).crossJoin(F.broadcast(whole))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of `bins` equal steps from low to high; what lies outside counts in bins 0 and bins + 1."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def stepped(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that value isn't over."""
    return reduce(lambda rest, s: F.when(value <= s[0], s[1]).otherwise(rest), reversed(steps), F.lit(last))


# Classes of flow amounts, upper bounds included.
FLOW_STEPS = [(1e6, "<=1M"), (1e7, "1-10M"), (1e8, "10-100M"), (1e9, "100M-1B")]
FLOW_LAST = ">1B"


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the key's last right row at or before its time.

    Both sides are put in one order of key and time over ranges of about equal
    size, so a key with many rows takes as many ranges as it needs.  Within a range
    the last right values are carried on; a range that begins within a key takes
    what the ranges before it end with, one row for each key and range.  Rows with a
    null key or time find nothing.
    """
    a = left.withColumn("__left", F.lit(1))
    b = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, F.struct(*values).alias("__right")).withColumn("__left", F.lit(0))
    rows = in_order(a.unionByName(b, allowMissingColumns=True), [F.asc(key), F.asc(time), F.asc("__left")], "as_of")
    own = Window.partitionBy(key, "__part")
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(key, "__part").agg(F.max_by("__right", F.when(F.col("__left") == 0, F.col("__place"))).alias("__end"))
    carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).select(F.col(key).alias("__key"), F.col("__part").alias("__in"), "__carried")
    within = rows.withColumn("__last", F.last("__right", ignorenulls=True).over(own.orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = within.filter("__left = 1").join(carried, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__in")), "left")
    last = F.when(F.col(time).isNotNull(), F.coalesce("__last", "__carried"))
    return found.withColumn("__found", last).select(*left.columns, *(F.col(f"__found.{v}").alias(v) for v in values))
