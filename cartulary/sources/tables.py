"""Sources and sinks: Parquet scans, views, JSON lines, payloads, features, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is there to scan, with the columns a scan must find.
MANIFEST: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
}
VIEW_PREFIX = "mart_"


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the manifest; fails at once if a column is missing."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if missing := [c for c in MANIFEST.get(name, ()) if c not in df.columns]:
        raise ValueError(f"{name} lacks columns {missing}")
    return df


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(MANIFEST)) -> list[str]:
    """Temporary views mart_<name> over the scans; doing it again changes nothing."""
    for name in names:
        scan(spark, sf_dir, name).createOrReplaceTempView(VIEW_PREFIX + name)
    return list_views(spark)


def list_views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(VIEW_PREFIX))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of floating columns as null, so that results serialise."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*(F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, floating) else F.col(f"`{f.name}`") for f in df.schema))


def fetch(df: DataFrame, most: int = 250) -> list[dict]:
    """At most `most` rows as dictionaries, for a caller outside Spark."""
    return [r.asDict(recursive=True) for r in nan_to_null(df).limit(most).collect()]


def fetch_or(df: DataFrame, before: list[dict], most: int = 250) -> list[dict]:
    """The rows of df, or those fetched before if it has none."""
    return fetch(df, most) or before


def stamped(df: DataFrame, name: str = "at") -> DataFrame:
    """Rows with the time of the query, one for all of them."""
    return df.withColumn(name, F.current_timestamp())


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def payload(column: Column | str, schema: str) -> Column:
    """A JSON payload as a struct; one that can't be read has null fields."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def payload_text(column: Column | str) -> Column:
    return F.to_json(column)


FEATURES = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of GeoJSON collections: properties and the geometry's text."""
    rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def extent(points: DataFrame, lon: str, lat: str) -> DataFrame:
    return points.agg(F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, ORC, CSV with a header, or JSON files."""
    if kind not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"no such format: {kind}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
