import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import text
from cartulary.operators import flows, joins, stats
from cartulary.sources import tables
from cartulary.streaming import events


@pytest.mark.parametrize("n", [1, 2, 5, 6, 10, 23])
def test_class_breaks(spark, n):
    values = random.Random(n).sample(range(1000), n)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    s = sorted(values)
    floor_rule = tuple(s[min(n - 1, math.floor(n * k / 5))] for k in range(1, 5))
    rank_rule = tuple(s[int(p * (n - 1))] for p in (0.2, 0.4, 0.6, 0.8))
    assert tuple(stats.class_breaks(df, "v", "floor").first()) == floor_rule
    assert tuple(stats.class_breaks(df, "v", "rank").first()) == rank_rule
    got = {r.v: r.quintile for r in stats.classed(df, "v", "floor").collect()}
    assert got == {v: next((k + 1 for k, b in enumerate(floor_rule) if v < b), 5) for v in values}


def test_ranked_has_no_gaps_and_nulls_last(spark):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else k % 7) for k in range(200)], "k long, v long")
    got = sorted((r["rank"], r.v, r.k) for r in stats.ranked(df, "v", "k").collect())
    want = sorted(((v is None, -(v or 0), k, v) for k, v in ((r.k, r.v) for r in df.collect())))
    assert [(g[1], g[2]) for g in got] == [(w[3], w[2]) for w in want] and [g[0] for g in got] == list(range(1, 201))


def test_ranked_with_further_columns(spark):
    n = 400_000
    df = spark.range(n, numPartitions=6).select("id", (F.hash("id") % 1000).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("label"))
    w = Window.orderBy(F.desc_nulls_last("v"), "id")
    both = stats.ranked(df, "v", "id").join(df.select("id", F.col("label").alias("own"), F.row_number().over(w).alias("want")), "id")
    assert both.count() == n and both.filter("rank <> want or label <> own").count() == 0


def test_as_of_with_a_hot_key(spark):
    rows = spark.range(40_000, numPartitions=5)
    key = F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).cast("int").alias("k")
    left = rows.select("id", key, (F.hash("id") % 9000).alias("t"))
    right = rows.filter("id % 4 = 0").select(key, (F.hash(F.col("id") + 1) % 9000).alias("t"), F.col("id").alias("v")).groupBy("k", "t").agg(F.max("v").alias("v"))
    got = {r.id: r.v for r in stats.as_of(left, right, "k", "t", ["v"]).collect()}
    a, b = left.toPandas().sort_values("t"), right.toPandas().sort_values("t")
    want = pd.merge_asof(a, b, on="t", by="k")
    assert len(got) == 40_000 and got == {int(i): None if pd.isna(v) else int(v) for i, v in zip(want["id"], want["v"], strict=True)}


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("c", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    got = {(r.k, r.t): r.v for r in stats.as_of(left, right, "k", "t", ["v"]).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None, ("c", 3): None}


def test_interval_join(spark):
    rng = random.Random(4)
    points = [(k, rng.uniform(-20, 20) if k % 9 else None) for k in range(200)] + [(900, 3.0), (901, 5.0)]
    ranges = [(k, a, a + rng.choice([-1.0, 0.0, 0.5, 7.0])) for k, a in enumerate(rng.uniform(-20, 20) for _ in range(60))] + [(99, 3.0, 5.0), (98, None, 1.0)]
    got = joins.interval_join(spark.createDataFrame(points, "p long, v double"), spark.createDataFrame(ranges, "r long, a double, b double"), "v", "a", "b", 2.0)
    want = sorted((p, r) for p, v in points for r, a, b in ranges if v is not None and a is not None and a <= v < b)
    assert sorted((x.p, x.r) for x in got.collect()) == want and (900, 99) in want and (901, 99) not in want


def test_flow_steps_take_their_upper_bound(spark):
    df = spark.createDataFrame([(1e6,), (1e6 + 1,), (1e9,), (1e9 + 1,), (-5.0,)], "a double")
    assert [r[0] for r in df.select(stats.stepped(F.col("a"), stats.FLOW_STEPS, stats.FLOW_LAST)).collect()] == ["<=1M", "1-10M", "100M-1B", ">1B", "<=1M"]


def test_flow_summary_without_rows(spark):
    df = spark.createDataFrame([], "origin string, destination string, year int, brand string, amount decimal(18,2)")
    r = flows.summary(df).first()
    assert (r.amount, r.n_flows, r.n_places, r.mean_amount) == (None, 0, 0, None)


def test_flow_summary_with_the_flows_shown(spark):
    df = spark.createDataFrame([("a", "b", 5), ("a", "a", 3), ("c", "a", 1), ("a", "b", 2)], "origin string, destination string, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    r = flows.summary(df, shown=2).first()
    assert (r.amount, r.n_flows, r.internal_amount, r.n_internal, r.n_places, r.n_shown, r.shown_amount) == (11.0, 4, 3.0, 1, 3, 2, 10.0)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.normalized(F.lit("  St. Mary's -- County! "))) == "st mary s county"
    assert set(one(text.content_words(F.lit("The Department of Health and Human Services")))) == {"health", "human", "services"}
    assert [one(text.district(F.lit(x))) for x in ("md-5", "MD05", "VA-11", "nowhere", "MD-123")] == ["MD-05", "MD-05", "VA-11", None, None]
    assert one(text.county(F.lit("Prince George's County"))) == "prince georges"
    assert [one(text.number_of(F.lit(x))) for x in ("1,234", "-2.5", "x")] == [1234.0, -2.5, None]
    assert one(text.numbers_in(F.lit("from -1,200 to 3.5 and 7"))) == [-1200.0, 3.5, 7.0]
    assert one(text.mentions(F.lit("West Virginia!"), F.lit("virginia"))) and not one(text.mentions(F.lit("virginian"), F.lit("virginia")))
    assert "veterans affairs" in one(text.expanded(F.lit("grants of the VA"))) and "energy" not in one(text.expanded(F.lit("does it")))
    assert one(text.close(F.lit(100.4), F.lit(100.0), 0.005)) and not one(text.close(F.lit(101.0), F.lit(100.0), 0.005))
    assert [one(text.shown(F.lit(m), F.lit(v))) for m, v in (("Grants", 2.5e9), ("Grants", -1.25e6), ("Grants", 1234.4), ("Below poverty", 12.34), ("literacy", 0.5), ("population", 1234567.0), ("x", 3.14159))] == ["$2.50B", "-$1.25M", "$1,234", "12.3%", "50.0%", "1,234,567", "3.14"]
    assert one(text.padded(F.lit(7), 5)) == "00007" and one(text.lookup(F.lit("md"), {"md": "maryland"})) == "maryland"
    assert one(text.sequence_ratio(F.lit("maryland"), F.lit("marylnd"))) == pytest.approx(14 / 15)


def test_irregular_names_survive(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, None)], ["Bonds,_Loans_&_Notes", "Income >$50K"])
    rows = tables.fetch(df)
    assert tables.fetch_or(df.limit(0), rows) == rows and tables.fetch_or(df, []) == rows
    assert rows == [{"Bonds,_Loans_&_Notes": 1, "Income >$50K": None}, {"Bonds,_Loans_&_Notes": 2, "Income >$50K": None}]


def test_sinks_and_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "broken"), (3, None)], "id int, p string")
    got = {r.id: r.x for r in df.select("id", tables.payload("p", "a int").a.alias("x")).collect()}
    assert got == {1: 1, 2: None, 3: None}
    for _ in range(2):
        tables.append_json_lines(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    assert tables.stamped(df).select("at").distinct().count() == 1
    for kind in ("parquet", "orc", "csv", "json"):
        tables.export(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 3
    with pytest.raises(ValueError):
        tables.export(df, str(tmp_path / "x"), "xlsx")


def test_features_and_extent(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}]}))
    r = tables.features(spark, str(tmp_path / "f.json")).first()
    assert r.properties == {"name": "A"} and json.loads(r.coordinates) == [1.5, 2]
    box = tables.extent(spark.createDataFrame([(1.0, 5.0), (3.0, -1.0)], "lon double, lat double"), "lon", "lat").first()
    assert tuple(box) == (1.0, -1.0, 3.0, 5.0)


def test_scan_checks_its_columns(spark, tmp_path):
    spark.range(1).withColumnRenamed("id", "r_regionkey").write.parquet(str(tmp_path / "region.parquet"))
    with pytest.raises(ValueError, match="r_name"):
        tables.scan(spark, str(tmp_path), "region")


def streamed(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streams_give_what_a_batch_gives(spark, small, tmp_path):
    rows = small("events")
    rows.union(rows.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), rows.schema)
    batch = rows.union(rows.limit(50)).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.start, r.event_type): r.n for r in streamed(spark, events.windowed(stream, late="400 days"), "windows", "complete")}
    assert got == {(r.start, r.event_type): r.n for r in events.windowed(batch).collect()}
    assert len(streamed(spark, events.once(stream, "4000 days"), "onces", "append")) == events.once(batch).count() == rows.count()
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == rows.count() + 50


def test_rounded_by_the_scaled_number(spark):
    values = (69.865, -2.195, 0.125, -0.125, 1.005, 1.7e308, float("inf"), None)
    df = spark.createDataFrame([(v,) for v in values], "v double").select(text.rounded("v", 2).alias("x"))
    assert [r.x for r in df.collect()] == [69.86, -2.19, 0.13, -0.13, 1.0, 1.7e308, float("inf"), None]
