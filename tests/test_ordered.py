"""Distributed ordered operators against window / numpy references on a skewed group."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from acurail.functions.ordered import exact_percentiles, prefix_within


def test_prefix_within_matches_row_number_on_hot_group(spark):
    # Group "hot" holds a third of the rows.
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", float((i * 37) % 101), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    got = prefix_within(df.withColumn("one", F.lit(1)), ["g"], ["v", "id"], sums=["one"], num_partitions=6)
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("rn", F.row_number().over(w))
    j = got.join(want, ["g", "v", "id"])
    assert j.filter((F.col("seq") != F.col("rn")) | (F.col("running_one") != F.col("rn"))).count() == 0
    assert j.count() == 3000


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(100, 20, 2001).round(3)
    rows = [("a" if i < 1500 else "b", float(v)) for i, v in enumerate(vals)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", [0.5, 0.95], num_partitions=5).collect()}
    a, b = vals[:1500], vals[1500:]
    assert abs(got["a"]["q50"] - np.percentile(a, 50)) < 1e-9
    assert abs(got["a"]["q95"] - np.percentile(a, 95)) < 1e-9
    assert abs(got["b"]["q95"] - np.percentile(b, 95)) < 1e-9


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 2.0, 3), ("a", None, 4)], "g string, v double, id int")
    seq = prefix_within(df, ["g"], ["id"], num_partitions=3)
    assert sorted((r["g"] or "", r["id"], r["seq"]) for r in seq.collect()) == [("", 1, 1), ("", 2, 2), ("a", 3, 1), ("a", 4, 2)]
    got = {r["g"]: r["q50"] for r in exact_percentiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_percentiles_of_repeated_values_stay_spread(spark):
    """A 0/1 flag in a hot group: the ordered rows are distinct values, so no partition holds the repeats."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"),
        F.when(F.col("id") % 20 == 1, 1.0).otherwise(0.0).alias("v"))
    got = {r["g"]: (r["q50"], r["q95"], r["q96"], r["q99"])
           for r in exact_percentiles(df, ["g"], "v", [0.5, 0.95, 0.96, 0.99], num_partitions=8).collect()}
    rows = df.toPandas()
    for g, part in rows.groupby("g"):
        assert got[g] == tuple(np.percentile(part["v"], [50, 95, 96, 99]))
    counted = df.groupBy("g", "v").count()
    assert counted.count() == 4  # what is range-partitioned and numbered
