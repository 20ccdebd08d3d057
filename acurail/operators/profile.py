"""Distribution profiles.

Profiles aggregate wide first (one pass, map-side partial aggregation, one
row per stratum) and unpivot the tiny result afterwards, instead of
exploding every input row into (column, value) pairs before the shuffle.
The only long-form aggregate is the categorical frequency table, whose
group count is bounded by the number of distinct categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from acurail.constants import TARGET
from acurail.functions.columns import py_round

STRATA = [1, 2, 3, 4, 5]


def class_distribution(df: DataFrame, col: str = TARGET, kind: str | None = None) -> DataFrame:
    """Count and percent per class (total via a window over the tiny result)."""
    counts = df.groupBy(F.col(col).cast("int").alias("acuity")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    out = counts.withColumn("pct", 100.0 * F.col("n") / total)
    return out.withColumn("kind", F.lit(kind)) if kind else out


def _unpivot_wide(wide: DataFrame, keys: list[str], cols: list[str], stats: list[str]) -> DataFrame:
    """Turn ``{col}__{stat}`` columns of a small aggregate into long rows."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols])
    return wide.select(*keys, F.inline(entries))


def stratum_stats(df: DataFrame, cols: list[str], stratum: str = TARGET) -> DataFrame:
    """Per-stratum mean and sample std of each column (long form)."""
    present = [c for c in cols if c in df.columns]
    aggs = []
    for c in present:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std")]
    wide = df.groupBy(F.col(stratum).cast("int").alias("acuity")).agg(*aggs)
    return _unpivot_wide(wide, ["acuity"], present, ["mean", "std"])


def stratum_stats_json(df: DataFrame, cols: list[str], stratum: str = TARGET,
                       decimals: int | None = None) -> DataFrame:
    """The nested ``{stratum: {column: {mean, std}}}`` document as one JSON row per stratum, columns by name."""
    long = stratum_stats(df, cols, stratum)
    if decimals is not None:
        long = long.withColumns({c: py_round(F.col(c), decimals) for c in ("mean", "std")})
    per = long.groupBy("acuity").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("column", F.struct("mean", "std"))))).alias("stats"))
    return per.select(F.col("acuity").cast("string").alias("acuity"), F.to_json("stats").alias("stats_json"))


def numeric_profile(spark: SparkSession, df: DataFrame, cols: list[str], stratum: str = TARGET) -> DataFrame:
    """Per stratum and column: n, mean, std (0 or undefined -> 0.01), min, max.

    A stratum with no rows at all falls back to whole-table statistics.
    """
    present = [c for c in cols if c in df.columns]

    def aggs():
        out = [F.count(F.lit(1)).alias("__rows")]
        for c in present:
            x = F.col(c).cast("double")
            out += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                    F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                    F.max(x).alias(f"{c}__max")]
        return out

    per = df.groupBy(F.col(stratum).cast("int").alias("acuity")).agg(*aggs())
    # Whole-table statistics: one bounded row, inlined as literals for the fallback.
    whole = df.agg(*aggs()).first().asDict()
    spine = spark.createDataFrame([(s,) for s in STRATA], "acuity int")
    joined = spine.join(per, "acuity", "left").withColumns(
        {f"all_{k}": F.lit(v) for k, v in whole.items()})
    use_all = F.coalesce(F.col("__rows"), F.lit(0)) == 0
    stats = ["n", "mean", "std", "min", "max"]
    picked = joined.select("acuity", F.when(use_all, "all").otherwise("stratum").alias("source"), *[
        F.when(use_all, F.col(f"all_{c}__{s}")).otherwise(F.col(f"{c}__{s}")).alias(f"{c}__{s}")
        for c in present for s in stats])
    long = _unpivot_wide(picked, ["acuity", "source"], present, stats)
    return long.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(0.01))) \
               .withColumn("n", F.col("n").cast("long"))


def categorical_profile(df: DataFrame, cols: list[str], stratum: str = TARGET) -> DataFrame:
    """Per stratum relative frequency of each non-null category."""
    present = [c for c in cols if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in present])
    long = df.select(F.col(stratum).cast("int").alias("acuity"), F.inline(pairs)).filter(F.col("value").isNotNull())
    counts = long.groupBy("acuity", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("acuity", "column"))
    return counts.withColumn("freq", F.col("n") / total)


def binary_profile(df: DataFrame, cols: list[str], stratum: str = TARGET) -> DataFrame:
    """E5: per stratum mean of each binary column over non-null values."""
    present = [c for c in cols if c in df.columns]
    wide = df.groupBy(F.col(stratum).cast("int").alias("acuity")).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}__rate") for c in present])
    return _unpivot_wide(wide, ["acuity"], present, ["rate"])


def column_profile(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Distinct values (with counts) of each categorical column, long form."""
    present = [c for c in categorical if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in present])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_list(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """(column, position, type, nulls, head) of every column; ``head`` is the JSON of its first ``rows`` values
    by ``key``, as text. Null counts are one aggregate, the head a bounded top-k."""
    fields = [f for f in df.schema.fields]
    nulls = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    order = F.col(key).alias("k")
    top = df.select(order, *[F.col(f.name).cast("string").alias(f"v{i}") for i, f in enumerate(fields)]).orderBy("k").limit(rows)

    def first(name: str):
        return F.transform(F.array_sort(F.collect_list(F.struct("k", name))),
                           lambda s: F.coalesce(s[name], F.lit("null")))

    head = top.agg(*[first(f"v{i}").alias(f"h{i}") for i in range(len(fields))])  # at most ``rows`` values
    out = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("position"),
                             F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("nulls"),
                             F.to_json(f"h{i}").alias("head")) for i, f in enumerate(fields)])
    return nulls.crossJoin(head).select(F.inline(out))  # one row each
