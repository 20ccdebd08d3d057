"""Ordered operators that stay distributed when one group is huge.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends a whole group to one
task. When a single run may hold a third of all rows that task is the job.
``prefix_within`` computes the same row numbers and running sums with a range
shuffle instead:

1. range-partition on ``(g, o)`` so a hot group spans many partitions, and
   pin that assignment in a stored table (in the cluster's
   ``spark.checkpoint.dir``) so both uses below see identical partitions;
2. number rows locally from a monotonically increasing id taken after
   ``sortWithinPartitions`` (no extra shuffle), and, only when running sums
   are requested, sum per ``(partition, g)`` with a window bounded by the
   partition size;
3. aggregate per ``(partition, g)`` into a small table (at most
   partitions + groups rows), prefix-sum it over partitions per group, and
   join the offsets back. Groups are compared null-safely, so rows of a NULL
   group keep their place.

``order`` should tell most rows of a group apart: rows equal in group and
order share a range partition. ``exact_percentiles`` therefore counts each
distinct value first and numbers the distinct values only, so a value that a
third of all rows repeat is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acurail.session import stored


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def prefix_within(df: DataFrame, group: Sequence[str], order: Sequence[str],
                  sums: Sequence[str] = (), num_partitions: int | None = None,
                  seq_col: str = "seq") -> DataFrame:
    """Add ``seq_col`` (1-based row number in group order) and ``running_<s>`` sums.

    Without ``num_partitions`` adaptive execution sizes the range partitions.
    """
    group, order = list(group), list(order)
    keys = [F.col(c) for c in (*group, *order)]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    # Sorted range partitions; the monotonically increasing id then counts rows
    # in sorted order within each partition, so a group's rows in a partition
    # carry consecutive ids. The stored table pins partitions and ids.
    ranged = stored(ranged.sortWithinPartitions(*group, *order).withColumns(
        {"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}), "ordered")

    parts = ranged.groupBy("_pid", *group).agg(
        F.count(F.lit(1)).alias("_pcnt"), F.min("_mid").alias("_pmin"),
        *[F.sum(s).alias(f"_psum_{s}") for s in sums])
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    own = [f"_o{i}" for i in range(len(group))]
    offsets = parts.select(
        F.col("_pid").alias("_opid"), *[F.col(c).alias(o) for c, o in zip(group, own)], "_pmin",
        F.coalesce(F.sum("_pcnt").over(before), F.lit(0)).alias("_ocnt"),
        *[F.coalesce(F.sum(f"_psum_{s}").over(before), F.lit(0)).alias(f"_osum_{s}") for s in sums])

    local = ranged
    if sums:
        # Running sums need an ordered scan per (partition, group): bounded by partition size.
        run_w = Window.partitionBy("_pid", *group).orderBy("_mid").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        local = ranged.withColumns({f"_lsum_{s}": F.sum(s).over(run_w) for s in sums})
    out = local.join(offsets, (F.col("_pid") == F.col("_opid")) & _same(group, own), "inner")
    out = out.withColumns({
        seq_col: (F.col("_mid") - F.col("_pmin") + 1 + F.col("_ocnt")).cast("long"),
        **{f"running_{s}": F.col(f"_lsum_{s}") + F.col(f"_osum_{s}") for s in sums},
    })
    internal = ["_pid", "_opid", *own, "_mid", "_pmin", "_ocnt"] + [f"_lsum_{s}" for s in sums] + [
        f"_osum_{s}" for s in sums]
    return out.drop(*internal)


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, quantiles: Sequence[float],
                      num_partitions: int | None = None, count: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, NULLs ignored.

    With ``count`` a row stands for that many rows of its value.

    Returns one row per group with columns ``q<NN>`` (e.g. ``q50``, ``q95``).
    Rows are first counted per (group, value), which combines map-side, and
    running counts over the distinct values then tell which value has a rank.
    """
    group = list(group)
    own = [f"_g{i}" for i in range(len(group))]
    counts = (df.select(*[F.col(c).alias(o) for c, o in zip(group, own)], F.col(value).cast("double").alias("_v"),
                        (F.col(count) if count else F.lit(1)).cast("bigint").alias("_n1"))
              .filter(F.col("_v").isNotNull()).groupBy(*own, "_v").agg(F.sum("_n1").alias("_c")))
    run = prefix_within(counts, own, ["_v"], sums=["_c"], num_partitions=num_partitions, seq_col="_seq")
    tot = [f"_t{i}" for i in range(len(group))]
    totals = run.groupBy(*[F.col(o).alias(t) for o, t in zip(own, tot)]).agg(F.max("running__c").alias("_n"))
    ranked = run.join(totals, _same(own, tot))
    # Rank r (1-based) belongs to the value whose running count is the first to reach it.
    first, last = F.col("running__c") - F.col("_c") + 1, F.col("running__c")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("_v")))

    aggs = {}
    for i, q in enumerate(quantiles):
        low = F.floor((F.col("_n") - 1) * F.lit(float(q))) + 1
        aggs |= {f"_lo{i}": at(low), f"_hi{i}": at(low + 1)}
    picked = ranked.groupBy(*own, "_n").agg(*[c.alias(k) for k, c in aggs.items()])
    out = []
    for i, q in enumerate(quantiles):
        place = (F.col("_n") - 1) * F.lit(float(q))
        frac = place - F.floor(place)
        out.append(F.when(F.col(f"_hi{i}").isNull() | (frac == 0), F.col(f"_lo{i}")).otherwise(
            F.col(f"_lo{i}") + frac * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{int(round(q * 100)):02d}"))
    return picked.select(*[F.col(o).alias(c) for c, o in zip(group, own)], *out)
