"""Distributed least-significant-digit radix sort: exact global ranks without a range shuffle or a sampled splitter.

Rows carry integer key words. One pass sorts by one digit and is stable:

1. count the rows of every (chunk, digit);
2. prefix sums over digits, then over the chunks of a digit, give the global
   place at which each chunk's first row of a digit goes;
3. every chunk reads its rows in their order and hands out places.

Then places become the order of the next pass, and chunks are equal stretches
of places. However often a digit or a key occurs, chunks stay equal, so a hot
key is spread like any other. A task holds one counter a digit and one Arrow
batch. Digits in which all rows agree need no pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acurail.llm.common import staged

#: Bits of a digit, and the rows of a chunk.
DIGIT_BITS, CHUNK_ROWS = 12, 262_144
_SIGN = -(1 << 63)


def ascending(col: Column) -> Column:
    """Key word (its bits read as unsigned) that rises with a bigint."""
    return col.cast("bigint").bitwiseXOR(F.lit(_SIGN))


def descending(col: Column) -> Column:
    """Key word that falls with a bigint."""
    return F.bitwise_not(ascending(col))


def stable_ranks(digits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of a batch's rows; ``start`` holds the next place of every digit and is moved on."""
    order = np.argsort(digits, kind="stable")
    ordered = digits[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(digits) else order
    size = np.diff(np.append(first, len(digits)))
    places = np.empty(len(digits), dtype=np.int64)
    places[order] = np.repeat(start[ordered[first]], size) + np.arange(len(digits)) - np.repeat(first, size)
    start[ordered[first]] += size
    return places


def _place(radix: int):
    """Turns (chunk, is_row, place, digit, start, row), sorted by the first three, into rows with new places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.zeros(radix, dtype=np.int64)
        chunk_now = None
        for b in batches:
            chunk, is_row, digit, begin = (b.column(n).to_numpy(zero_copy_only=False) for n in
                                           ("chunk", "is_row", "digit", "start"))
            at = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else []
            places = np.zeros(len(chunk), dtype=np.int64)
            for a, e in zip(at, np.append(at[1:], len(chunk)) if len(at) else []):
                if chunk[a] != chunk_now:
                    chunk_now = chunk[a]
                    start[:] = 0
                head = a + int(np.count_nonzero(is_row[a:e] == 0))
                start[digit[a:head]] = begin[a:head]
                places[head:e] = stable_ranks(digit[head:e].astype(np.int64), start)
            rows = pa.table({"place": pa.array(places), "row": b.column("row")}).filter(pa.array(is_row == 1))
            yield from rows.combine_chunks().to_batches()
    return run


def _pass(rows: DataFrame, word: int, shift: int, bits: int, chunks: int) -> DataFrame:
    """One stable counting sort of (place, chunk, row) by a digit of the key word ``row.k<word>``."""
    digit = F.shiftrightunsigned(F.col(f"row.k{word}"), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    numbered = rows.select("place", "chunk", digit.alias("digit"), "row")
    counts = staged(numbered.groupBy("chunk", "digit").agg(F.count(F.lit(1)).alias("n")), "radix-counts")
    # At most 2^bits totals, so one task sums them up; the chunks of a digit are summed digit by digit.
    below = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        F.col("digit").alias("d"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        F.broadcast(base), F.col("digit") == F.col("d")).select(
        "chunk", F.lit(0).alias("is_row"), F.lit(0).cast("bigint").alias("place"), "digit",
        (F.col("base") + F.col("before")).alias("start"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    both = starts.unionByName(numbered.select(
        "chunk", F.lit(1).alias("is_row"), "place", "digit", F.lit(0).cast("bigint").alias("start"), "row"))
    schema = T.StructType([T.StructField("place", T.LongType()), rows.schema["row"]])
    return (both.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "is_row", "place")
            .mapInArrow(_place(1 << bits), schema))


def ranked(df: DataFrame, keys: Sequence[Column], rank: str = "rank", digit_bits: int = DIGIT_BITS,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``rank``, 1 to its number of rows, in the order of ``keys`` (the first counts most).

    ``keys`` are ``ascending`` or ``descending`` bigint columns without nulls.
    Rows equal in all keys get neighbouring ranks in the order of the stored
    scan. An empty table stays empty; a column named ``rank`` is replaced.
    ``df`` must give the same rows when it is read twice (a stored table).
    """
    kept = [c for c in df.columns if c.lower() != rank.lower()]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    words = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    # Chunks of the first pass are the partitions of the scan; stored, so that they stay as they are.
    rows = staged(df.select(F.struct(row.alias("row"), *words).alias("row")).select(
        F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("chunk"), "row"), "radix-in")
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max("chunk").alias("last"),
                     *[f(f"row.k{i}").alias(f"{n}{i}") for i in range(len(words))
                       for n, f in (("or", F.bit_or), ("and", F.bit_and))]).first()
    if not about["n"]:
        return df.select(*[F.col(f"`{c}`") for c in kept], F.lit(1).cast("bigint").alias(rank)).limit(0)
    passes = []
    for i in reversed(range(len(words))):
        varying = (about[f"or{i}"] ^ about[f"and{i}"]) & ((1 << 64) - 1)
        while varying:
            shift = (varying & -varying).bit_length() - 1
            bits = min(digit_bits, 64 - shift)
            passes.append((i, shift, bits))
            varying &= ~(((1 << bits) - 1) << shift)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = min(chunk_rows, math.ceil(about["n"] / (2 * cores)))
    chunks = about["last"] + 1
    for word, shift, bits in passes or [(0, 0, 1)]:
        placed = _pass(rows, word, shift, bits, chunks)
        rows = staged(placed.withColumn("chunk", F.expr(f"CAST(place DIV {size} AS INT)")), "radix")
        chunks = math.ceil(about["n"] / size)
    return rows.select(*[F.col(f"row.row.c{i}").alias(c) for i, c in enumerate(kept)],
                       (F.col("place") + 1).alias(rank))
