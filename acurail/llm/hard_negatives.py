"""Hard-negative mining by a secondary sort of pair scores.

Every pair of an anchor and another row has an integer score. The pairs that
matter are packed into keys (anchor, falling score, kind, id), partitioned by
anchor and sorted within the partitions. One iterator reads a partition in
that order: a positive opens a window of scores below its own, and the
negatives that follow fill the windows that are open until each has its share.
It holds the few windows of one anchor, never an anchor's pairs.

Two sorts are made with the same keys. The first finds the positives, from the
best same-label rows of every shard. Their windows then tell which negatives of
a shard can matter: the first few below a window's upper end, whatever the
other shards hold. So the pairs that are shuffled grow with anchors times
shards, not with anchors times rows, and nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.llm.common import staged

ANCHOR_MODULUS, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score is between these parts of its positive's score, in per cent.
LEAST, MOST = 50, 95
SCALE = 256.0
#: Rows of a shard, rows and anchors scored at a time, and anchors of a block.
SHARD_ROWS, TILE_ROWS, TILE_ANCHORS, BLOCK_ANCHORS = 131_072, 16_384, 256, 16_384
#: Shards are made smaller than ``SHARD_ROWS``, down to this, while there are fewer of them than cores.
LEAST_ROWS = 4_096
#: Integer products and sums below this are exact in doubles.
_EXACT = 1 << 53

_PAIR = "anchor_id bigint, score bigint, negative int, vec_id bigint"
_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, shorter lists filled with zeros."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)
    lengths = np.diff(whole.offsets.to_numpy())
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def first_of(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest scores in falling order, the earlier of equals first."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        above = np.flatnonzero(scores > least)
        places = np.concatenate([above, np.flatnonzero(scores == least)[:n - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, -scores[places]))]


def _scored(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor's place, its id, ids, labels and scores of a tile's other rows, by rising id), tile by tile."""
    rows = rows.sort_by("vec_id")
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    width = max(_longest(anchors.column("w")), _longest(rows.column("w")))
    left, right = _matrix(anchors.column("w"), width), _matrix(rows.column("w"), width)
    most = [int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in (left, right)]
    if width * most[0] * most[1] < _EXACT:
        left, right = left.astype(np.float64), right.astype(np.float64)
    own = anchors.column("own").to_numpy().tolist()
    for r in range(0, len(ids), TILE_ROWS):
        tile_ids, tile_labels = ids[r:r + TILE_ROWS], labels[r:r + TILE_ROWS]
        for a in range(0, len(own), TILE_ANCHORS):
            products = left[a:a + TILE_ANCHORS] @ right[r:r + TILE_ROWS].T
            for i, scores in enumerate(products):
                at, end = np.searchsorted(tile_ids, [own[a + i], own[a + i] + 1])
                if end > at:
                    keep = np.r_[0:at, end:len(tile_ids)]
                    yield a + i, own[a + i], tile_ids[keep], tile_labels[keep], scores[keep]
                else:
                    yield a + i, own[a + i], tile_ids, tile_labels, scores


def _longest(column: pa.ChunkedArray) -> int:
    return max([0, *[int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in column.chunks]])


def _pairs(found: list[tuple[int, np.ndarray, np.ndarray]], negative: int) -> pa.Table:
    none = np.zeros(0, dtype=np.int64)
    sizes = [len(i) for _, i, _ in found]
    return pa.table({
        "anchor_id": pa.array(np.repeat(np.array([a for a, _, _ in found], dtype=np.int64), sizes), pa.int64()),
        "score": pa.array(np.concatenate([none, *[s.astype(np.int64) for _, _, s in found]]), pa.int64()),
        "negative": pa.array(np.full(sum(sizes), negative), pa.int32()),
        "vec_id": pa.array(np.concatenate([none, *[i for _, i, _ in found]]), pa.int64())})


def window(positive_score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """Lowest and highest score of a negative, from ``least * p <= 100 * n <= most * p``."""
    return -(-least * positive_score // 100), most * positive_score // 100


def _secondary_sort(pairs: DataFrame) -> DataFrame:
    """Pairs partitioned by anchor and sorted by (anchor, falling score, positives first, id)."""
    return pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "negative", "vec_id")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _best_positives(n: int):
    """The first ``n`` pairs of each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for b in batches:
            keep = []
            for anchor in b.column(0).to_pylist():
                taken = taken + 1 if anchor == last else 1
                last = anchor
                keep.append(taken <= n)
            yield b.filter(pa.array(keep, pa.bool_()))
    return run


def _mine(n: int, least: int, most: int):
    """Opens a window at each positive, and emits the first ``n`` negatives in it."""
    names = [f.split()[0] for f in _MINED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        windows: list[list[int]] = []  # positive's id, its score, lowest and highest score, negatives so far
        for b in batches:
            out = []
            for anchor, score, negative, vec_id in _groups([b]):
                if anchor != last:
                    last, windows = anchor, []
                if not negative:
                    low, high = window(score, least, most)
                    if low <= high:
                        windows.append([vec_id, score, low, high, 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3] and w[4] < n:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], vec_id, w[1], score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == "rank" else pa.int64()) for c, k in zip(zip(*out), names)], names)
    return run


def mine(vectors: DataFrame, label: Column | None = None, anchor_modulus: int = ANCHOR_MODULUS,
         positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
         scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; ``label`` may be
    another expression over its columns. Weights are ``floor(scale * x)``, a
    score is the integer inner product (a missing component of a shorter vector
    counts as zero), anchors are the rows whose ``vec_id`` is divisible by
    ``anchor_modulus``. The first ``positives`` same-label rows of an anchor,
    by falling score and rising id, each open a window; the first ``negatives``
    rows of other labels in it are returned. A positive with a negative score
    has an empty window.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part. Rows that repeat an id are candidates of their
    own, but never of that id's anchor, which is the row of the smallest label
    and vector among them. Vectors of any length are used whole. An empty table
    gives an empty table; other columns are not read. Blocks of anchors meet
    shards of rows, both of bounded size, and a pair of them returns at most
    ``positives * (1 + negatives)`` rows an anchor.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        (F.col("label") if label is None else label).cast("bigint").alias("label"),
        F.when(finite, F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))).alias("w"))
    rows = staged(rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND w IS NOT NULL"), "negatives")
    chosen = rows.filter(F.col("vec_id") % anchor_modulus == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "w")).alias("r")).select(F.col("vec_id").alias("own"), "r.label", "r.w")
    size = rows.agg(F.count("*").alias("n"),
                    F.coalesce(F.sum((F.col("vec_id") % anchor_modulus == 0).cast("int")), F.lit(0)).alias("q")).first()
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(size["n"] / SHARD_ROWS), min(2 * cores, math.ceil(size["n"] / LEAST_ROWS)))
    blocks = max(1, math.ceil(size["q"] / BLOCK_ANCHORS))
    block = F.pmod(F.xxhash64(F.lit("block"), "own"), F.lit(blocks)).cast("int").alias("block")
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    # A row's shard depends on more than its id, so rows that repeat one id are spread too.
    shard = F.pmod(F.xxhash64("vec_id", "label", "w"), F.lit(shards)).cast("int").alias("shard")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), shard,
                             "vec_id", "label", "w").groupBy("block", "shard")

    def same(anchors: pa.Table, others: pa.Table) -> pa.Table:
        labels = anchors.column("label").to_pylist()
        found = []
        for place, own, ids, other_labels, scores in _scored(anchors, others):
            like = other_labels == labels[place]
            ids, scores = ids[like], scores[like]
            first = first_of(scores, positives)
            found.append((own, ids[first], scores[first]))
        return _pairs(found, 0)

    near = chosen.select(block, each_shard, "own", "label", "w").groupBy("block", "shard").cogroup(
        candidates).applyInArrow(same, _PAIR)
    best = staged(_secondary_sort(near).mapInArrow(_best_positives(positives), _PAIR), "positives")
    opened = best.groupBy("anchor_id").agg(F.collect_list("score").alias("opened"))
    asked = chosen.join(opened, F.col("own") == F.col("anchor_id")).select("own", "label", "w", "opened")

    def other(anchors: pa.Table, others: pa.Table) -> pa.Table:
        labels, scores_of = anchors.column("label").to_pylist(), anchors.column("opened").to_pylist()
        found = []
        for place, own, ids, other_labels, scores in _scored(anchors, others):
            unlike = other_labels != labels[place]
            ids, scores = ids[unlike], scores[unlike]
            wanted = []
            for p in set(scores_of[place]):
                low, high = window(p, least, most)
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                wanted.append(inside[first_of(scores[inside], negatives)])
            places = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *wanted]))
            found.append((own, ids[places], scores[places]))
        return _pairs(found, 1)

    far = asked.select(block, each_shard, "own", "label", "w", "opened").groupBy("block", "shard").cogroup(
        candidates).applyInArrow(other, _PAIR)
    return _secondary_sort(best.unionByName(far)).mapInArrow(_mine(negatives, least, most), _MINED)
