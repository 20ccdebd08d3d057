"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits. Structured masks (Pagh, 2016): every bit position
gets a nonzero code of ``radius + 1`` bits, and for each nonzero vector ``v``
a mask keeps the positions whose code has an odd inner product with ``v``. Up
to ``radius`` differing positions span too few codes to hit every ``v``, so
any pair within the radius agrees under one of the ``2^(radius+1) - 1`` masks
and meets in that table. Buckets that hold too many fingerprints are divided
by masks of the same kind over their remaining positions, which keeps the
guarantee, so every bucket handed to a task is bounded without losing a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.llm.common import staged

BITS = 64
SHINGLE = 3
RADIUS = 3
#: Fingerprints that one bucket may hold before it is divided.
MAX_BUCKET = 4_096
#: Buckets up to this size have their pairs compared by shifts; larger ones by growing components.
SMALL_BUCKET = 16
_SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; 0 if it has no word.

    Words are runs without ASCII white space, A-Z lower-cased. Shingles of
    ``width`` words (the whole sequence if there are fewer) count as often as
    they occur. A bit is 1 if more than half of the shingle hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, _SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint as a (signed) bigint column."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(x.as_py(), width) for x in texts), dtype=np.uint64, count=len(texts))
        return pa.array(values.view(np.int64))

    return of.asNondeterministic()(text.cast("string"))


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """``2^(radius+1) - 1`` masks over ``positions`` such that any ``radius`` positions are missed by some mask."""
    codes = (1 << (radius + 1)) - 1
    return [sum(1 << p for i, p in enumerate(positions) if ((i % codes + 1) & v).bit_count() % 2)
            for v in range(1, codes + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp) under each of ``masks``."""
    tables = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"),
                                F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks])
    return rows.select("fp", F.explode(tables).alias("t")).select("t.mask", "t.key", "fp")


def _local_links(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect each component of one bucket: at most one a fingerprint."""
    left, right = [], []
    rest = fp
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hits = rest[near]
                left.append(np.full(len(hits), x))
                right.append(hits)
                stack.extend(hits)
                rest = rest[~near]
    return left, right


def _bucket_links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows sorted by (mask, key)."""
    first = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
    size = np.diff(np.append(first, len(fp)))
    left, right = [], []
    bucket = np.repeat(np.arange(len(first)), size)
    small = (size <= SMALL_BUCKET)[bucket]
    f, b = fp[small], bucket[small]
    for shift in range(1, min(SMALL_BUCKET, len(f))):
        i = np.flatnonzero(b[shift:] == b[:-shift])
        if not len(i):
            break
        near = i[np.bitwise_count(f[i] ^ f[i + shift]) <= radius]
        left.append(f[near])
        right.append(f[near + shift])
    for at in np.flatnonzero(size > SMALL_BUCKET):
        x, y = _local_links(fp[first[at]:first[at] + size[at]], radius)
        left += x
        right += y
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fingerprints: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints of column ``fp`` that connect exactly what the radius does.

    Each bucket contributes links that span its components, never all its
    pairs, so the result is of the order of the input.
    """
    # Below 2^8 rows a bucket may have too few free positions for every inner mask to keep one.
    max_bucket = max(max_bucket, 1 << 8)
    rows = _keyed(fingerprints.select("fp"), covering_masks(list(range(BITS)), radius))
    ready = []
    while True:
        crowded = staged(rows.groupBy("mask", "key").count().filter(F.col("count") > max_bucket)
                         .select("mask", "key"), "crowded")
        parts = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # masks, not buckets
        if not parts:
            ready.append(rows)
            break
        ready.append(rows.join(crowded, ["mask", "key"], "left_anti"))
        held = staged(rows.join(crowded, ["mask", "key"], "left_semi"), "crowded-rows")
        inner = [(m, _signed((m % (1 << BITS)) | x)) for m in parts
                 for x in covering_masks([p for p in range(BITS) if not (m >> p) & 1], radius)]
        # One row for each pair of masks: at most 15 to the power of the depth, whatever the corpus holds.
        finer = fingerprints.sparkSession.createDataFrame(inner, "mask bigint, inner bigint")
        rows = staged(held.join(F.broadcast(finer), "mask").select(
            F.col("inner").alias("mask"), F.col("fp").bitwiseAND(F.col("inner")).alias("key"), "fp").distinct(), "finer")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _bucket_links(part[0], part[1], part[2].view(np.uint64), radius)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            if not len(held[0]):
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the bucket that may go on in the next batch is kept
            if cut:
                yield out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield out(held)

    found = None
    for part in ready:
        part = part.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        part = part.mapInArrow(linked, "a bigint, b bigint")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node with a link; ``root`` is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on
    stored links until they no longer change. Each step is one aggregation
    and one join on the links; degrees are never gathered in one row.
    """
    edges = staged(edges.select("a", "b").filter("a <> b"), label)

    def size(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
                 .filter("a <> b").distinct())
        # Small star: every node keeps its smallest neighbour, which takes over the node's other smaller neighbours.
        large = staged(large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), label)
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(root, "b").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b")
            .filter("a <> b").distinct())
        edges = staged(small, label)
        after = size(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def _grouped(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp) of every row, (fp, root, component_id) of every distinct fingerprint)."""
    prints = staged(docs.select(F.col("doc_id"), fingerprint_column(F.col("text"), width).alias("fp")), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, radius))
    tied = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, tied.join(ids, "root").select("fp", "root", "component_id")


def duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits. Null and empty texts have
    fingerprint zero and are linked like any other; texts of any length are
    hashed whole; repeated rows stay; an empty table gives an empty table.
    ``component_id`` is the smallest non-null ``doc_id`` reachable over links of
    at most ``radius`` differing bits, null if a component has none. Further
    input columns are not read.
    """
    prints, groups = _grouped(docs, width, radius)
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id`` (any, if rows repeat it).

    Only ids move to decide; a kept row's text is shuffled only if its id is
    repeated. A repeated id may stand for different texts, so its rows are
    told apart by their fingerprints. Null and empty texts are one component,
    like equal texts; texts of any length are compared whole; an empty table
    stays empty; no column is added, so none can clash.
    """
    prints, groups = _grouped(docs, width, radius)
    kept = prints.join(groups, "fp").filter(F.col("doc_id") == F.col("component_id"))
    kept = staged(kept.select("doc_id", "fp", "root").distinct(), "simhash-kept")
    repeated = staged(prints.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1")
                      .select("doc_id"), "simhash-repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.join(kept.join(repeated, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").select(*columns)
    # Rows of repeated ids: one of each component that the id leads.
    leading = kept.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "fp", "root")
    several = docs.join(leading.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
        F.struct(*columns).alias("row"), F.col("doc_id").alias("id"),
        fingerprint_column(F.col("text"), width).alias("fp"))
    several = several.join(leading, ["id", "fp"]).dropDuplicates(["root"]).select("row.*")
    # Components without any id: one row of each, found by its fingerprint.
    lost = docs.filter(F.col("doc_id").isNull()).select(
        F.struct(*columns).alias("row"), fingerprint_column(F.col("text"), width).alias("fp"))
    lost = (lost.join(groups.filter(F.col("component_id").isNull()), "fp").dropDuplicates(["root"]).select("row.*"))
    return single.unionByName(several).unionByName(lost)
