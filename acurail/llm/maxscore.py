"""Exact top-k inner-product search by MaxScore over sharded postings.

A vector's component is a term, its integer weight the term's impact. Within a
shard every term has a posting list and the largest and smallest weight in it,
hence a bound on what it can add to a query's score. A query's terms are taken
by falling bound. As soon as the bounds of the rest add up to less than the
k-th best score so far, the rest is non-essential: vectors that no essential
term has brought near the threshold cannot enter the result. Essential
postings are traversed, the other terms are only probed for the vectors that
are still competitive. Each shard's best rows are merged into the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acurail.llm.common import staged

K = 20
QUERY_MODULUS = 20
#: Vectors of a shard, vectors indexed at a time within it, and queries of a block.
SHARD_ROWS, INDEX_ROWS, BLOCK_QUERIES = 131_072, 16_384, 32_768
#: Shards are made smaller than ``SHARD_ROWS``, down to this, while there are fewer of them than cores.
LEAST_ROWS = 4_096
#: Terms between two looks at the threshold, and the share of competitive vectors below which they are probed.
STRIDE, SPARSE = 6, 0.3


class Postings:
    """Posting lists of up to ``INDEX_ROWS`` vectors: term -> (row numbers or None if every row has it, weights)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        self.ids = ids
        n = len(ids)
        terms = int(lengths.max()) if n else 0
        if n and (lengths == terms).all():
            table = np.ascontiguousarray(weights.reshape(n, terms).T)
            self.lists = [(None, row) for row in table]
        else:
            row = np.repeat(np.arange(n), lengths)
            starts = np.cumsum(lengths) - lengths
            term = np.arange(len(weights)) - np.repeat(starts, lengths)
            used = np.flatnonzero(weights)
            row, term, weights = row[used], term[used], weights[used]
            order = np.argsort(term, kind="stable")
            row, weights = row[order], weights[order]
            cuts = np.searchsorted(term[order], np.arange(terms + 1))
            self.lists = [(row[a:b], weights[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        none = np.zeros(1, dtype=np.int64)
        self.most = np.array([max(0, int(np.max(w, initial=0))) if r is not None else int((w if len(w) else none).max())
                              for r, w in self.lists], dtype=np.int64)
        self.least = np.array([min(0, int(np.min(w, initial=0))) if r is not None else int((w if len(w) else none).min())
                               for r, w in self.lists], dtype=np.int64)

    def add(self, term: int, factor: int, score: np.ndarray) -> None:
        """Traverse a posting list."""
        rows, weights = self.lists[term]
        if rows is None:
            score += factor * weights
        else:
            score[rows] += factor * weights

    def probe(self, term: int, rows: np.ndarray) -> np.ndarray:
        """The term's weights of single rows."""
        own, weights = self.lists[term]
        if own is None:
            return weights[rows]
        out = np.zeros(len(rows), dtype=np.int64)
        if len(own):
            at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
            hit = own[at] == rows
            out[hit] = weights[at[hit]]
        return out

    def exact(self, terms: np.ndarray, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows), dtype=np.int64)
        for t in terms:
            total += query[t] * self.probe(t, rows)
        return total


def search(postings: Postings, query: np.ndarray, own: int, k: int,
           best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge a shard's vectors into ``best`` (scores and ids, best first), the query's own rows left out."""
    query = query[:len(postings.lists)]
    bound = np.maximum(np.maximum(query * postings.most[:len(query)], query * postings.least[:len(query)]), 0)
    used = np.flatnonzero(query)
    terms = used[np.argsort(-bound[used], kind="stable")]
    rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # most that the terms from i on can add
    n = len(postings.ids)
    score = np.zeros(n, dtype=np.int64)
    scores, ids = best
    threshold = int(scores[-1]) if len(scores) >= k else None
    i = 0
    rows = None
    while i < len(terms):
        if threshold is not None and rest[i] < threshold:
            break  # what follows is non-essential
        postings.add(terms[i], query[terms[i]], score)
        i += 1
        if i % STRIDE:
            continue
        if i <= 2 * STRIDE and n > k:  # full scores of the vectors that lead so far raise the threshold
            lead = np.argpartition(score, n - k - 1)[n - k - 1:]
            lead = lead[postings.ids[lead] != own]
            full = np.sort(np.concatenate([postings.exact(terms, query, lead)]))[::-1]
            if len(full) >= k:
                threshold = max(int(full[k - 1]), threshold if threshold is not None else int(full[k - 1]))
        if threshold is not None:
            near = score + rest[i] >= threshold
            if np.count_nonzero(near) < SPARSE * n:
                rows = np.flatnonzero(near)
                break
    if rows is None:
        rows = np.arange(n) if threshold is None else np.flatnonzero(score + rest[i] >= threshold)
    rows = rows[postings.ids[rows] != own]
    partial = score[rows]
    while i < len(terms) and len(rows):
        partial = partial + query[terms[i]] * postings.probe(terms[i], rows)
        i += 1
        if threshold is not None and i % 2 == 0:
            near = partial + rest[i] >= threshold
            rows, partial = rows[near], partial[near]
    scores, ids = np.concatenate([scores, partial]), np.concatenate([ids, postings.ids[rows]])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of a list column."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)
    lengths = np.diff(whole.offsets.to_numpy())
    return lengths, whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def top_k(vectors: DataFrame, k: int = K, query_modulus: int = QUERY_MODULUS, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for every query row.

    Weights are ``floor(scale * component)``; queries are the rows whose
    ``vec_id`` is divisible by ``query_modulus``, candidates are all rows.
    Vectors that are null or hold a null or non-finite component, and rows
    without id, take no part; missing components of shorter vectors count as
    zero. Ties go to the smaller ``vec_id``. Rows that repeat an id are
    candidates of their own but never of that id's query, which is answered
    once, for the smallest vector among them. Vectors of any length are used
    whole; an empty table gives an empty table; other columns are not read. Blocks of queries meet shards of vectors, both of bounded size; a
    pair of them returns at most ``k`` rows a query.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = staged(vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("w")),
        "maxscore")
    is_query = F.col("vec_id") % query_modulus == 0
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query.cast("int")), F.lit(0)).alias("q")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(size["n"] / SHARD_ROWS), min(2 * cores, math.ceil(size["n"] / LEAST_ROWS)))
    blocks = max(1, math.ceil(size["q"] / BLOCK_QUERIES))
    h = F.xxhash64("vec_id")
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("w").alias("w")).select(F.col("vec_id").alias("own"), "w")
    queries = asked.select(
        F.pmod(F.xxhash64(F.lit("block"), "own"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "own", "w")
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(h, F.lit(shards)).cast("int").alias("shard"), "vec_id", "w")

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        query_ids = q.column("own").to_numpy()
        lengths, flat = _lists(q.column("w"))
        at = np.cumsum(lengths) - lengths
        weights = [flat[a:a + m] for a, m in zip(at, lengths)]
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        best = [none] * len(query_ids)
        for start in range(0, d.num_rows if len(query_ids) else 0, INDEX_ROWS):
            part = d.slice(start, INDEX_ROWS)
            postings = Postings(part.column("vec_id").to_numpy(), *_lists(part.column("w")))
            for i, (own, w) in enumerate(zip(query_ids.tolist(), weights)):
                best[i] = search(postings, w, own, k, best[i])
        found = [len(s) for s, _ in best]
        return pa.table({"query_id": pa.array(np.repeat(query_ids, found), pa.int64()),
                         "vec_id": pa.array(np.concatenate([none[0], *[i for _, i in best]]), pa.int64()),
                         "score": pa.array(np.concatenate([none[0], *[s for s, _ in best]]), pa.int64())})

    found = queries.groupBy("block", "shard").cogroup(candidates.groupBy("block", "shard")).applyInArrow(
        meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
