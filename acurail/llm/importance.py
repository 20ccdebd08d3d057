"""Resampling documents towards a target distribution by importance weights of hashed word runs.

Features of a text are its runs of 1 to 3 words, hashed by crc32 into a fixed
number of buckets. The bucket counts of the corpus and of the target texts give
each bucket a gain, an array that scores every document. Noise drawn from the
document's id turns "the highest scores" into a sample without replacement, and
a distributed radix sort gives the exact ranks.

The crc32 of a run is put together from those of its words: without its fixed
first and last step crc32 is linear over the bits, so the remainder of ``a b``
is that of ``a``, carried over the bytes of `` b``, xor that of `` b``. Tables
of the carry over 1, 2, 4, ... bytes do this for whole arrays of words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acurail.llm import radix
from acurail.llm.common import staged, without

BUCKETS, RUN, SMOOTH, SEED = 10_000, 3, 10_000, 42
MIN_WORDS, SHARE = 20, (5, 100)
_POLYNOMIAL = 0xEDB88320
_SPACE = 0x20
#: Bytes of texts that are hashed at a time; texts of more are taken in stretches of so many words.
BLOCK_BYTES, STRETCH_WORDS = 1 << 20, 100_000


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """Remainder of each single byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _by_bytes(images: np.ndarray) -> np.ndarray:
    """Tables (4 x 256) of the linear map that sends bit ``i`` to ``images[i]``."""
    values = np.arange(256)
    out = np.zeros((4, 256), dtype=np.uint32)
    for i in range(32):
        out[i // 8] ^= np.where(values >> i % 8 & 1, images[i], 0).astype(np.uint32)
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@lru_cache(maxsize=1)
def _carries() -> list[np.ndarray]:
    """Tables that carry a remainder over 1, 2, 4, ... further zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    table = _by_bytes((bits >> 8) ^ _byte_table()[bits & 255])
    out = [table]
    for _ in range(40):
        table = _by_bytes(_apply(table, _apply(table, bits)))
        out.append(table)
    return out


#: Carries over up to this many bytes have a table of their own.
_SHORT = 64


@lru_cache(maxsize=1)
def _short_carries() -> np.ndarray:
    """``[length, byte place, byte]`` tables for carries over 0 to ``_SHORT`` - 1 bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return np.stack([_by_bytes(_carry_long(bits, np.full(32, n))) for n in range(_SHORT)])


def _carry_long(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    x = x.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        x[on] = _apply(_carries()[k], x[on])
    return x


def carry(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Remainders ``x`` carried over ``length`` further bytes each."""
    tables = _short_carries()
    n = np.minimum(length, _SHORT - 1)
    out = (tables[n, 0, x & 255] ^ tables[n, 1, x >> 8 & 255] ^ tables[n, 2, x >> 16 & 255] ^ tables[n, 3, x >> 24])
    long = np.flatnonzero(length >= _SHORT)
    if len(long):
        out[long] = _carry_long(x[long], length[long])
    return out


def finished(remainder: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 from the remainder and the number of bytes."""
    ones = np.full(len(remainder), 0xFFFFFFFF, dtype=np.uint32)
    return remainder ^ carry(ones, length) ^ np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(lower case of A-Z, is part of a word) by byte; a word's characters beyond ASCII have no other bytes."""
    byte = np.arange(256, dtype=np.uint8)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    word = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    return lower, word


def run_hashes(texts: list[bytes], known: list[int] | None = None,
               longest: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of every run, its text's place, words of each text) for runs of 1 to ``longest`` words.

    Of a text with ``known`` words in front only the runs that end behind them count, and only the words behind them.
    """
    lower, is_word = _classes()
    raw = lower[np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)]  # each text is followed by a non-word byte
    inside = is_word[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(text_end, start, side="right")
    words = np.bincount(text, minlength=len(texts))
    if not len(start):
        return np.zeros(0, np.uint32), text, words
    new = np.ones(len(text), dtype=bool)
    if known and any(known):
        new = np.arange(len(text)) - (np.cumsum(words) - words)[text] >= np.array(known)[text]
        words = words - known
    length = end - start
    at = np.flatnonzero(inside)
    behind = np.repeat(end, length) - 1 - at  # bytes of the word that follow
    one = np.bitwise_xor.reduceat(carry(_byte_table()[raw[at]], behind), np.cumsum(length) - length)
    remainder, size, place = one, length, text
    hashes, places = [finished(one, length)[new]], [text[new]]
    space = carry(np.full(len(one), _byte_table()[_SPACE], dtype=np.uint32), length)  # " word" but for the word
    for k in range(1, longest):
        same = np.flatnonzero(text[k:] == place[:len(text) - k])
        last = same + k
        # Runs are kept by their first word; those that go on past a text's end are left out.
        remainder_k = carry(remainder[same], length[last] + 1) ^ space[last] ^ one[last]
        size_k = size[same] + 1 + length[last]
        hashes.append(finished(remainder_k, size_k)[new[last]])
        places.append(text[same][new[last]])
        if k + 1 < longest:
            remainder, size = remainder.copy(), size.copy()
            remainder[same], size[same] = remainder_k, size_k
            place = place.copy()
            place[np.setdiff1d(np.arange(len(place)), same)] = -1
    return np.concatenate(hashes), np.concatenate(places), words


def _stretches(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """(bytes, known words) that together hold every run of a text once."""
    if len(raw) <= BLOCK_BYTES:
        yield raw, 0
        return
    inside = _classes()[1][_classes()[0][np.frombuffer(raw, dtype=np.uint8)]].view(np.int8)
    edge = np.diff(inside, prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for at in range(0, len(start), STRETCH_WORDS):
        first = max(0, at - RUN + 1)
        yield raw[start[first]:end[min(at + STRETCH_WORDS, len(end)) - 1]], at - first


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(crc32 of every run, its row, words of each row), block by block."""
    rows, held, known, size = [], [], [], 0

    def hashed():
        crc, place, words = run_hashes(held, known)
        owner = np.array(rows)
        return crc, owner[place], np.bincount(owner, weights=words, minlength=len(texts)).astype(np.int64)

    for row, t in enumerate(texts):
        for raw, before in _stretches((t or "").encode("utf-8", "surrogatepass")):
            if held and size + len(raw) > BLOCK_BYTES:
                yield hashed()
                rows, held, known, size = [], [], [], 0
            rows.append(row)
            held.append(raw)
            known.append(before)
            size += len(raw)
    if held:
        yield hashed()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the runs of the texts (a column ``text``) fall into each bucket; one row a used bucket.

    Every task adds up its own texts; null and empty texts add nothing.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for crc, _, _ in _blocks(b.column(0).to_pylist()):
                total += np.bincount(crc % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    return (texts.select(F.col("text").cast("string")).mapInArrow(counted, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, smooth: int = SMOOTH) -> list[int]:
    """Gain of every bucket; the driver gets one row a bucket, whatever the size of the corpus."""
    counts = [np.zeros(buckets, dtype=np.int64) for _ in range(2)]
    for n, frame in zip(counts, (corpus, target)):
        for r in bucket_counts(frame, buckets).collect():
            n[r["bucket"]] = r["n"]
    s, t = (n.tolist() for n in counts)
    all_s, all_t = float(sum(s) + smooth), float(sum(t) + smooth)
    return [math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


RESULT = ["n_words", "n_features", "weight", "score", "rank"]


def scored(docs: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``.

    A null or empty text has no feature and weight 0. A null id draws its noise
    as the empty id. Texts of any length are read whole.
    """
    table = np.array(gain, dtype=np.int64)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            n_words, n_features, weight = np.zeros((3, len(ids)), dtype=np.int64)
            for crc, row, words in _blocks(b.column(1).to_pylist()):
                n_words += words
                n_features += np.bincount(row, minlength=len(ids))
                np.add.at(weight, row, table[crc % len(table)])
            score = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, n_words, n_features, weight, score)],
                                             ["doc_id", *RESULT[:4]])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        weighed, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards ``target``.

    Of the rows with at least ``min_words`` words the ``floor(share * N)`` of
    the highest scores are drawn and ranked from 1, ties to the smaller
    ``doc_id`` and a null id last; ``rank`` is null for all others. Repeated
    rows are rows of their own; those equal in score and id get neighbouring
    ranks. Columns other than ``doc_id`` and ``text`` are not read. An empty
    ``docs`` gives an empty table; an empty ``target`` leaves the gains to the
    corpus alone.
    """
    rows = staged(scored(docs, gains(docs, target, buckets), seed), "importance")
    enough = F.col("n_words") >= min_words
    many = rows.filter(enough)
    drawn = many.count() * share[0] // share[1]
    no_id = F.col("doc_id").isNull().cast("bigint")
    order = radix.ranked(many, [radix.descending(F.col("score")), radix.ascending(no_id),
                                radix.ascending(F.coalesce("doc_id", F.lit(0)))])
    few = rows.filter(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    return order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(few)
