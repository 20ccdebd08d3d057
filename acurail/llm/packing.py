"""Packing token streams into fixed windows by order-preserving dynamic programming.

The documents of a scan partition form one token stream in their stored order.
Windows of at most ``length`` tokens are cut at document ends (free), sentence
ends or, at a higher price, within stretches that have no sentence end for long. The cheapest cuts
minimise padding plus a penalty per truncated document. With positions ``p``
and ``best[i] = min over j of best[j] + length - (p[i] - p[j]) + penalty[i]``,
``best[j] + p[j]`` is all that a transition needs, so a monotone queue over
the window gives each minimum in constant time.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acurail.llm.memory import Memory, groups, joined_batches, spread

LENGTH = 2048
END_ID = 1
#: Cost, in tokens of padding, of ending a window inside a document: at a sentence end, or anywhere.
SENTENCE_PENALTY, HARD_PENALTY = 8.0, 32.0
#: Stretches of more tokens than this without a sentence end may be cut every so many tokens.
LONG_SENTENCE, HARD_STEP = 64, 16
#: Tokens of a partition that one round of the dynamic programme covers.
BLOCK_TOKENS = 1 << 18
#: Words that are encoded as one text.
JOINED = 256
#: Bytes of texts whose words are looked up together, and words whose ids a worker remembers.
GROUP_BYTES, MEMORY_WORDS = 1 << 23, 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: One of these marks between an ASCII letter and white space is a piece of its own for the tokenizer.
_MARKS, _LETTERS = ".,;:!?", frozenset("abcdefghijklmnopqrstuvwxyz")


class WordEncoder:
    """Token ids of whole texts through a memory of words.

    The tokenizer lower-cases, and its pieces never span ASCII white space nor
    an ASCII letter and a following mark. A text's ids are thus those of its
    lower-cased words and marks in turn; each distinct word of a group of texts
    is looked up once, and encoded if it is not remembered. Texts that may hold
    a special token are encoded as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.memory = Memory(None, MEMORY_WORDS)
        self.mark_ids = dict(zip(_MARKS, self.encode(list(_MARKS))))
        #: Ids that end a sentence.
        self.stops = np.unique([np.frombuffer(self.mark_ids[m], dtype="<u4")[-1] for m in ".!?"])

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words. Words of letters alone are one piece each, so they are encoded joined and told
        apart by the piece number of each token."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() and w.lower().isalpha() else other).append(w)
        found = dict(zip(other, self.encode(other))) if other else {}
        joined = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        whole = self.tokenizer.encode_batch([" ".join(g) for g in joined], add_special_tokens=False)
        for g, e in zip(joined, whole):
            piece = np.array(e.word_ids, dtype=np.int64)
            if len(piece) == 0 or piece[-1] != len(g) - 1:  # letters that normalisation takes apart
                found.update(zip(g, self.encode(g)))
                continue
            raw = np.array(e.ids, dtype="<u4").tobytes()
            cuts = (4 * np.searchsorted(piece, np.arange(len(g) + 1))).tolist()
            found.update((w, raw[a:b]) for w, a, b in zip(g, cuts[:-1], cuts[1:]))
        return [found[w] for w in words]

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, a mark at their end looked up on its own."""
        cores = [w.rstrip(_MARKS) for w in words]
        marked = [i for i, (w, c) in enumerate(zip(words, cores)) if len(w) != len(c)]
        tails = []
        for i in marked:
            w, c = words[i], cores[i]
            if len(w) == len(c) + 1 and c and c[-1] in _LETTERS:
                tails.append(i)
            else:
                cores[i] = w
        found = self.memory.many(cores, self.encode_words)
        for i in tails:
            found[i] += self.mark_ids[words[i][-1]]
        return found

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none is null."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        flat, sizes = spread(pc.ascii_split_whitespace(pc.ascii_lower(texts)), self.words_ids)
        each = np.split(flat, np.cumsum(sizes)[:-1])
        for i in np.flatnonzero(special):
            each[i] = np.frombuffer(self.encode([texts[i].as_py()])[0], dtype="<u4")
        return each


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder; its memory outlives a task."""
    return WordEncoder(path)


def window_ends(cuts: np.ndarray, penalty: np.ndarray, length: int, last: bool) -> list[int]:
    """Indices into ``cuts`` at which windows end.

    ``cuts`` are ascending positions from 0, neighbours at most ``length``
    apart. With ``last`` the final window ends at the final cut; otherwise
    windows end so that at most ``length`` tokens are left for the next round.
    """
    p, pen = cuts.tolist(), penalty.tolist()
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for i in range(1, len(p)):
        at = p[i]
        while p[queue[0][1]] < at - length:
            queue.popleft()
        value, j = queue[0]
        best[i] = value + length - at + pen[i]
        back[i] = j
        key = best[i] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    i = len(p) - 1
    if not last:
        i = min((j for j in range(len(p)) if p[j] >= p[-1] - length), key=lambda j: best[j] - p[j])
    ends = []
    while i > 0:
        ends.append(i)
        i = back[i]
    return ends[::-1]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the allowed cuts of a block, 0 and its end included."""
    sentence = np.flatnonzero(np.isin(ids, stops)) + 1
    points = np.union1d(sentence, doc_ends)
    points = np.union1d(points, [0, len(ids)])
    step = min(HARD_STEP, length)
    long = np.flatnonzero(np.diff(points) > min(LONG_SENTENCE, length))
    hard = [np.arange(points[i] + step, points[i + 1], step) for i in long]
    every = np.union1d(points, np.concatenate(hard)) if hard else points
    penalty = np.full(len(every), HARD_PENALTY)
    penalty[np.isin(every, sentence)] = SENTENCE_PENALTY
    penalty[np.isin(every, doc_ends)] = 0.0
    return every, penalty


PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


class Packer:
    """Packs one partition's documents block by block; holds a block of tokens, never the partition."""

    def __init__(self, length: int, stops: np.ndarray, first_sequence: int):
        self.length, self.stops, self.sequence = length, stops, first_sequence
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens of the whole document, tokens already placed
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.docs.append((doc_id, len(ids), 0))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK_TOKENS:
            yield self.flush(last=False)

    def flush(self, last: bool) -> list[tuple]:
        """Place what is held (all but the remainder of less than a window, unless ``last``)."""
        if not self.docs:
            return []
        ids = np.concatenate(self.held)
        sizes = np.array([n - done for _, n, done in self.docs], dtype=np.int64)
        doc_ends = np.cumsum(sizes)
        doc_starts = doc_ends - sizes
        cuts, penalty = cut_points(ids, doc_ends, self.stops, self.length)
        windows = cuts[window_ends(cuts, penalty, self.length, last)]
        if not len(windows):
            return []
        limit = int(windows[-1])
        starts = np.union1d(np.concatenate([[0], windows[:-1]]), doc_starts[doc_starts < limit])
        ends = np.append(starts[1:], limit)
        window = np.searchsorted(windows, starts, side="right")
        window_start = np.concatenate([[0], windows[:-1]])[window]
        doc = np.searchsorted(doc_ends, starts, side="right")
        raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        pieces = []
        for s, e, w, ws, d in zip(starts.tolist(), ends.tolist(), window.tolist(), window_start.tolist(), doc.tolist()):
            doc_id, tokens, done = self.docs[d]
            pieces.append((doc_id, s - int(doc_starts[d]) + done, e - s, zlib.crc32(raw[4 * s:4 * e]), tokens,
                           self.sequence + w, s - ws))
        self.sequence += len(windows)
        first = int(np.searchsorted(doc_ends, limit, side="right"))
        rest = []
        for k in range(first, len(self.docs)):
            doc_id, tokens, done = self.docs[k]
            rest.append((doc_id, tokens, done + max(0, limit - int(doc_starts[k]))))
        self.docs, self.held = rest, [ids[limit:].copy()] if limit < len(ids) else []
        self.size = len(ids) - limit
        return pieces


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece (``PIECES``) of every row of ``docs``.

    A document is the ids of its whole text, special tokens off, then
    ``end_id``; a null or empty text is ``end_id`` alone. Pieces of a sequence
    follow each other from offset 0 without gaps; a sequence holds at most
    ``length`` tokens. Repeated rows are documents of their own; other columns
    are not read. A narrow map over the stored order: no shuffle. Sequence ids
    carry the partition's number in their upper half, so a task that is run
    again gives the same rows; ``docs`` must be a stored table (as in every
    query and pipeline stage here), whose scan order does not change.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        packer = Packer(length, encoder.stops, TaskContext.get().partitionId() << 32)
        names = [f.split()[0] for f in PIECES.split(", ")]
        end = np.array([end_id], dtype="<u4")

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pieces)], names=names)

        for batch in joined_batches(batches, GROUP_BYTES):
            doc_ids = iter(batch.column(0).to_pylist())
            for group in groups(batch.column(1), GROUP_BYTES):
                for doc_id, ids in zip(doc_ids, encoder.ids(group)):
                    for pieces in packer.add(doc_id, np.concatenate([ids, end])):
                        if pieces:
                            yield out(pieces)
        pieces = packer.flush(last=True)
        if pieces:
            yield out(pieces)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(packed, PIECES)
