"""Bounded memories of computed values for the tasks of a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memory(dict):
    """``memory[key]`` computes what is missing and forgets what was not used for long.

    Two generations of about ``size`` entries: a value that is asked for again
    moves to the young one, and when that is full the old one goes.
    Keys longer than ``longest`` are computed each time, so the bytes that are
    held are bounded too.
    """

    def __init__(self, compute: Callable, size: int, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest = compute, size, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if isinstance(key, (str, bytes)) and len(key) > self.longest:
                return value
        self[key] = value
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        return value

    def many(self, keys: list, compute_all: Callable[[list], list]) -> list:
        """Values of ``keys``; those missing are computed at once, each once."""
        out = list(map(self.get, keys))
        missing = [i for i, value in enumerate(out) if value is None]
        if missing:
            new = {keys[i]: None for i in missing}
            new = {k: self.old.get(k) for k in new}
            unseen = [k for k, value in new.items() if value is None]
            if unseen:
                new.update(zip(unseen, compute_all(unseen)))
            for i in missing:
                out[i] = new[keys[i]]
            longest = self.longest
            self.update((k, value) for k, value in new.items() if len(k) <= longest)
            if len(self) > self.size:
                self.old = dict(self)
                self.clear()
        return out


def joined_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``size`` bytes (the last may be smaller)."""
    held, held_bytes = [], 0
    for b in batches:
        held.append(b)
        held_bytes += b.nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def groups(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes of text (a longer text is a slice of its own), nulls as empty texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(at, end - at)
        at = end


def spread(words: pa.ListArray, encode_all: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all lists of words in turn, number of ids of each list).

    ``encode_all`` gives the ids of the distinct words as little-endian 32-bit numbers.
    """
    offsets = words.offsets.to_numpy()
    coded = words.flatten().dictionary_encode()
    found = encode_all(coded.dictionary.to_pylist())
    length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    ids = np.frombuffer(b"".join(found), dtype="<u4")
    word = coded.indices.to_numpy()
    size = length[word]
    ends = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat((np.cumsum(length) - length)[word] - ends[:-1], size)
    place += np.arange(ends[-1])
    return ids[place], np.diff(ends[offsets - offsets[0]])
