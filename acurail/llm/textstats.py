"""Whole-text statistics in one pass: the raw material of the rule learners.

Every count is taken in a single Arrow UDF call per document, because the
repeated-window count needs word identities that column expressions could
only get by exploding every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from acurail.llm.common import ASCII_SPACE

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_marks", "n_letters", "n_distinct_words", "n_adjacent_repeats"]

_SYMBOLS = b"#*$%&|<>"
_ALL = bytes(range(256))
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0x80)
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?;:~^=+_@\\/()[]{}"


def _others(kept: bytes) -> bytes:
    return bytes(c for c in _ALL if c not in kept)


_NOT = {name: _others(kept) for name, kept in
        (("symbols", _SYMBOLS), ("upper", _UPPER), ("letters", _LETTERS), ("digits", _DIGITS), ("marks", _MARKS))}


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, int]:
    values, ranks = np.unique(codes, return_inverse=True)
    return ranks.astype(np.int64), len(values)


def repeated_window_words(ids: np.ndarray, distinct: int, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words occurring at least twice.

    Windows are named exactly by ranking pairs of half windows (2, 4, 8 words),
    never by a hash. Once no two half windows are equal, no window can repeat.
    """
    n = len(ids)
    if n <= width or distinct == n:
        return 0
    span, ranks, count = 1, ids, distinct
    while span < width:
        ranks, count = _ranked(ranks[:-span] * count + ranks[span:])
        span *= 2
        if count == len(ranks):
            return 0
    again = np.flatnonzero(np.bincount(ranks, minlength=count)[ranks] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[again] += 1
    edges[again + width] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text; null counts as the empty text.

    Letters are ASCII letters and bytes of other scripts; upper case, digits
    and marks are ASCII.
    """
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(text.count(c) for c in ASCII_SPACE)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    size = {name: len(raw.translate(None, drop)) for name, drop in _NOT.items()}
    return (n, len(text) - spaces, size["symbols"], len(lines) - len(set(lines)),
            repeated_window_words(ids, len(number)), len(lines), size["upper"], size["digits"], size["marks"],
            size["letters"], len(number), int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0)


_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def text_stats(text: Column) -> Column:
    """Struct column of ``COUNTS``; marked non-deterministic so that Spark never evaluates it twice."""

    @F.arrow_udf(_STRUCT)
    def counts(texts: pa.Array) -> pa.Array:
        rows = [text_counts(x.as_py()) for x in texts]
        columns = zip(*rows) if rows else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)

    return counts.asNondeterministic()(text.cast("string"))


def ratios(stats: str) -> dict[str, Column]:
    """Scale-free statistics over the struct column ``stats``, as Spark expressions; never null."""

    def c(name: str) -> Column:
        return F.col(f"{stats}.{name}").cast("double")

    def per(name: str, base: str) -> Column:
        return c(name) / F.greatest(c(base), F.lit(1.0))

    return {
        "words": c("n_words"),
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "mark_share": per("n_marks", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "letter_share": per("n_letters", "word_chars"),
        "distinct_share": per("n_distinct_words", "n_words"),
        "adjacent_share": per("n_adjacent_repeats", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "words_per_line": per("n_words", "n_lines"),
    }
