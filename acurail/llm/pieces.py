"""Exact encoding with a merge-type piece vocabulary by backtracking, and decoding.

A merge-type encoder joins, again and again, the two neighbours whose joint
piece has the highest score (the leftmost of equals), starting from single
characters. Its result is the only sequence of pieces in which every two
neighbours are *compatible*: re-merging their joint text gives just these two.
So no text needs to be merged as a whole. An Aho-Corasick automaton finds the
longest piece from each position; going from left to right the longest piece
that is compatible with the last one is taken, else its longest prefix that is
a piece, and if none fits the last piece is taken back. A prefix of the text
has one valid encoding only, so a position without a continuation can be
marked in a bitfield and is never tried again: the work is linear in the text.

Two neighbouring characters that are next to each other in no piece can never
be joined, so a text may be cut between them and the parts encoded alone. Which
cuts are safe is read from the vocabulary. Parts repeat, and a worker keeps
the ids of the common ones in a bounded memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acurail.llm.common import without
from acurail.llm.memory import Memory, groups, spread

#: What stands for a space in pieces.
SPACE = "▁"
#: Words, and compatible or incompatible pairs, that a worker remembers.
MEMORY_WORDS, MEMORY_PAIRS = 300_000, 500_000
#: Bytes of texts whose words are looked up together.
GROUP_BYTES = 1 << 22
_NONE = -1
_NORMAL = 1


class Vocabulary:
    """A merge-type model: pieces, scores, and the tables that encoding by backtracking needs.

    Models with user-defined or unused pieces, a normalisation table, or a
    space as suffix are refused: their encoding is not a pure merge.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        kinds = model.SentencePiece
        odd = [p for p in model.pieces if p.type in (kinds.USER_DEFINED, kinds.UNUSED)]
        if (odd or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces
                or not spec.escape_whitespaces or trainer.model_type != trainer.BPE or not trainer.byte_fallback
                or trainer.treat_whitespace_as_suffix):
            raise ValueError(f"{path} is not a plain merge-type model with byte fallback")
        self.text = [p.piece for p in model.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        alphabet = set("".join(self.id_of))
        for c in sorted(alphabet - self.id_of.keys()):  # characters that stand in longer pieces only
            self.id_of[c] = len(self.text)
            self.text.append(c)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: Longest proper prefix of a piece that is a piece.
        self.shorter = {i: next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), _NONE)
                        for p, i in self.id_of.items()}
        self.parts = self._cutter(alphabet)
        self.pairs = Memory(self._compatible, MEMORY_PAIRS)
        self.first = Memory(lambda i: self.merged(self.text[i]) == [self.text[i]], MEMORY_PAIRS)
        self.length = [len(p) for p in self.text]
        #: What a piece adds to a text's ids: itself, or the bytes of a character that has no piece.
        self.raw = [np.array([i] if self.text[i] in self.score else [self.bytes[b] for b in self.text[i].encode()],
                             dtype="<u4").tobytes() if i in self.shorter else b"" for i in range(len(self.text))]
        self.memory = Memory(self._part_ids, MEMORY_WORDS)

    def _cutter(self, alphabet: set[str]) -> re.Pattern:
        """Pattern of the parts of a text. Every cut lies between characters that no piece holds side by side."""
        inside = {(a, b) for p in self.id_of for a, b in zip(p, p[1:])}
        letters = {c for c in alphabet if c.isalpha()}
        joined = {b for a, b in inside if a in letters}
        marks = sorted(alphabet - letters - joined - {SPACE})
        #: Characters that no piece holds behind a letter.
        self.marks = "".join(marks)
        known = "".join(re.escape(c) for c in sorted(alphabet - {SPACE}))
        #: Whether a piece holds a space behind another character, so that texts cannot be cut at spaces.
        self.before_space = any(b == SPACE and a != SPACE for a, b in inside)
        if self.before_space:
            return re.compile(f"[{known}{SPACE}]+|.", re.DOTALL)
        word = f"{SPACE}*[{''.join(re.escape(c) for c in sorted(letters))}]++(?=[{''.join(map(re.escape, marks))}])|"
        return re.compile(f"{word if letters and marks else ''}{SPACE}*[{known}]+|{SPACE}+|.", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives for a short text."""
        symbols = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def _compatible(self, pair: int) -> bool:
        left, right = divmod(pair, len(self.text))
        a, b = self.text[left], self.text[right]
        return self.merged(a + b) == [a, b]

    def _part_ids(self, part: str) -> bytes:
        """Ids of a part, or of the parts that it can be cut into, as little-endian 32-bit numbers."""
        parts = self.parts.findall(part)
        if len(parts) > 1:
            return b"".join(map(self.memory.__getitem__, parts))
        if len(part) == 1 and part not in self.id_of:
            return np.array([self.bytes[b] for b in part.encode("utf-8", "surrogatepass")], dtype="<u4").tobytes()
        return b"".join(map(self.raw.__getitem__, self.backtrack(part)))

    def _words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words with the space in front of them; marks at the end are looked up on their own."""
        known, marks = self.memory, self.marks
        cores = [w.rstrip(marks) for w in words]
        found = [known[SPACE + c] for c in cores]
        for i, (w, c) in enumerate(zip(words, cores)):
            if len(w) > len(c):
                if c and c[-1].isalpha():
                    found[i] += known[w[len(c):]]
                else:
                    found[i] = known[SPACE + w]
        return found

    def backtrack(self, part: str) -> list[int]:
        """Pieces of a part all whose characters stand in some piece."""
        n, size = len(part), len(self.text)
        longest = [0] * n
        for end, (i, width) in self.automaton.iter(part):
            longest[end + 1 - width] = i  # ends come in rising order, so the longest stays
        length, shorter, pairs, first = self.length, self.shorter, self.pairs, self.first
        failed = None  # bitfield of the positions without a continuation, from the first dead end on
        taken: list[int] = []
        at, last, token = 0, _NONE, longest[0]
        while True:
            while token != _NONE:
                end = at + length[token]
                if (failed is None or not failed[end >> 3] >> (end & 7) & 1) and (
                        pairs[last * size + token] if last != _NONE else first[token]):
                    break
                token = shorter[token]
            if token != _NONE:
                taken.append(token)
                if end == n:
                    return taken
                at, last = end, token
                token = longest[at]
            else:
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                taken.pop()  # single characters always merge to themselves, so there is one
                at -= length[last]
                token = shorter[last]
                last = taken[-1] if taken else _NONE

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, without begin and end ids."""
        parts = self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join(map(self.memory.__getitem__, parts)), dtype="<u4")

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each); no text is null.

        Where single spaces part the words, a word with the space in front is
        encoded alone, once a batch. Other texts are cut one by one.
        """
        odd = pc.or_(pc.match_substring_regex(texts, "^$|^ | $|  "), pc.match_substring(texts, SPACE)).to_numpy(
            zero_copy_only=False)
        if self.before_space or odd.all():
            found = [self.ids(t.as_py()) for t in texts]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(f) for f in found], dtype=np.int64)
        flat, plain = spread(pc.split_pattern(texts.filter(pa.array(~odd)), " "), self._words_ids)
        if not odd.any():
            return flat, plain
        found = iter(np.split(flat, np.cumsum(plain)[:-1]))
        each = [self.ids(t.as_py()) if o else next(found) for t, o in zip(texts, odd)]
        return np.concatenate(each), np.array([len(f) for f in each], dtype=np.int64)

    def decode(self, ids: list[int]) -> str:
        """The library's text of ``ids``."""
        return self.processor.decode(ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary; its memory outlives a task."""
    return Vocabulary(path)


RESULT = ["ids", "decoded"]


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) of the whole text and ``decoded``, the text that these ids give.

    A null or empty text has no ids and decodes to an empty text. Texts of any
    length are encoded whole, in time linear in their length. Repeated rows are
    encoded alike, each on its own. An empty table gives an empty table. Other
    columns are kept and not read; those named like a result column are
    replaced. No shuffle. ``model_path`` must be readable by every executor.
    """
    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encoded(texts: pa.Array) -> pa.Array:
        model = vocabulary(model_path)
        flat, offsets, decoded = [pa.array([], pa.int32())], [np.zeros(1, dtype=np.int32)], []
        for group in groups(texts, GROUP_BYTES):
            ids, sizes = model.batch(group)
            ends = np.cumsum(sizes)
            flat.append(pa.array(ids.astype(np.int32)))
            offsets.append((ends + offsets[-1][-1]).astype(np.int32))
            values = ids.tolist()
            decoded += [model.decode(values[a:b]) if a < b else "" for a, b in zip(ends - sizes, ends)]
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets)), pa.concat_arrays(flat))
        return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], names=RESULT)

    d = without(docs, *RESULT)
    row = F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("row")
    return (docs.select(row, encoded.asNondeterministic()(F.col(f"`{text}`").cast("string")).alias("r"))
            .select("row.*", "r.ids", "r.decoded"))
