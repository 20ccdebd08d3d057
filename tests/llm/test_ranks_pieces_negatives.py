"""Importance resampling and radix ranks, piece encoding, hard negatives, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from acurail.llm import hard_negatives, importance, pieces, radix
from acurail.llm.memory import Memory, groups
from acurail.llm.queries import piece_model
from tests.llm.edge import edge_docs, no_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- importance resampling
def plain_runs(text):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return sorted(runs), len(w)


def odd_texts():
    rng = random.Random(2)
    texts = ["", None, "one", "a b", "A b C d", "é ü ÀB", "x" * 1000 + " y " + "z" * 70 + " q", "\0\0a\0b", "--",
             "a" * 63 + " b", "a " + "b" * 64 + " c", "日本 語", " ".join("w" * rng.randrange(1, 200) for _ in range(300))]
    return texts + ["".join(rng.choice("abcXYZ019 .,-\né日") for _ in range(rng.randrange(0, 80))) for _ in range(500)]


@pytest.mark.parametrize("block,stretch", [(1 << 20, 100_000), (50, 7)])
def test_run_hashes_against_crc32(monkeypatch, block, stretch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    monkeypatch.setattr(importance, "STRETCH_WORDS", stretch)
    texts = odd_texts()
    runs, n_words = defaultdict(list), np.zeros(len(texts), dtype=int)
    for crc, row, words in importance._blocks(texts):
        n_words += words
        for c, r in zip(crc.tolist(), row.tolist()):
            runs[r].append(c)
    for i, t in enumerate(texts):
        assert (sorted(runs[i]), n_words[i]) == plain_runs(t)


def plain_resample(docs, target, min_words, share):
    runs = [plain_runs(t) for _, t in docs]
    count = [Counter(), Counter()]
    for r, _ in runs:
        count[0].update(x % 10000 for x in r)
    for t in target:
        count[1].update(x % 10000 for x in plain_runs(t)[0])
    big = [sum(c.values()) for c in count]
    gain = [math.floor(1000 * math.log((count[1][b] + 1) * (big[0] + 10000) / ((count[0][b] + 1) * (big[1] + 10000))))
            for b in range(10000)]
    out = []
    for (i, _), (r, n) in zip(docs, runs):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % 10000] for x in r)
        out.append([i, n, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    many = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = len(many) * share[0] // share[1]
    return sorted(map(str, [tuple(r) + (k + 1 if k < drawn else None,) for k, r in enumerate(many)]
                      + [tuple(r) + (None,) for r in out if r[1] < min_words]))


def test_resample_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, rank int, place string")
    target = [t for _, t in rows[:9]] + ["", None, "other words"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, bench, share=(30, 100)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_resample(rows, target, 20, (30, 100))
    awkward = edge_docs(spark)
    known = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = importance.resample(awkward, bench, share=(50, 100)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_resample(known, target, 20, (50, 100))
    assert importance.resample(no_docs(spark), bench).count() == 0
    assert importance.resample(docs, bench.limit(0)).filter("rank IS NOT NULL").count() > 0


@pytest.mark.parametrize("kind", ["spread", "hot", "equal", "wide"])
def test_radix_ranks(spark, kind):
    """One key on a third of all rows, all rows alike, and keys over the whole range of bigint."""
    rng = random.Random(4)
    draw = {"spread": lambda: rng.randrange(-5000, 5000), "hot": lambda: rng.choice([7, 7, rng.randrange(300)]),
            "equal": lambda: 5, "wide": lambda: rng.randrange(-(1 << 63), 1 << 63)}[kind]
    rows = [(draw(), draw(), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint, i bigint").repartition(5)
    out = radix.ranked(frame, [radix.descending(F.col("a")), radix.ascending(F.col("b"))], digit_bits=9,
                       chunk_rows=200).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 3001)) and sorted(r["i"] for r in out) == list(range(3000))
    in_order = sorted(out, key=lambda r: r["rank"])
    assert [(-r["a"], r["b"]) for r in in_order] == sorted((-a, b) for a, b, _ in rows)
    again = radix.ranked(frame.limit(0), [radix.ascending(F.col("a"))])
    assert again.columns == ["a", "b", "i", "rank"] and again.count() == 0


def test_stable_ranks_keep_the_order_of_equal_digits():
    start = np.array([0, 10, 20], dtype=np.int64)
    assert radix.stable_ranks(np.array([1, 0, 1, 2, 1]), start).tolist() == [10, 0, 11, 20, 12]
    assert start.tolist() == [1, 13, 21] and radix.stable_ranks(np.zeros(0, dtype=np.int64), start).tolist() == []


# ---------------------------------------------------------------- piece encoding
@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_encoding_equals_the_library(library):
    v = pieces.vocabulary(piece_model())
    rng = random.Random(5)
    known = sorted(v.id_of)
    letters = "".join(sorted({c for p in known for c in p}))
    texts = ["", " ", "  a", "a\0b", "\n", "▁x", "a ▁b", "<s>", "<0x0A>", "x⁇ y", "�", "hello world  ", " " * 1000,
             "a" * 5000, "ab" * 3000, "The   quick,brown (fox) 12345 " * 20, "🔴😤 日本語 한국어 ไทย", "▁" * 77, "x" + " " * 33]
    for i in range(6000):
        n = rng.randrange(1, 30)
        texts.append("".join([
            lambda: rng.choice(known), lambda: rng.choice(letters), lambda: rng.choice("abcdeinrst "),
            lambda: rng.choice(" \n\t.,a▁é"),
            lambda: chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x11000)])),
        ][i % 5]() for _ in range(n)))
    for t in texts:
        assert v.ids(t).tolist() == library.encode(t), repr(t)
        assert v.decode(v.ids(t).tolist()) == library.decode(library.encode(t))
    for some in (texts, [t for t in texts if re.fullmatch(r"([^ ▁]+ )*[^ ▁]+", t)], ["", "  "], [None, "a b"]):
        flat, sizes = v.batch(next(groups(pa.array(some, pa.string()), 1 << 30)))
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [library.encode(t or "") for t in some]


def test_backtracking_takes_pieces_back_and_marks_dead_ends(library):
    """Texts on which the longest pieces are wrong; a part without a safe cut stays linear."""
    v = pieces.Vocabulary(piece_model())
    wrong = 0
    rng = random.Random(6)
    for _ in range(3000):
        part = "▁" + "".join(rng.choice("etaoinsrh") for _ in range(rng.randrange(3, 25)))
        longest, at = [], 0
        while at < len(part):
            piece = next(part[at:e] for e in range(len(part), at, -1) if part[at:e] in v.id_of)
            longest.append(v.id_of[piece])
            at += len(piece)
        assert v.backtrack(part) == library.encode(part[1:])
        wrong += v.backtrack(part) != longest
    assert wrong > 100
    long = "".join(rng.choice("etaoinsrh") for _ in range(200_000))
    assert v.ids(long).tolist() == library.encode(long)


def test_piece_query_columns_on_awkward_rows(spark, library):
    docs = edge_docs(spark).withColumn("ids", F.lit(3))
    out = pieces.encode(docs, piece_model()).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == (library.decode(ids) if ids else "") and r["row"] == "x"
    assert pieces.encode(no_docs(spark), piece_model()).count() == 0


def test_groups_of_texts():
    texts = pa.array(["ab", None, "c" * 9, "", "d", "e"])
    assert [g.to_pylist() for g in groups(texts, 3)] == [["ab", ""], ["c" * 9], ["", "d", "e"]]
    assert list(groups(texts.slice(0, 0), 3)) == []


def test_memory_forgets_the_oldest_generation():
    asked = []
    m = Memory(lambda k: asked.append(k) or k * 2, size=3, longest=4)
    assert [m[k] for k in ("a", "b", "c", "a", "d", "a", "toolong", "toolong")] == [
        "aa", "bb", "cc", "aa", "dd", "aa", "toolongtoolong", "toolongtoolong"]
    assert asked == ["a", "b", "c", "d", "toolong", "toolong"] and len(m) + len(m.old) <= 6


# ---------------------------------------------------------------- hard negatives
def plain_mine(rows):
    v = [(i, lab, [math.floor(256 * x) for x in e]) for i, e, lab in rows
         if None not in (i, e, lab) and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a in sorted({i for i, _, _ in v if i % 50 == 0}):
        lab, w = min((lab, w) for i, lab, w in v if i == a)
        scored = sorted((-sum(x * y for x, y in zip(w, e)), i, other == lab) for i, other, e in v if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            fits = [(s, i) for s, i, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "ragged", "copies", "zero", "large"])
def test_hard_negatives_against_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(700):
        v = rng.normal(size=12) + 0.4
        if kind == "ragged":
            v = v[:rng.integers(0, 13)]
        if kind == "copies" and i % 3 == 0:
            v = np.ones(12)
        if kind == "zero" and i % 2:
            v = np.zeros(12)
        if kind == "large":
            v = v * 1e6
        rows.append((i, v.tolist(), int(rng.integers(0, 4))))
    rows += [(900, None, 1), (901, [None] * 12, 1), (950, [float("nan")] * 12, 1), (951, [1.0] * 12, None),
             (None, [1.0] * 12, 1), (50, [0.5] * 12, 9), (3, rows[3][1], rows[3][2])]
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 37)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                  "vec_id bigint, embedding array<double>, label int, rank int, w string, own int")
    got = sorted(tuple(r) for r in hard_negatives.mine(frame).collect())
    assert got == plain_mine(rows) and (got or kind == "zero")
    assert hard_negatives.mine(frame.limit(0)).count() == 0


def test_windows_of_negative_and_zero_scores():
    assert hard_negatives.window(100) == (50, 95) and hard_negatives.window(0) == (0, 0)
    low, high = hard_negatives.window(-100)
    assert low > high
    assert hard_negatives.window(7) == (4, 6)
