"""Small tables with every awkward case that the operators define a result for."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, score double, label int, row string, st string"


def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, columns that clash with result and helper names."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    long_text = ". ".join(" ".join(words[i:i + 12]) for i in range(0, len(words), 12))
    plain = [" ".join(f"word{rng.randrange(400)}" for _ in range(60)) + "." for _ in range(20)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(plain)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n", None, "s1"), (103, long_text, "en", "s0"),
             (104, plain[0], "de", "s1"), (105, plain[0], "de", None), (1, plain[1], "en", "s1"), (1, plain[1], "en", "s1"),
             (None, plain[2], "en", "s2"), (None, None, None, None), (106, "...", "en", "s0"),
             (107, "<|endoftext|> STRASSE ẞ İ é", "de", "s2")]
    return spark.createDataFrame([(*r, 0.5, 1, "x", "y") for r in rows], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")
