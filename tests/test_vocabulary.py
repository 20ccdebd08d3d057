"""Vocabulary fit against a plain count of all grams, with rare and with many frequent words."""

import math
from collections import Counter

from acurail.operators.preprocess import fit_tfidf


def test_vocabulary_equals_plain_count(spark):
    texts = [" ".join("abcdefghij"[(i * j + i) % (3 + j % 7)] * 2 for j in range(1, 14)) for i in range(40)] + [None, "café bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    cf, seen = Counter(), Counter()
    for t in texts:
        w = (t or "").replace("é", "e").split()
        g = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        cf.update(g)
        seen.update(set(g))
    for size, least in ((2, 2), (3, 2), (3, 41), (50, 1), (0, 1)):
        want = sorted((t for t in cf if seen[t] >= least), key=lambda t: (-cf[t], t))[:size]
        got = {r["term"]: r["idf"] for r in fit_tfidf(df, max_features=size, min_df=least).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(got[t], math.log((1 + len(texts)) / (1 + seen[t])) + 1) for t in want)
