"""Text statistics, decision lists and the rule ensemble."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from acurail.llm import decision_list, rule_ensemble, textstats
from acurail.llm.textstats import text_counts
from tests.llm.edge import edge_docs, labels, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) by the letter of the contract."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def random_text(rng):
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 50]))] + ["é$", "\x1cq", " ", "a|b", "\x85"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " ", "\n\n", "\x0b"])
                   for _ in range(rng.randrange(90)))


def test_counts_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", " ", "a " * 9, "a " * 8] + [random_text(rng) for _ in range(150)]
    for t in texts:
        assert text_counts(t)[:5] == brute(t), t


def test_repeats_across_a_whole_long_text():
    words = [f"u{i}" for i in range(40_000)]
    words[39_000:39_010] = words[5:15]
    assert text_counts(" ".join(words))[4] == 20


def test_decision_list_learns_and_prunes():
    rng = np.random.default_rng(0)
    x = {"a": rng.uniform(size=3000), "b": rng.uniform(size=3000), "noise": rng.uniform(size=3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = decision_list.learn(x, bad)
    covered = np.zeros(3000, dtype=bool)
    for r in rules:
        mask = np.ones(3000, dtype=bool)
        for c in r:
            mask &= c.holds(x)
        covered |= mask
    assert (covered == bad).mean() > 0.98
    assert decision_list.learn(x, np.zeros(3000, dtype=bool)) == []


def test_decision_list_query_edges(spark):
    docs = edge_docs(spark)
    rules = [(decision_list.Condition("symbol_share", True, 0.5),)]
    out = decision_list.judge(docs, rules).collect()
    assert len(out) == docs.count()
    for r in out:
        expected = brute(r["text"]) if r["doc_id"] != 103 else None
        if expected:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["kept"] == (not r["base_failed"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["row"] == "x" and r["st"] == "y"
    assert decision_list.judge(no_docs(spark), []).count() == 0
    assert decision_list.fit(docs, labels(spark, [])) == []
    assert decision_list.fit(docs, labels(spark, [(None, 0, 0, ""), (3, None, 1, "")])) == []


@pytest.fixture(scope="module")
def judged(spark):
    """500 documents, every fourth full of symbols and labelled bad."""
    rng = random.Random(8)
    rows = []
    for i in range(500):
        mark = "$$" if i % 4 == 0 else ""
        rows.append((i, " ".join(f"word{rng.randrange(900)}{mark}" for _ in range(rng.randrange(30, 90)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, labels(spark, [(i, int(i % 4 != 0), 0, "") for i in range(500)] + [(None, 1, 1, ""), (7, None, 0, "")])


def test_decision_list_separates_the_sample(judged):
    docs, marks = judged
    rules = decision_list.fit(docs, marks)
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in decision_list.judge(docs, rules).collect())


def test_rule_ensemble_on_held_out_rows(spark, judged):
    docs, marks = judged
    model = rule_ensemble.fit(docs, marks)
    assert model.rules and len(model.rules) < rule_ensemble.MAX_RULES
    out = rule_ensemble.score(docs, model).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 100 and all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held)
    edge = rule_ensemble.score(edge_docs(spark), model).collect()
    assert len(edge) == 32 and all(0 <= r["score"] <= 1 and r["row"] == "x" for r in edge)
    assert rule_ensemble.score(no_docs(spark), model).count() == 0


def test_rule_ensemble_ignores_held_out_labels(spark, judged):
    docs, marks = judged
    flipped = marks.selectExpr("doc_id", "IF(crc32(cast(doc_id AS string)) % 3 = 1, 1 - quality, quality) AS quality",
                               "toxic", "text")
    assert rule_ensemble.fit(docs, flipped) == rule_ensemble.fit(docs, marks)


def test_rule_ensemble_without_two_labels(spark):
    docs = edge_docs(spark)
    constant = rule_ensemble.fit(docs, labels(spark, [(i, 0, 0, "") for i in range(20)]))
    assert {r["predicted"] for r in rule_ensemble.score(docs, constant).collect()} == {0}
    assert {r["predicted"] for r in rule_ensemble.score(docs, rule_ensemble.fit(docs, labels(spark, []))).collect()} == {1}


def test_rule_ensemble_weighs_every_path(judged, monkeypatch):
    """A path that sorts behind a hundred useless ones still gets its weight."""
    docs, marks = judged
    t = rule_ensemble.Test
    useless = {(t("adjacent_share", True, 2.0 + i),) for i in range(100)}
    telling = (t("symbol_share", True, 1e-6), t("words", True, 0.0))
    monkeypatch.setattr(rule_ensemble, "tree_rules", lambda *_: useless | {telling})
    assert [r for r, _ in rule_ensemble.fit(docs, marks).rules] == [telling]


def test_tree_rules_cover_every_path():
    text = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 0 <= 0.2)
    Predict: 0.0
   Else (feature 0 > 0.2)
    Predict: 1.0
  Else (feature 0 > 0.5)
   Predict: 1.0
"""
    rules = rule_ensemble.tree_rules(text, ["x"])
    t = rule_ensemble.Test
    assert rules == {(t("x", False, 0.5),), (t("x", False, 0.2),), (t("x", False, 0.5), t("x", True, 0.2)),
                     (t("x", True, 0.5),)}


def test_rule_columns_against_a_plain_evaluation(spark):
    """The compiled expressions of the ensemble and of the list equal a row-by-row evaluation of their rules."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "###", "$$"] if not good else
                            ["some", "plain", "words", "here", "too", "and"]) for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    st = docs.select("doc_id", textstats.text_stats(F.col("text")).alias("st"))
    names = list(textstats.ratios("st"))
    stats = {r["doc_id"]: r for r in st.select("doc_id", *[c.alias(n) for n, c in textstats.ratios("st").items()]).collect()}
    model = rule_ensemble.fit(docs, marks)
    assert model.rules
    for r in rule_ensemble.score(docs, model).collect():
        s = stats[r["doc_id"]]
        z = model.bias + sum(w for rule, w in model.rules if all(
            (s[t.name] > t.cut) if t.above else (s[t.name] <= t.cut) for t in rule))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    rules = decision_list.fit(docs, marks)
    assert rules
    for r in decision_list.judge(docs, rules).collect():
        s = {n: np.array([stats[r["doc_id"]][n]]) for n in names}
        first = next((rule for rule in rules if all(c.holds(s)[0] for c in rule)), None)
        assert r["fired_rule"] == (" AND ".join(map(str, first)) if first else None)
        assert r["kept"] == (first is None and not r["base_failed"])


def test_list_is_judged_on_held_rows_and_goes_on():
    """A rule that is precise only where it was grown is left out, and later rules are still found."""
    rng = np.random.default_rng(3)
    n = 3000
    x, noise = rng.uniform(size=n), rng.uniform(size=n)
    bad = x > 0.8
    bad |= (np.arange(n) % 3 != 2) & (noise > 0.7)  # only grown rows show this
    rules = decision_list.learn({"x": x, "noise": noise}, bad)
    held = np.arange(n) % 3 == 2
    assert rules and any(c.name == "x" for r in rules for c in r)
    for r in rules:
        mask = np.all([c.holds({"x": x, "noise": noise}) for c in r], axis=0)
        assert not any(c.name == "noise" and len(r) == 1 for c in r)
        assert mask[held].sum() > 0
