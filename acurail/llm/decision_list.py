"""Quality rules by learned decision lists.

Sequential covering: a rule is grown condition by condition on one part of
the labelled statistics, pruned from its end on the other part, kept if it is
precise there, and the rows it covers are removed before the next rule. Rows
whose rule was not precise grow no further rule. It ends when no bad row is
left to grow from. The list becomes one ordered Spark ``CASE`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.llm import textstats
from acurail.llm.common import labelled_ids, without

#: Most labelled rows that a list is learned from.
MAX_LABELLED = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Condition:
    """``name <= cut`` or ``name > cut``."""

    name: str
    above: bool
    cut: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.name] > self.cut if self.above else rows[self.name] <= self.cut

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.name] > F.lit(self.cut) if self.above else columns[self.name] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, dtype=bool)
    for c in rule:
        mask &= c.holds(rows)
    return mask


def _cuts(values: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring distinct values."""
    distinct = np.unique(values)
    return (distinct[1:] + distinct[:-1]) / 2


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the condition of the largest information gain (FOIL) until no good row is covered."""
    rule: Rule = ()
    mask = np.ones(len(bad), dtype=bool)
    while (mask & ~bad).any():
        p0, n0 = int((mask & bad).sum()), int((mask & ~bad).sum())
        best, best_gain = None, 1e-9
        for name, points in cuts.items():
            values = rows[name][mask]
            hit = bad[mask]
            order = np.argsort(values, kind="stable")
            ps = np.concatenate([[0], np.cumsum(hit[order])])
            at = np.searchsorted(values[order], points, side="right")
            for above in (False, True):
                p = p0 - ps[at] if above else ps[at]
                t = len(values) - at if above else at
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(t, 1)) - np.log2(p0 / (p0 + n0))), 0)
                if len(gain) and gain.max() > best_gain:
                    best, best_gain = Condition(name, above, float(points[int(gain.argmax())])), float(gain.max())
        if best is None:
            break
        rule += (best,)
        mask &= best.holds(rows)
    return rule


def _worth(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> float:
    mask = _covered(rule, rows, len(bad))
    p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_cover: int = 5,
          min_share: float = 0.005) -> list[Rule]:
    """Ordered rules for ``bad`` rows; an empty list if none is precise enough.

    Two thirds of the rows grow a rule, the rest prunes and judges it: of the
    held rows that it covers, ``min_precision`` must be bad. It must also cover
    ``min_cover`` bad rows and the share ``min_share`` of them, grown ones
    included, which bounds the list at ``1 / min_share`` rules. The split is by
    position, so equal input gives an equal list.
    """
    rules: list[Rule] = []
    left, open_ = np.ones(len(bad), dtype=bool), np.ones(len(bad), dtype=bool)
    prune_part = np.arange(len(bad)) % 3 == 2
    least = max(min_cover, min_share * int(bad.sum()))
    while (left & open_ & bad & ~prune_part).any():
        grow, prune = left & open_ & ~prune_part, left & prune_part
        part = {k: v[grow] for k, v in rows.items()}
        rule = _grow(part, bad[grow], {k: _cuts(v) for k, v in part.items()})
        if not rule:
            break
        held = {k: v[prune] for k, v in rows.items()}
        shorter = [rule[:i] for i in range(len(rule), 0, -1)]
        rule = max(shorter, key=lambda r: _worth(r, held, bad[prune]))  # the longest of equals
        mask = _covered(rule, rows, len(bad)) & left
        p, n = int((mask & prune_part & bad).sum()), int((mask & prune_part & ~bad).sum())
        if p and p >= min_precision * (p + n) and int((mask & bad).sum()) >= least:
            rules.append(rule)
            left &= ~mask
        else:
            open_ &= ~mask
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, rule text) as ordered conditional expressions: the first rule that fits rejects, else the row is kept."""
    kept, fired = F, F
    for rule in rules:
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column(columns)
        kept = kept.when(fits, F.lit(False))
        fired = fired.when(fits, F.lit(" AND ".join(map(str, rule))))
    if not rules:
        return F.lit(True), F.lit(None).cast("string")
    return kept.otherwise(F.lit(True)), fired.otherwise(F.lit(None).cast("string"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn a list from ``labels.quality`` (0 is bad) and the texts of at most ``max_labelled`` labelled documents.

    Only their statistics (a few numbers a row) reach the driver. Without
    labelled rows the list is empty. Repeated ids count as often as they occur.
    """
    # The fold of modulus 1 has remainder 0 only, so no labelled row is held out here.
    sample = labelled_ids(labels, "quality", 1, -1, max_labelled)
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select("doc_id", "label", textstats.text_stats(F.col("text")).alias("st")))
    pdf = rows.select("doc_id", "label", *[v.alias(k) for k, v in textstats.ratios("st").items()]).toPandas()
    # Rows in hash order, so that the split into grow and prune parts does not follow the ids.
    pdf = pdf.sort_values(["doc_id", "words"], kind="stable").sample(frac=1.0, random_state=7)
    names = list(textstats.ratios("st"))
    return learn({k: pdf[k].to_numpy(dtype=float) for k in names}, (pdf["label"] == 0).to_numpy())


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fired_rule"]


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with its base counts, ``base_failed``, ``kept`` and ``fired_rule``.

    Null and empty texts have zero words, so they fail the base rule; texts of
    any length are counted whole; repeated rows are judged alike; a statistic
    equal to a cut is not above it; an empty table gives an empty table. Input
    columns named like a result column are replaced. A narrow projection: no
    shuffle, rows independent of each other.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in without(docs, *RESULT).columns]).alias("row"),
                    textstats.text_stats(F.col("text")).alias("st"))
    kept, fired = verdict(rules, textstats.ratios("st"))
    failed = ((F.col("st.n_words") < MIN_WORDS)
              | (100 * F.col("st.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("st.n_words")))
    return d.select("row.*", *[F.col(f"st.{c}").alias(c) for c in RESULT[:5]], failed.alias("base_failed"),
                    F.when(failed, F.lit(False)).otherwise(kept).alias("kept"), fired.alias("fired_rule"))
