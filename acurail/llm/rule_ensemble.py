"""Quality classifier as a sparse rule ensemble.

A random forest of shallow trees is fitted on text statistics; every path of
its trees becomes a rule, a conjunction of thresholds. A logistic regression
with an L1 penalty weighs the rules, most get weight zero, and the rest is
compiled into one Spark column expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.llm import textstats
from acurail.llm.common import labelled_ids, staged, without

MODULUS, HELD_OUT = 3, 1
#: Most labelled documents that trees and weights are fitted on.
MAX_LABELLED = 20_000
TREES, DEPTH = 12, 3
#: Paths that so many full trees have together. No rule is left out: the L1 penalty alone drops them.
MAX_RULES = TREES * (2 ** (DEPTH + 1) - 2)
L1 = 0.0005
THRESHOLD = 0.5


@dataclass(frozen=True)
class Test:
    """``name <= cut`` or ``name > cut``."""

    name: str
    above: bool
    cut: float

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.name]
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = tuple[Test, ...]


@dataclass(frozen=True)
class Model:
    """Weighted rules; ``names`` are the statistics they read."""

    rules: list[tuple[Rule, float]]
    bias: float

    def score(self, columns: dict[str, Column]) -> Column:
        """Probability of label 1 as a column expression."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(holds(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: Rule, columns: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [t.column(columns) for t in rule])


_TEST = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(description: str, names: list[str]) -> set[Rule]:
    """Paths of a tree, of every length, from Spark's tree description (``toDebugString``).

    Tests of one statistic on a path are merged into the tightest ones, and
    rules are put in a fixed order, so equal paths of different trees meet.
    """
    rules: set[Rule] = set()
    path: list[tuple[int, Test]] = []
    for line in description.splitlines():
        if m := _TEST.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, Test(names[int(m[2])], m[3] == ">", float(m[4]))))
            tightest: dict[tuple[str, bool], float] = {}
            for _, t in path:
                old = tightest.get((t.name, t.above), t.cut)
                tightest[t.name, t.above] = max(old, t.cut) if t.above else min(old, t.cut)
            rules.add(tuple(Test(n, a, c) for (n, a), c in sorted(tightest.items())))
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from ``labels.quality`` outside the held-out fold.

    Statistics cover whole texts. Trees and weights are fitted by Spark ML on
    the stored statistics of at most ``max_labelled`` documents. With one label
    only (or none) the model is constant: 1 without labels, else that label.
    """
    sample = labelled_ids(labels, "quality", MODULUS, HELD_OUT, max_labelled)
    measured = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
                .select("doc_id", F.col("label").cast("double").alias("label"),
                        textstats.text_stats(F.col("text")).alias("st")))
    columns = textstats.ratios("st")
    names = list(columns)
    rows = staged(measured.select("doc_id", "label", F.array(*columns.values()).alias("x")), "quality-sample")
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(by_label) < 2:
        return Model([], 10.0 if not by_label or max(by_label) > 0 else -10.0)
    # Both labels weigh the same, so that the rare one shapes the trees.
    total = sum(by_label.values())
    weight = reduce(lambda c, kv: c.when(F.col("label") == kv[0], total / (2.0 * kv[1])), by_label.items(), F)
    rows = rows.repartition(8, "doc_id").sortWithinPartitions("doc_id", "x")
    trees = RandomForestClassifier(featuresCol="v", labelCol="label", weightCol="w", numTrees=TREES, maxDepth=DEPTH,
                                   featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=11,
                                   minInstancesPerNode=5)
    vectors = rows.select("label", weight.alias("w"), array_to_vector("x").alias("v")).cache()
    forest = trees.fit(vectors)
    vectors.unpersist()
    rules = sorted(set().union(*[tree_rules(t.toDebugString, names) for t in forest.trees]),
                   key=lambda r: (len(r), [(t.name, t.above, t.cut) for t in r]))
    if not rules:
        return Model([], 10.0 if by_label[1.0] >= by_label[0.0] else -10.0)
    stats = {n: F.col("x")[i] for i, n in enumerate(names)}
    matrix = rows.select("label", array_to_vector(F.array(*[holds(r, stats).cast("double") for r in rules]))
                         .alias("v")).cache()
    lasso = LogisticRegression(featuresCol="v", labelCol="label", elasticNetParam=1.0, regParam=L1, maxIter=60,
                               standardization=False)
    fitted = lasso.fit(matrix)
    matrix.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if abs(w) > 1e-9]
    bias = float(fitted.intercept)
    return Model(weights, bias if math.isfinite(bias) else 0.0)


RESULT = ["score", "predicted"]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= threshold``).

    Only the text is read, whole whatever its length; null and empty texts have
    all statistics zero and are scored by the rules like any other; repeated
    rows are scored alike; a score equal to the threshold is predicted 1; an
    empty table gives an empty table. Input columns named like a result
    column are replaced. A narrow projection: no shuffle.
    """
    d = without(docs, *RESULT)
    row = F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("row")
    return (docs.select(row, textstats.text_stats(F.col("text")).alias("st"))
            .select("row.*", model.score(textstats.ratios("st")).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
