"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled texts, never confirmed
clean ones. The risk is ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``
with the class prior taken from the labelled fold; when the corrected negative
part falls below zero its gradient is reversed (Kiryo et al., 2017). Features
are whole words and word beginnings that confirmed toxic texts share.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acurail.llm.common import crc_bucket, labelled_ids, staged, without

MODULUS, HELD_OUT = 4, 2
#: Most confirmed toxic and most unlabelled texts that a classifier is trained on.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 12_000
#: Labelled rows that the class prior is estimated from.
MAX_PRIOR_ROWS = 50_000
#: Confirmed toxic texts that a feature must be in: one of a single text tells nothing of others.
MIN_POSITIVE = 2
THRESHOLD = 0.3
_TRIM = string.punctuation + "¡¿«»„“”‘’…–—"
_PREFIXES = (4, 5, 6)
_BLOCK = 1 << 20


def word_features(word: str) -> list[str]:
    """A lower-cased, trimmed word and its beginnings of 4 to 6 characters (marked with ``-``)."""
    return [word, *[word[:n] + "-" for n in _PREFIXES if len(word) >= n]]


def words_of(text: str | None) -> set[str]:
    """Distinct words of the whole text, lower-cased, punctuation trimmed from their ends."""
    found = {w.strip(_TRIM) for w in set((text or "").lower().split())}
    found.discard("")
    return found


def features_of(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in word_features(w)}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """text -> probability; remembers which features each word has, in a bounded memory."""
        memory: dict[str, tuple[int, ...]] = {}
        number = {f: i for i, f in enumerate(self.weights)}
        weights, bias = list(self.weights.values()), self.bias

        def known(word: str) -> tuple[int, ...]:
            hits = memory.get(word)
            if hits is None:
                if len(memory) >= 200_000:
                    memory.clear()
                hits = memory[word] = tuple(number[f] for f in word_features(word) if f in number)
            return hits

        def score(text: str | None) -> float:
            hits = {i for w in words_of(text) for i in known(w)}
            z = bias + math.fsum(weights[i] for i in hits)
            return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))

        return score


@dataclass(frozen=True)
class Hits:
    """Sparse binary rows: ``feature`` holds the features of all rows in turn, ``row`` the row of each."""

    row: np.ndarray
    feature: np.ndarray
    rows: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.row, self.feature, w, self.rows)

    def transposed_dot(self, g: np.ndarray, features: int) -> np.ndarray:
        return self._sums(self.feature, self.row, g, features)

    @staticmethod
    def _sums(to: np.ndarray, of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Block by block: the driver holds millions of hits, and wide copies of a block only."""
        out = np.zeros(size)
        for at in range(0, len(to), _BLOCK):
            out += np.bincount(to[at:at + _BLOCK], weights=values[of[at:at + _BLOCK]], minlength=size)
        return out


def evidence(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Value, up to 1, of features that ``found`` positives have where the mixture lets ``expected`` of them.

    It is 1 from twice the rate of the mixture and 4 standard deviations on
    and falls with the squares of both, so that the ridge weighs more on
    features that may be there by chance. None is left out.
    """
    beyond_chance = np.clip((found - expected) / np.sqrt(expected + 1) / 4, 0, 1)
    more_often = np.clip(found / np.maximum(expected, 1e-9) - 1, 0, 1)
    return (beyond_chance * more_often) ** 2


def train_nnpu(p: Hits, u: Hits, features: int, prior: float, rounds: int = 400, rate: float = 0.05,
               ridge: float = 2e-4, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Linear weights and bias minimising the non-negative PU risk of the logistic loss (Adam, full batch).

    ``p`` are the confirmed positives, ``u`` the unlabelled rows; ``scale`` is
    the value of each feature where a row has it (1 if it is not given).
    """
    scale = np.ones(features) if scale is None else scale
    w, b = np.zeros(features), math.log(prior / (1 - prior))
    m, v = np.zeros(features + 1), np.zeros(features + 1)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))

    for t in range(1, rounds + 1):
        zp, zu = p.dot(w * scale) + b, u.dot(w * scale) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_pos = -prior * (1 - sp) / p.rows  # d/dz of prior * loss(z, +1)
        gp_neg, gu_neg = -prior * sp / p.rows, su / u.rows
        if negative_risk < 0:  # undo over-fitting of the negative part only
            gp, gu = -gp_neg, -gu_neg
        else:
            gp, gu = gp_pos + gp_neg, gu_neg
        g = np.append(scale * (p.transposed_dot(gp, features) + u.transposed_dot(gu, features)) + ridge * w,
                      gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Train on a bounded sample outside the held-out fold.

    The samples are the documents of the smallest hashed ids. Every feature of
    at least ``MIN_POSITIVE`` confirmed texts that unlabelled texts do not have
    more often is weighed. Without a labelled toxic text the model is constant
    and scores every text 0; without a telling feature it scores the labelled
    share of toxic texts, so where labels have nothing to do with texts and
    mark 30 % or more of them, every text reaches the threshold. Rows without
    id or label do not count; repeated ids count once as a label; null and
    empty texts have no feature; equal hashes go to the smaller id.
    """
    known = labelled_ids(labels, "toxic", MODULUS, HELD_OUT, MAX_PRIOR_ROWS)
    seen = known.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    if not seen["p"]:
        return Model({}, -500.0)
    prior = min(0.9, max(1e-4, seen["p"] / seen["n"]))
    confirmed = (labelled_ids(labels.filter(F.col("toxic") == 1), "toxic", MODULUS, HELD_OUT, max_positive)
                 .select("doc_id", F.lit(True).alias("positive")))
    anything = (docs.select("doc_id").filter(F.col("doc_id").isNotNull()
                                             & (crc_bucket(F.col("doc_id"), MODULUS) != HELD_OUT))
                .orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(max_unlabelled)
                .distinct().select("doc_id", F.lit(False).alias("positive")))

    @F.arrow_udf("array<string>")
    def distinct_features(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())  # texts have thousands of features, so few are held as Python objects at a time
        return pa.concat_arrays([pa.array([], kind), *[
            pa.array([sorted(features_of(x.as_py())) for x in values.slice(at, 50)], kind)
            for at in range(0, len(values), 50)]])

    ids = confirmed.unionByName(anything)  # bounded by max_positive + max_unlabelled
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "doc_id", "positive", distinct_features.asNondeterministic()(F.col("text")).alias("fs")), "toxicity-sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    base = Model({}, math.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return base
    # Features that positives share and that the mixture does not have more often; training weighs them all.
    features = sample.select("doc_id", "positive", F.explode("fs").alias("f"))
    shared = (features.filter("positive").groupBy("f").agg(F.count("*").alias("p"))
              .filter(F.col("p") >= MIN_POSITIVE))
    mixed = (features.filter(~F.col("positive")).join(shared.select("f"), "f", "left_semi")
             .groupBy("f").agg(F.count("*").alias("u")))
    told = shared.join(mixed, "f", "left").select("f", "p", F.coalesce("u", F.lit(0)).alias("u"))
    told = told.filter(F.col("p") * n_u >= F.col("u") * n_p).toPandas().sort_values("f")
    names = told["f"].tolist()
    if not names:
        return base
    scale = evidence(told["p"].to_numpy(float), told["u"].to_numpy(float) * (n_p / n_u))
    numbered = docs.sparkSession.createDataFrame(list(enumerate(names)), "i int, f string")
    hits = staged(features.join(F.broadcast(numbered), "f").groupBy("positive", "doc_id")
                  .agg(F.sort_array(F.collect_set("i")).alias("i")), "toxicity-hits")

    def rows(positive: bool, n: int) -> Hits:
        part = hits.filter(F.col("positive") == positive).orderBy("doc_id").select("i").toArrow()["i"].combine_chunks()
        row = np.repeat(np.arange(len(part), dtype=np.int32), part.value_lengths().to_numpy())
        return Hits(row, part.flatten().to_numpy(), n)

    w, bias = train_nnpu(rows(True, n_p), rows(False, n_u), len(names), prior, scale=scale)
    return Model({f: float(x) for f, x in zip(names, w)}, bias)


RESULT = ["score", "predicted"]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= threshold``).

    Only the text is read, whole whatever its length. Null and empty texts get
    the model's base rate; repeated rows are scored alike; a score equal to the
    threshold is predicted 1; an empty table gives an empty table.
    Input columns named like a result column are replaced. A narrow map: no
    shuffle, bounded memory.
    """
    scorers: list = []  # one a task: the words it remembers serve all of the task's batches

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(model.scorer())
        return pa.array([scorers[0](x.as_py()) for x in texts], pa.float64())

    d = without(docs, *RESULT)
    row = F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("row")
    return (docs.select(row, toxic.asNondeterministic()(F.col("text")).alias("score"))
            .select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
