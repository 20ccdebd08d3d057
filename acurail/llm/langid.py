"""Language identification by nearest centroids.

A text becomes a TF-IDF vector of hashed character n-grams (1 to 3), scaled to
length one. Every language is represented by a few centroids (spherical
k-means over a bounded sample), and a text gets the language of the centroid
of the largest cosine. Texts too far from every centroid are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acurail.llm.common import crc_bucket, staged, without

#: Most documents per language that centroids are fitted on.
MAX_PER_LANGUAGE = 1_000
BUCKETS = 1 << 14
CENTROIDS = 4
#: Cosines below this are flagged as rejected, whatever the centroid.
REJECT_BELOW = 0.05
#: Share of its own training texts that a centroid would reject, and the fewest texts that tell it.
REJECT_QUANTILE, REJECT_TEXTS = 0.01, 50
_CHUNK = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams over the whole lower-cased text.

    Runs of characters that are not letters count as one space. Long texts are
    processed in chunks that overlap by two characters.
    """
    counts = np.zeros(BUCKETS, dtype=np.float32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters(points)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first other character after a letter
    points = np.where(letter, points, 32)[kept]
    points = np.concatenate([[32], points]).astype(np.uint32)
    for at in range(0, len(points), _CHUNK):
        part = points[max(0, at - 2):at + _CHUNK]
        skip = min(at, 2)  # n-grams that ended in the chunk before
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(3):
            code = (part if n == 0 else part[n:] + code[:len(part) - n] * np.uint32(0x01000193)) * _MULTIPLIERS[n]
            code ^= code >> np.uint32(15)
            fresh = code[max(0, skip - n):]
            counts += np.bincount(fresh & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def _letter_table() -> np.ndarray:
    table = np.zeros(1 << 16, dtype=bool)
    for i in range(1 << 16):
        table[i] = chr(i).isalpha()
    return table


_TABLE = _letter_table()


def _letters(points: np.ndarray) -> np.ndarray:
    """Letters by Unicode; code points above the basic plane count as letters."""
    return _TABLE[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit TF-IDF vectors (term frequencies damped by a square root)."""
    out = np.empty((len(texts), BUCKETS), dtype=np.float32)
    for i, t in enumerate(texts):
        out[i] = np.sqrt(ngram_counts(t)) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; seeds by farthest-first from the mean, so equal input gives equal centroids."""
    mean = rows.mean(axis=0)
    centroids = [rows[int((rows @ mean).argmax())]]
    while len(centroids) < min(k, len(rows)):
        nearest = (rows @ np.array(centroids).T).max(axis=1)
        centroids.append(rows[int(nearest.argmin())])
    c = np.array(centroids)
    for _ in range(rounds):
        owner = (rows @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (owner == j).any():
                c[j] = rows[owner == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def reject_cosines(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of each centroid, the cosine that all but ``REJECT_QUANTILE`` of its texts reach.

    Every text is taken out of its own centroid first, as a text that was not
    learned from is not in one either. A centroid of fewer than
    ``REJECT_TEXTS`` texts uses the texts of the whole language; a language of
    fewer has no such cosine (0), as so few texts do not tell it.
    """
    cosine = rows @ centroids.T
    owner = cosine.argmax(axis=1)
    for j in range(len(centroids)):
        own = np.flatnonzero(owner == j)
        total = rows[own].sum(axis=0, dtype=np.float64)
        along = rows[own] @ total  # rows are unit vectors
        rest = np.sqrt(np.maximum(total @ total - 2 * along + 1, 0))
        cosine[own, j] = np.where(rest > 1e-6, (along - 1) / np.maximum(rest, 1e-6), 0)
    best = cosine.max(axis=1)

    def low(values: np.ndarray) -> float:
        return float(np.quantile(values, REJECT_QUANTILE)) if len(values) >= REJECT_TEXTS else 0.0

    parts = [best[owner == j] for j in range(len(centroids))]
    return np.array([low(x if len(x) >= REJECT_TEXTS else best) for x in parts])


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject: np.ndarray  # of each centroid, the cosine below which a text is too far from it


def fit(docs: DataFrame, modulus: int = 3, held_out: int = 1, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """Learn from text and non-null ``lang`` outside the held-out fold.

    At most ``max_per_language`` documents of each language are used (those of
    the smallest hashes of ``doc_id``); each language's centroids are fitted in
    a Spark task of its own. Without any labelled text the model is empty and
    predicts ``und``.
    """
    usable = docs.select("doc_id", "lang", F.col("text").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_bucket(F.col("doc_id"), modulus) != held_out))
    # Which documents: ids only, cut to a threshold hash by language before any text moves.
    ids = usable.select("lang", F.xxhash64("doc_id").alias("h"))
    counts = ids.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(2.0 * max_per_language) / F.col("count"))
    wanted = counts.select("lang", share.alias("share"))
    sample = (usable.join(F.broadcast(wanted), "lang")  # one row a language
              .withColumns({"h": F.xxhash64("doc_id"), "part": F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))})
              .filter(F.col("part") < F.col("share") * (1 << 20)))

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [ngram_counts(t) for t in pdf["text"]]
            at = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({"lang": pdf["lang"], "doc_id": pdf["doc_id"], "part": pdf["part"], "h": pdf["h"],
                                "buckets": [a.astype(np.int32) for a in at],
                                "counts": [r[a].astype(np.int32) for r, a in zip(rows, at)]})

    counted = staged(sample.select("lang", "doc_id", "part", "h", "text").mapInPandas(
        grams, "lang string, doc_id bigint, part bigint, h bigint, buckets array<int>, counts array<int>"),
        "langid-sample")
    total = counted.count()
    idf = np.full(BUCKETS, np.log(1.0 + total), dtype=np.float32)
    for r in counted.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():  # at most BUCKETS rows
        idf[r["b"]] = np.log((1.0 + total) / (1.0 + r["count"])) + 1.0

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "h", "doc_id"], kind="stable").head(max_per_language)
        rows = np.zeros((len(pdf), BUCKETS), dtype=np.float32)
        for i, (b, c) in enumerate(zip(pdf["buckets"], pdf["counts"])):
            rows[i, b] = np.sqrt(np.asarray(c, dtype=np.float32)) * idf[b]
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        c = spherical_kmeans(rows, CENTROIDS)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "centroid": list(c),
                             "reject": reject_cosines(rows, c)})

    fitted = counted.groupBy("lang").applyInPandas(
        cluster, "lang string, centroid array<float>, reject double").toPandas()
    fitted = fitted.sort_values("lang", kind="stable")
    centroids = np.array(fitted["centroid"].tolist(), dtype=np.float32).reshape(-1, BUCKETS)
    return Model(fitted["lang"].tolist(), centroids, idf, fitted["reject"].to_numpy(dtype=np.float64))


RESULT = ["lang_pred", "score", "rejected"]


def predict(docs: DataFrame, model: Model, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    ``und`` with score 0 if the text is null, empty or has no letter. A text
    whose best cosine is below that centroid's reject cosine (see
    ``reject_cosines``) or below ``reject_below`` keeps its nearest language
    but is flagged ``rejected``. Ties go to the language that sorts first. Texts of
    any length are read whole; repeated rows are judged alike; an empty table
    gives an empty table. Only the text is read. Input columns named like a result column are replaced.
    """
    languages, centroids, idf = model.languages, model.centroids.T.copy(), model.idf
    far = np.maximum(model.reject, reject_below)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def nearest(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        lang: list[str] = ["und"] * len(values)
        score = np.zeros(len(values))
        least = np.full(len(values), reject_below)
        usable = [i for i, t in enumerate(values) if has_letter(t)] if languages else []
        for at in range(0, len(usable), 128):
            block = usable[at:at + 128]
            cosine = vectors([values[i] for i in block], idf) @ centroids
            best = cosine.argmax(axis=1)
            for i, b, c in zip(block, best, cosine):
                lang[i], score[i], least[i] = languages[b], min(1.0, max(0.0, float(c[b]))), far[b]
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.array(score < least)], names=RESULT)

    d = without(docs, *RESULT)
    row = F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("row")
    return (docs.select(row, nearest.asNondeterministic()(F.col("text")).alias("r"))
            .select("row.*", "r.lang_pred", "r.score", "r.rejected"))
