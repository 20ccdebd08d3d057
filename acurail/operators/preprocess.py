"""Model input preparation.

Fitted statistics (medians, means, scales, category lists, vocabulary) are
small aggregates; they are joined back as one-row / bounded tables, never
pulled through the driver as data.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acurail.constants import TFIDF_MAX_FEATURES, TFIDF_MIN_DF, TFIDF_TOKEN_PATTERN
from acurail.functions.ordered import exact_percentiles, prefix_within
from acurail.session import stored


# ---------------------------------------------------------------- K1
def fit_impute_scale(train: DataFrame, cols: list[str]) -> DataFrame:
    """K1 fit: exact median per column, then mean and population std of the imputed values.

    Returns one row with ``{c}__median``, ``{c}__mean``, ``{c}__scale``.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])
    long = train.select(F.lit(1).alias("_g"), F.inline(entries))
    med = exact_percentiles(long, ["_g", "col"], "v", [0.5])
    stats = long.groupBy("_g", "col").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nn"),
                                         F.avg("v").alias("a"), F.var_pop("v").alias("vp"))
    j = stats.join(med, ["_g", "col"], "left").withColumnRenamed("q50", "median")
    # Imputed values: nulls replaced by the median. Mean and variance adjust in closed form from centred
    # moments, so nothing cancels on large values.
    nmiss = F.col("n") - F.col("nn")
    mean = (F.col("nn") * F.col("a") + nmiss * F.col("median")) / F.col("n")
    j = j.withColumn("mean", mean)
    var = (F.col("nn") * (F.col("vp") + (F.col("a") - F.col("mean")) ** 2)
           + nmiss * (F.col("median") - F.col("mean")) ** 2) / F.col("n")
    j = j.withColumn("scale", F.when(F.sqrt(F.greatest(var, F.lit(0.0))) > 0,
                                     F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(1.0)))
    return j.groupBy("_g").pivot("col", cols).agg(
        F.first("median").alias("median"), F.first("mean").alias("mean"), F.first("scale").alias("scale")).drop("_g")


def apply_impute_scale(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    """K1 transform: (coalesce(x, median) - mean) / scale.

    ``fitted`` is the one-row table of fitted parameters; its values are read
    once and inlined as literals (model parameters, not data), so the
    transform is a plain projection on batch and streaming inputs alike.
    """
    p = fitted.first().asDict()
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(p[f"{c}_median"])) - F.lit(p[f"{c}_mean"]))
                           / F.lit(p[f"{c}_scale"]) for c in cols})


# ---------------------------------------------------------------- K2
def fit_categories(train: DataFrame, cols: list[str]) -> DataFrame:
    """K2 fit: most frequent value per column (smallest on ties) and the sorted category list.

    Long table (col, value, is_mode); its size is the number of categories.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = train.select(F.inline(entries)).filter(F.col("value").isNotNull()) \
        .groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("col").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("is_mode", F.row_number().over(w) == 1).select("col", "value", "is_mode")


def one_hot(df: DataFrame, categories: DataFrame, cols: list[str], key: str = "patient_id") -> DataFrame:
    """K2 transform: impute with the mode, one 0/1 column per known category; unknown -> all zeros.

    The category list is metadata (bounded by distinct categories), read once
    to name the output columns, as ``StringIndexer`` does.
    """
    cats = sorted((r["col"], r["value"], r["is_mode"]) for r in categories.collect())
    modes = {c: v for c, v, m in cats if m}
    out = df
    for c in cols:
        filled = F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c)))
        out = out.withColumns({f"{c}_{v}": (filled == v).cast("int") for cc, v, _ in cats if cc == c})
    return out


# ---------------------------------------------------------------- F5 / F6
def split_cuts(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """F6 fit: per class the (hash, key) of the last test row; one row a class. Only labels and keys are ranked."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    thin = prefix_within(df.select(label, h.alias("_h"), key), [label], ["_h", key], seq_col="_rk")
    counts = thin.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    last = thin.join(F.broadcast(counts), label).filter(F.col("_rk") == F.ceil(F.col("_nc") * test_size))
    return last.select(label, F.struct("_h", key).alias("cut"))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """deterministic stratified split. Within each class rows are ranked by
    ``md5(key || seed)``; the first ``ceil(test_size * n_c)`` go to test.

    The cut of each class is found first; the flag is then set row by row, so
    no whole row is sorted, joined or stored. Rows without a class are left out.
    """
    cuts = split_cuts(df.filter(F.col(label).isNotNull()), label, key, test_size, seed).collect()  # one row a class
    own = F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), F.col(key))
    test = F.lit(False)
    for r in cuts:
        cut = F.struct(F.lit(r["cut"][0]), F.lit(r["cut"][1]))
        test = test | ((F.col(label) == r[label]) & (own <= cut))
    return df.filter(F.col(label).isNotNull()).withColumn("split", F.when(test, "test").otherwise("train"))


def stratified_sample(df: DataFrame, label: str, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """at most ``n // 5`` rows per class (hash order), then the first ``n`` overall.
    A sampling operator: the limit is the feature."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    # Spark keeps the first rows of each class in every partition before the shuffle (ranked limit).
    w = Window.partitionBy(label).orderBy("_h", key)
    ranked = df.withColumn("_h", h).withColumn("_rk", F.row_number().over(w))
    return ranked.filter(F.col("_rk") <= n // 5).orderBy(label, "_rk").limit(n).drop("_h", "_rk")


# ---------------------------------------------------------------- K3
@cache
def _accent_table() -> tuple[str, str]:
    """Accent folding of all scripts, derived from Unicode NFKD: characters that become one Latin letter
    (accented, full-width, superscript, mathematical).

    Combining marks stand at the end of the source without a counterpart, so ``translate`` deletes them and
    decomposed text folds like precomposed text. Other characters separate tokens, folded or not.
    """
    letters, marks = {}, []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
        elif unicodedata.decomposition(ch):
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if len(base) == 1 and base.isascii() and base.isalpha():
                letters[ch] = base
    return "".join(letters) + "".join(marks), "".join(letters.values())


def _ligatures() -> list[tuple[str, str]]:
    """Lower-case Latin letters whose NFKD form has several letters (ligatures and digraphs)."""
    found = []
    for cp in [*range(0x00C0, 0x0250), *range(0xFB00, 0xFB07)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) > 1 and chr(cp) == chr(cp).lower():
            found.append((chr(cp), base))
    return found


def tokens(text_col: str = "text") -> F.Column:
    """Lower-case, fold accents, extract ``[a-zA-Z]{2,}`` tokens."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    t = F.translate(low, *_accent_table())
    for letter, base in _ligatures():
        t = F.replace(t, F.lit(letter), F.lit(base))
    t = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(t)  # nothing to fold in ASCII text
    return F.regexp_extract_all(t, F.lit(f"({TFIDF_TOKEN_PATTERN})"), 1)


def grams(tok: F.Column) -> F.Column:
    """Unigrams and bigrams of a token array."""
    pairs = F.zip_with(tok, F.slice(tok, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tok, F.filter(pairs, lambda x: x.isNotNull()))


#: Longest list of frequent words that ``fit_tfidf`` keeps as literals.
OFTEN_LIMIT = 2_000


def fit_tfidf(train_docs: DataFrame, key: str = "doc_id", text_col: str = "text",
              max_features: int = TFIDF_MAX_FEATURES, min_df: int = TFIDF_MIN_DF) -> DataFrame:
    """K3 fit: vocabulary (top ``max_features`` by corpus frequency, ties by term, df >= min_df)
    with smooth idf = ln((1 + n) / (1 + df)) + 1. Returns (term, idf), at most max_features rows.

    Words are counted first. A pair occurs no oftener than either of its words, so grams of words that occur at
    least as often as the last of ``2 * max_features`` words are all grams of that frequency. If enough of them
    pass ``min_df``, they hold the vocabulary; else all grams are counted. Grams are taken inside the row and
    summed map-side by term; no text is shuffled.
    """
    docs = train_docs.select(tokens(text_col).alias("g"))
    n = train_docs.count()

    def top(stats: DataFrame) -> DataFrame:
        vocab = stats.filter(F.col("df") >= min_df).orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)
        return vocab.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))

    words = docs.select(F.explode("g").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    often = words.orderBy(F.col("cf").desc(), F.col("term")).limit(OFTEN_LIMIT + 1).collect()
    if 0 < 2 * max_features < len(often):
        least = often[2 * max_features - 1]["cf"]
        kept = [r["term"] for r in often if r["cf"] >= least]
        if len(kept) <= OFTEN_LIMIT:
            pairs = F.zip_with("g", F.slice("g", 2, 1 << 30), lambda a, b: F.when(
                a.isin(kept) & b.isin(kept), F.concat(a, F.lit(" "), b)))
            stats = stored(_gram_counts(docs.select(F.concat(
                F.filter("g", lambda x: x.isin(kept)), F.array_compact(pairs)).alias("g"))), "grams")
            if stats.filter((F.col("df") >= min_df) & (F.col("cf") >= least)).limit(max_features).count() == max_features:
                return top(stats)
    return top(_gram_counts(docs.select(grams(F.col("g")).alias("g"))))


def _gram_counts(g: DataFrame) -> DataFrame:
    """(term, df, cf) of the arrays ``g``: rows with the term, and times it occurs."""
    # The gram array is only referenced outside lambdas, so it is never recomputed per element.
    each = F.array(F.struct(F.col("g").alias("g"), F.lit(1).alias("cf"), F.lit(0).alias("df")),
                   F.struct(F.array_distinct("g").alias("g"), F.lit(0).alias("cf"), F.lit(1).alias("df")))
    terms = g.select(F.inline(each)).select(F.explode("g").alias("term"), "cf", "df")
    return terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def tfidf_vector(df: DataFrame, text_col: str, vocab_rows: list[tuple[str, float]]) -> DataFrame:
    """Add ``_tfidf``: sublinear tf x idf over a fixed vocabulary, L2-normalised (zero if no term occurs).

    Row-local. Terms are counted by Spark ML's ``CountVectorizerModel`` (one
    lookup per gram); the weights are one pass over its vector.
    """
    if not vocab_rows:
        return df.withColumn("_tfidf", array_to_vector(F.array().cast("array<double>")))
    counter = CountVectorizerModel.from_vocabulary([t for t, _ in vocab_rows], inputCol="_grams", outputCol="_tf")
    out = counter.transform(df.withColumn("_grams", grams(tokens(text_col))))
    idf = F.array(*[F.lit(i) for _, i in vocab_rows])
    weights = F.zip_with(vector_to_array("_tf"), idf,
                         lambda n, i: F.when(n > 0, (1 + F.log(n)) * i).otherwise(F.lit(0.0)))
    out = out.withColumn("_weights", array_to_vector(weights))
    return Normalizer(inputCol="_weights", outputCol="_tfidf", p=2.0).transform(out).drop("_grams", "_tf", "_weights")


def tfidf_weights(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """K3 transform: (doc, term, weight) of the terms that occur, sublinear tf (1 + ln tf) * idf, L2-normalised per row.

    The vocabulary (at most ``max_features`` rows) is model state, kept as literals.
    """
    rows = sorted((r["term"], float(r["idf"])) for r in vocab.collect())
    out = tfidf_vector(docs.select(key, text_col), text_col, rows).select(
        key, F.posexplode(vector_to_array("_tfidf")).alias("i", "weight")).filter("weight <> 0")
    names = F.array(*[F.lit(t) for t, _ in rows]) if rows else F.array().cast("array<string>")
    return out.select(key, F.get(names, F.col("i")).alias("term"), "weight")


def tfidf_corpus(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Fit and transform one corpus; (vocabulary, weights)."""
    vocab = stored(fit_tfidf(docs, key, text_col), "vocabulary")
    return vocab, tfidf_weights(docs, vocab, key, text_col)
