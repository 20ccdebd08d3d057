"""The dealt operators over the driver tables: ``opN_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acurail.llm.common import crc_bucket, prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return run
    return deco


@query("op10_decision_list")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import decision_list

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).drop("text")


#: Host, path and verdict of the rules that op9 applies (fixed values of its contract).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import url_filter

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE["op9_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path
  FROM pages),
rules(rhost, rpath, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.action,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path
                            ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""


@query("op1_langid")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "rejected")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), toxicity.MODULUS) == toxicity.HELD_OUT, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import rule_ensemble

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), rule_ensemble.MODULUS) == rule_ensemble.HELD_OUT, F.lit(False))
    return rule_ensemble.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import simhash

    return simhash.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import mixing

    d = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def word_tokenizer() -> str:
    """Place of the public word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import packing

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer())


@query("op8_warc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import warc

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    directory = warc.write_archive(pages)
    # Pages whose id is divisible by 20 are looked up by URL through the index, all others are read block by block.
    asked = (F.col("page_id") % 20 == 0) & F.col("url").isNotNull()
    searched = warc.lookup(directory, pages.filter(asked).select("url")).filter(asked)
    scanned = warc.read_archive(directory).filter(~F.coalesce(asked, F.lit(False)))
    return scanned.unionByName(searched.drop("wanted")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
         (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT))
         & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


@query("op3_maxscore")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import maxscore

    return maxscore.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE["op3_maxscore"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


def piece_model() -> str:
    """Place of the public merge-type piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_piece_encoding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import pieces

    d = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_hard_negatives")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label)


ORACLE["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k
                 FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE k <= 3
"""


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acurail.llm import importance

    d = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of a text in SQL: the byte table by its rule, then one step a byte.
_CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(hex(encode(f))) // 2),
    lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))"""

ORACLE["op11_importance_resampling"] = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT doc_id, true AS corpus, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT NULL, false, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT doc_id, corpus, r, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM texts),
runs AS (
  SELECT corpus, r, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
hashed AS (
  SELECT f, xor({_CRC_SQL}, CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM runs), crc_table),
features AS (SELECT corpus, r, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
counts AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (WHERE corpus), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT corpus), 0) AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN features USING (bucket) GROUP BY b.bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM counts) AS DOUBLE) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT sum(t) FROM counts) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counts),
weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM features JOIN gains USING (bucket) WHERE corpus GROUP BY r),
scores AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(
           CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE corpus),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT 5 * count(*) // 100 FROM ranked) THEN k END AS rank
FROM scores LEFT JOIN ranked USING (r)
"""
