"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acurail.session import ensure_checkpoint_dir

#: What separates words in every contract of this package: space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch: texts are long, and a worker holds a whole batch.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on.

    Python workers of a local session can import this package whatever the
    working folder is (a cluster ships it with ``--py-files`` or a wheel).
    Arrow batches hold at most ``BATCH_ROWS`` rows, unless the session asks
    for fewer.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain Parquet scan; column pruning and filter push-down are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name inside the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, but later scans can prune
    columns. All executors see the folder, so a lost executor loses nothing.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names an operator is about to add (result columns win)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def crc_bucket(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return (F.crc32(col.cast("string")) % F.lit(modulus)).cast("int")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labelled_ids(labels: DataFrame, label_col: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, label) of at most ``limit`` labelled documents outside the held-out fold.

    The rows with the smallest hashes of ``doc_id`` are taken, so reruns agree.
    Null ids or labels are ignored; repeated rows of one id count once, with
    their largest label.
    """
    rows = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()
                       & (crc_bucket(F.col("doc_id"), modulus) != held_out))
    return (rows.groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
