"""File readers with explicit schemas (A1-A3) and the JSON-lines stream fixture."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acurail.session import ensure_checkpoint_dir


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             required: tuple[str, ...] = ()) -> DataFrame:
    """A1/A2: header CSV with an explicit schema (inference only when none is given)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Required column(s) {missing} not found. Available: {df.columns}")
    return df


def read_optional(spark: SparkSession, path: str | None, reader=None) -> DataFrame | None:
    """A3: an absent optional source is skipped (None) rather than failing the job.

    Spark itself decides whether the path exists, so any file system works; other errors are raised.
    """
    if not path:
        return None
    try:
        return (reader or (lambda p: read_csv(spark, p)))(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_lines(lines: DataFrame, num_files: int = 4, base: str | None = None) -> str:
    """Write a column of message texts into a fresh folder under the shared checkpoint directory; returns the
    folder, whose ``in`` drives file-source streams."""
    root = base or os.path.join(ensure_checkpoint_dir(lines.sparkSession), "streams", uuid.uuid4().hex)
    lines.repartition(num_files).write.mode("overwrite").text(os.path.join(root, "in"))
    return root


def write_stream_input(records: DataFrame, num_files: int = 4, base: str | None = None) -> str:
    """Write records as JSON lines (the producer's message format); see ``write_lines``."""
    return write_lines(records.select(F.to_json(F.struct("*")).alias("value")), num_files, base)
