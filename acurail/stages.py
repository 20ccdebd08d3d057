"""Stored stages that reports of one application share.

A stage is a table derived from input files, stored with the columns that its
reader needs and no more. A later reader of the same inputs that needs no
other columns reads the stored files; nothing is computed or written again.
``release`` deletes the stages; at the end of the Python process it is called
for sessions that still run.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from acurail.session import delete_folder, ensure_checkpoint_dir, folder_entries

#: (application, label, input files) -> stored stages, each (columns, path).
_STAGES: dict[tuple, list[tuple[frozenset[str], str]]] = {}
_WATCHED: set[str] = set()


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Name, size and time of every input file, so that changed inputs never meet an old stage."""
    return tuple((p, tuple(folder_entries(spark, p))) for p in paths)


def stage(spark: SparkSession, inputs: Sequence[str], label: str, columns: Sequence[str],
          make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``'s ``columns``, stored once per application and inputs."""
    app = spark.sparkContext.applicationId
    known = _STAGES.setdefault((app, label, fingerprint(spark, inputs)), [])
    for have, path in known:
        if have.issuperset(columns):
            return spark.read.parquet(path).select(*columns)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/acurail-stage-{label}-{uuid.uuid4().hex}"
    df = make().select(*columns)
    df.write.parquet(path)
    known.append((frozenset(columns), path))
    if app not in _WATCHED:
        _WATCHED.add(app)
        atexit.register(_at_exit, spark, app)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete this application's stages; their number. Tables that were read from them cannot be read again."""
    app = spark.sparkContext.applicationId
    keys = [k for k in _STAGES if k[0] == app]
    paths = [path for k in keys for _, path in _STAGES.pop(k)]
    for path in paths:
        delete_folder(spark, path)
    return len(paths)


def _at_exit(spark: SparkSession, app: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and context.applicationId == app:
        release(spark)
