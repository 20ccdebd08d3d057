"""SparkSession helpers.

On a cluster the session is created by the platform; these helpers only
fill in settings that are unset (tests and local benches).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "acurail",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ACURAIL_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a scratch one only if unset.

    Cluster deployments name a shared (HDFS/S3/ABFS) folder in
    ``spark.checkpoint.dir``; that value always wins. Only a local master
    without a setting gets a private scratch folder; on a cluster a folder of
    the driver's machine would be invisible to the executors, so the missing
    setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        configured = tempfile.mkdtemp(prefix="acurail-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Longest method, in bytes of bytecode, that the JVM's compiler takes; longer ones are interpreted for good.
COMPILED_METHOD_BYTES = "8000"


def compile_long_rows(spark: SparkSession) -> None:
    """Run expressions too long for one compiled method as projections of many short ones.

    The encounter view and the rule layers make one generated method of a whole stage that the JVM never compiles.
    Spark leaves whole-stage generation for such a stage alone if its limit is the compiler's. A lower limit stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > int(COMPILED_METHOD_BYTES):
        spark.conf.set(name, COMPILED_METHOD_BYTES)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but readers scan only the columns
    they use, and the files are compressed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/acurail-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's file system, as tasks need it."""
    files, p = _folder(spark, path)
    return files.makeQualified(p).toString()


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a ``qualified`` folder, for Python in a task."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark can read; none if it does not exist."""
    fs, p = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def folder_entries(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time) of a file, or of the files right in a folder; sorted."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))
