"""A stored table of current rows that micro-batches merge into.

Rows are dealt to a fixed number of buckets by the hash of their key. A batch
rewrites the buckets that it touches and no other, into a folder of its own,
and then writes a version: a short list that names the folder of every bucket.
The version is written last, so a batch takes effect as a whole. Merging batch
``n`` always starts from the newest version below ``n``; a batch that is
replayed after a loss therefore gives the same table again. Folders that the
last two versions do not name are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acurail.session import child_names, delete_folder

_BUCKET = "_bucket"


class KeyedTable:
    """``path`` holds rows of ``schema`` whose place depends on the columns ``key`` (null keys included).

    ``buckets`` bounds what a batch has to rewrite: about (touched keys /
    buckets) of the table. It belongs to the table and must not change.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: str | T.StructType,
                 buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _versions(self) -> list[int]:
        root = f"{self.path}/versions"
        return sorted(int(n) for n in child_names(self.spark, root)
                      if n.isdigit() and "_SUCCESS" in child_names(self.spark, f"{root}/{n}"))

    def _places(self, version: int | None) -> dict[int, int]:
        """Bucket -> batch whose folder holds it; at most ``buckets`` rows."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, batch long").json(f"{self.path}/versions/{version}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def _read(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{batch}/{_BUCKET}={bucket}" for bucket, batch in sorted(places.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def current(self, before: int | None = None) -> DataFrame:
        """The rows of the newest version (of those below batch ``before``)."""
        known = [v for v in self._versions() if before is None or v < before]
        return self._read(self._places(known[-1] if known else None))

    def merge(self, batch_id: int, changes: DataFrame,
              fold: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Replace the touched buckets' rows by ``fold(their rows, changes)``; (rows before, rows after) of these.

        ``changes`` carries the key columns; ``fold`` must keep rows of keys that do not change.
        """
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in changes.select(bucket.alias(_BUCKET)).distinct().collect()]
        known = [v for v in self._versions() if v < batch_id]
        places = self._places(known[-1] if known else None)
        before = self._read({b: places[b] for b in touched if b in places})
        rows = fold(before, changes).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        # The fold has just dealt the rows by key; dealing them again by bucket would move the whole table twice.
        (rows.withColumn(_BUCKET, bucket).write.mode("overwrite").option("compression", "zstd").partitionBy(_BUCKET)
         .parquet(f"{self.path}/data/{batch_id}"))
        written = {int(n.split("=")[1]) for n in child_names(self.spark, f"{self.path}/data/{batch_id}")
                   if n.startswith(_BUCKET)}
        now = {**{b: p for b, p in places.items() if b not in touched}, **{b: batch_id for b in written}}
        (self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1)
         .write.mode("overwrite").json(f"{self.path}/versions/{batch_id}"))
        self._compact(batch_id, known)
        return before, self._read({b: batch_id for b in written})

    def _compact(self, batch_id: int, known: list[int]) -> None:
        """Delete versions but the last two, and the folders that neither of these names."""
        kept = [*known[-1:], batch_id]
        used = {str(p) for v in kept for p in self._places(v).values()}
        for name in child_names(self.spark, f"{self.path}/data"):
            if name not in used and name != str(batch_id):
                delete_folder(self.spark, f"{self.path}/data/{name}")
        for v in known[:-1]:
            delete_folder(self.spark, f"{self.path}/versions/{v}")


def add_up(key: Sequence[str], sums: Sequence[str], least: Sequence[str] = (), most: Sequence[str] = ()):
    """A fold that adds the changes of a key to its row."""
    def fold(before: DataFrame, changes: DataFrame) -> DataFrame:
        return before.unionByName(changes.select(*before.columns)).groupBy(*key).agg(
            *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    return fold
