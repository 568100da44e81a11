"""Tables that are updated in place by copy-on-write versions (S11 for J9, J10 and running state).

Rows are dealt to hash buckets of their key.  An update rewrites only the buckets that hold a changed key, into folders of
a new version; a manifest lists the folder of every bucket, and a pointer file, created last and at once, makes the version
current.  Readers of a version keep it: nothing is overwritten.  A write that fails before its pointer leaves the old
version current, and the next write of that version replaces what is left of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class VersionedTable:
    """A table at ``path``, dealt by ``key``; ``buckets`` should hold some hundred MB each."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.buckets)).cast("int")

    def current(self) -> int:
        """The newest version that is complete; -1 if there is none."""
        fs, p = self._fs(f"{self.path}/_versions")
        if not fs.exists(p):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=-1)

    def folders(self, version: int | None = None) -> dict[int, int]:
        """bucket -> version whose folder holds it; one entry per bucket at most."""
        version = self.current() if version is None else version
        rows = self.spark.read.schema("bucket int, written int").parquet(f"{self.path}/manifest/{version}")
        return {r.bucket: r.written for r in rows.collect()}

    def schema(self, version: int | None = None) -> T.StructType:
        version = self.current() if version is None else version
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema/{version}").first()[0]))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A version of the table (the current one by default), or some of its buckets."""
        version = self.current() if version is None else version
        schema = self.schema(version)
        at = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(self.folders(version).items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets that hold a key of ``changes`` (at most ``buckets`` numbers)."""
        return [r.b for r in changes.select(self.bucket().alias("b")).distinct().collect()]

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``bucket`` and ``_part``: each task gets one part, all rows of a key are in one part, and a part is in one bucket.

        Rows grouped by these two columns and then the key need no other shuffle, neither for the grouping nor for :meth:`write`.
        """
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n = self.buckets * -(-tasks // self.buckets)     # a multiple of the buckets
        part = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(n)).cast("int")
        return rows.withColumn("_part", part).repartitionById(n, F.col("_part")).withColumn("bucket", F.col("_part") % self.buckets)

    def write(self, rows: DataFrame, version: int, keep: dict[int, int], dealt: bool = False) -> int:
        """Write ``rows`` as the buckets of a new version beside the kept ones, then make it current.

        ``dealt``: the rows come from :meth:`deal` and have their ``bucket``; they are written as they lie.
        """
        out = rows if dealt else rows.withColumn("bucket", self.bucket()).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        rows = rows.drop("bucket") if dealt else rows
        fs, p = self._fs(f"{self.path}/data/{version}")
        new = {int(s.getPath().getName().split("=")[1]): version for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
        manifest = self.spark.createDataFrame(sorted((keep | new).items()), "bucket int, written int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        self.spark.createDataFrame([(json.dumps(rows.schema.jsonValue()),)], "s string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema/{version}")
        fs, p = self._fs(f"{self.path}/_versions/{version}")
        if not fs.exists(p):
            fs.create(p, False).close()
        return version

    def create(self, rows: DataFrame, version: int = 0) -> int:
        return self.write(rows, version, {})

    def rewrite(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], base: int | None = None, dealt: bool = False) -> int:
        """New version: ``merge(old rows, changes)`` in the buckets with a changed key, the other buckets as they are.

        ``base``: version that is changed (the current one by default); rewriting an old base again replaces the version after it.
        ``dealt``: as in :meth:`write`, of what ``merge`` returns.
        """
        base = self.current() if base is None else base
        at = self.touched(changes)
        keep = {b: v for b, v in self.folders(base).items() if b not in at}
        return self.write(merge(self.read(base, at), changes), base + 1, keep, dealt)

    def update(self, changes: DataFrame, columns: list[str], prefer_new: bool = True) -> int:
        """J9, J10 in place: set ``columns`` of rows with a key in ``changes`` (the smallest value per key); with ``prefer_new`` off only nulls are filled.

        Null new values change nothing; keys without a row are ignored.
        """
        news = [f"_new_{c}" for c in columns]
        small = changes.groupBy(*self.key).agg(*[F.min(c).alias(n) for c, n in zip(columns, news)])

        def merge(old: DataFrame, lookup: DataFrame) -> DataFrame:
            x = old.join(lookup, self.key, "left")
            value = lambda c, n: F.coalesce(n, c) if prefer_new else F.coalesce(c, n)
            return x.select(*[value(c, f"_new_{c}").alias(c) if c in columns else F.col(f"`{c}`") for c in old.columns])

        return self.rewrite(small, merge)
