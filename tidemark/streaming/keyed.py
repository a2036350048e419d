"""A keyed Parquet table that micro-batches are merged into, a few hash buckets at a time.

A batch reads and rewrites only the buckets that its keys fall into; a version is the list of
the folder that holds each bucket, one small row a bucket, and is committed by Spark's own
success marker on that list. Each version names the batch it came from, so a batch that comes
again after a restart changes nothing, and one that was cut off before its commit is done anew.
The last ``keep`` versions stay readable; folders that only older ones name are removed.

Choose ``buckets`` so that one is a task's work (about 128 MB at the size you expect).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, BUCKET = "__version", "__bucket"
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def batch_tag(batch: DataFrame, number: int) -> str:
    """The streaming query (its id survives restarts from one checkpoint) and batch number."""
    return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}:{number}"


def only_new(keys: Sequence[str]) -> Merge:
    """Keeps what is stored; adds keys that are not, one row each."""
    def merge(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
        fresh = incoming.dropDuplicates(list(keys))
        return fresh if current is None else current.unionByName(fresh.join(current.select(*keys), list(keys), "left_anti"))

    return merge


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 16, keep: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path, list(keys), buckets, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, at: str) -> bool:
        return self._fs.exists(self._path(at))

    def versions(self) -> list[int]:
        """Committed versions that are still kept."""
        at = f"{self.path}/versions"
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(at))] if self._exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and self._exists(f"{at}/{n}/_SUCCESS"))

    def manifest(self, version: int) -> list[tuple[int, int, str]]:
        """(bucket, version that wrote it, tag of this version's batch)."""
        return [tuple(r) for r in self.spark.read.parquet(f"{self.path}/versions/{version}").select("bucket", "written", "tag").collect()]

    def _load(self, parts: list[tuple[int, int]]) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in parts]).drop(VERSION, BUCKET) if parts else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The latest version, or the given one; None before the first."""
        found = self.versions()
        return self._load([(b, w) for b, w, _ in self.manifest(found[-1] if version is None else version) if b >= 0]) if found else None

    def merge(self, tag: str, incoming: DataFrame, merge: Merge) -> bool:
        """merge(stored rows of the touched buckets or None, incoming) becomes those buckets.
        False if the batch was merged before."""
        found = self.versions()
        kept = {v: self.manifest(v) for v in found}
        if any(t == tag for rows in kept.values() for _, _, t in rows):
            return False
        version = (found[-1] if found else -1) + 1
        stored = {b: w for b, w, _ in kept.get(version - 1, []) if b >= 0}
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")
        rows = incoming.persist()
        try:
            touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most ``buckets``
            out = merge(self._load([(b, stored[b]) for b in touched if b in stored]), rows).withColumn(BUCKET, bucket)
            out.repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{VERSION}={version}")
        finally:
            rows.unpersist()
        stored |= {b: version for b in touched}
        now = [(b, w, tag) for b, w in sorted(stored.items()) if w != version or self._exists(f"{self.path}/data/{VERSION}={w}/{BUCKET}={b}")]
        # a version without rows still names its batch
        self.spark.createDataFrame(now or [(-1, version, tag)], "bucket int, written int, tag string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
        self._drop_old({**kept, version: now})
        return True

    def _drop_old(self, manifests: dict[int, list[tuple[int, int, str]]]) -> None:
        order = sorted(manifests)
        live = {(b, w) for v in order[-self.keep :] for b, w, _ in manifests[v]}
        for v in order[: -self.keep]:
            for b, w, _ in manifests[v]:
                if (b, w) not in live:
                    self._fs.delete(self._path(f"{self.path}/data/{VERSION}={w}/{BUCKET}={b}"), True)
            self._fs.delete(self._path(f"{self.path}/versions/{v}"), True)
