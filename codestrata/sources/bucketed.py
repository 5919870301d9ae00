"""A table in hash buckets, of which an upsert rewrites only those that its rows fall into.

Layout below the table's path: ``data/v<version>/bucket=<n>/*.parquet``, and one small JSON file for each version in ``manifest``,
which names the folder of every bucket, the number of buckets and the schema. A version is published by writing its
manifest file under another name and renaming it, which is atomic; buckets that a batch leaves alone keep their files. A crash before the
rename leaves the last version as it is, and files without a manifest are never read; a version that already
exists makes the rename fail, so of two writers one fails and loses nothing. ``vacuum`` removes what no kept version names.

Defined cases: null is a key like any other; of several rows of a key in a batch the last by ``order`` stays (by all columns, where it
is not given); an empty batch publishes nothing; columns that only one side has are null on the other; a batch that was
published under a given ``batch_id`` is not applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Rows that a bucket should hold at most; where a first batch is larger, a table begins with more buckets.
BUCKET_ROWS = 1 << 20


class WriteConflict(RuntimeError):
    """Another writer published the same version first."""


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._of(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """version, buckets, schema, folders (bucket to folder) and batches of a version, the last by default; None without one."""
        versions = self._versions()
        if not versions:
            return None
        at = f"{self.path}/manifest/{versions[-1] if version is None else version}.json"
        stream = self._fs.open(self._of(at))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        name = f"{self.path}/manifest/{manifest['version']}.json"
        draft = self._of(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(self._of(name)) or not self._fs.rename(draft, self._of(name)):
            self._fs.delete(draft, False)
            raise WriteConflict(f"version {manifest['version']} of {self.path} is there already")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version; ``buckets`` limits the scan to some buckets."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(self.path)
        schema = T.StructType.fromJson(m["schema"])
        folders = [f for b, f in sorted(m["folders"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def lookup(self, keys: list) -> DataFrame:
        """The rows of a few keys, from their buckets only."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(self.path)
        kind = T.StructType.fromJson(m["schema"])[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        buckets = [r[0] for r in asked.select(bucket_of(F.col(self.key), m["buckets"])).distinct().collect()]
        rows = self.read(buckets=buckets).alias("t")
        return rows.join(F.broadcast(asked.alias("a")), F.col(f"t.{self.key}").eqNullSafe(F.col(f"a.{self.key}")), "left_semi")  # as many rows as keys given

    def upsert(self, batch: DataFrame, order: Column | None = None, batch_id: str | None = None, buckets: int | None = None) -> int | None:
        """Replace rows by key and publish a version, whose number it gives; None if there was nothing to do.

        ``batch`` is read twice: for its buckets, then for their rows."""
        m = self.manifest()
        if m and batch_id is not None and batch_id in m["batches"]:
            return None
        if m is None:
            buckets = buckets or max(BUCKETS, -(-batch.count() // BUCKET_ROWS))
            m = {"version": 0, "buckets": buckets, "schema": batch.schema.jsonValue(), "folders": {}, "batches": []}
        last = [order.desc_nulls_last()] if order is not None else [F.to_json(F.struct(*batch.columns)).desc_nulls_last()]
        batch = batch.withColumn("_r", F.row_number().over(W.partitionBy(self.key).orderBy(*last))).filter("_r = 1").drop("_r")
        at = bucket_of(F.col(self.key), m["buckets"]).alias("bucket")
        touched = [r[0] for r in batch.select(at).distinct().collect()]  # as many as there are buckets
        if not touched:
            return None
        merged = batch
        held = [b for b in touched if str(b) in m["folders"]]
        if held:
            old = self.read(buckets=held)
            kept = old.join(batch.select(F.col(self.key).alias("_key")), old[self.key].eqNullSafe(F.col("_key")), "left_anti")
            merged = kept.unionByName(batch, allowMissingColumns=True)
        elif m["folders"]:
            merged = self.spark.createDataFrame([], T.StructType.fromJson(m["schema"])).unionByName(batch, allowMissingColumns=True)
        version = m["version"] + 1
        folder = f"data/v{version}-{uuid.uuid4().hex[:8]}"
        # One task a bucket, so that a bucket is one file (or as many as its rows ask for).
        merged.withColumn("bucket", at).repartition(len(touched), "bucket").write.partitionBy("bucket").option("maxRecordsPerFile", BUCKET_ROWS).parquet(f"{self.path}/{folder}")
        folders = m["folders"] | {str(b): f"{folder}/bucket={b}" for b in touched}
        batches = [*m["batches"], batch_id][-1000:] if batch_id is not None else m["batches"]
        self._publish({"version": version, "buckets": m["buckets"], "schema": merged.schema.jsonValue(), "folders": folders, "batches": batches})
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests and folders of all but the last ``keep`` versions; the number of folders that went."""
        versions = self._versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        named = {f.split("/")[1] for m in kept for f in m["folders"].values()}
        data, gone = self._of(f"{self.path}/data"), 0
        for v in versions[:-keep]:
            self._fs.delete(self._of(f"{self.path}/manifest/{v}.json"), False)
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
                gone += 1
        return gone


def points_upsert(table: BucketedTable, points: DataFrame, dim: int, vector_col: str = "vector", **options) -> int | None:
    """Upsert of index points, all of whose vectors must have ``dim`` components."""
    wrong = points.filter(F.coalesce(F.size(vector_col), F.lit(-1)) != dim).select(table.key, F.size(vector_col).alias("n")).head(1)
    if wrong:
        raise ValueError(f"vector length {wrong[0]['n']} is not {dim} for id {wrong[0][table.key]}")
    return table.upsert(points, **options)
