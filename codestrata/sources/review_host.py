"""A review host's answers as a Spark source, and a cache of large change sets.

``ReviewHost`` is a data source (format ``review_host``) over recorded answers: below its folder each file at
``project=<quoted name>/kind=<kind>/`` holds one answer a line, ``{"iid": n, "page": n, "status": 200, "body": ...}`` (raw files with
``ref`` and ``path`` beside a base64 body). A file is one partition, which a task reads and parses for itself, line by line; nothing
but the list of files passes the driver. The option ``kind`` says what is read: ``meta``, ``commits``, ``diffs`` or ``raw``; ``project``
limits it to a folder, ``iid`` to a change request. Answers other than 200 give no row, but for ``raw``, where 404 gives a row without content; lines that are no
JSON fail the read.
"""

from __future__ import annotations

import io
import json
from base64 import b64decode
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codestrata.functions import ids
from codestrata.operators.diff import is_binary_patch
from codestrata.sources.bucketed import BucketedTable

#: The fields of an answer that are used, by kind, as (column, path in the answer, type).
FIELDS = {
    "meta": [
        ("title", "title", "string"), ("description", "description", "string"), ("state", "state", "string"), ("source_branch", "source_branch", "string"), ("target_branch", "target_branch", "string"), ("web_url", "web_url", "string"),
        ("created_at", "created_at", "string"), ("updated_at", "updated_at", "string"), ("author", "author.username", "string"), ("author_name", "author.name", "string"),
        ("base_sha", "diff_refs.base_sha", "string"), ("start_sha", "diff_refs.start_sha", "string"), ("head_sha", "diff_refs.head_sha", "string"),
    ],
    "commits": [("id", "id", "string"), ("title", "title", "string"), ("message", "message", "string"), ("author_name", "author_name", "string"), ("authored_at", "created_at", "string"), ("web_url", "web_url", "string")],
    "diffs": [
        ("old_path", "old_path", "string"), ("new_path", "new_path", "string"), ("is_new", "new_file", "boolean"), ("is_renamed", "renamed_file", "boolean"), ("is_deleted", "deleted_file", "boolean"),
        ("too_large", "too_large", "boolean"), ("generated", "generated_file", "boolean"), ("raw_unidiff", "diff", "string"),
    ],
    "raw": [("ref", "ref", "string"), ("path", "path", "string"), ("content", "body", "binary")],
}
_KEYS = [("project", "string"), ("iid", "long"), ("page", "int"), ("ord", "int")]
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


class _File(InputPartition):
    def __init__(self, uri: str, project: str):
        self.uri, self.project = uri, project


def _part(path: str, name: str) -> str | None:
    return next((unquote(p[len(name) + 1 :]) for p in path.split("/") if p.startswith(f"{name}=")), None)


def _at(value, path: str):
    for p in path.split("."):
        value = value.get(p) if isinstance(value, dict) else None
    return value


class ReviewHost(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_host"

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "diffs")
        if kind not in FIELDS:
            raise ValueError(f"kind is one of {', '.join(FIELDS)}, not {kind}")
        return kind

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in _KEYS + [(c, t) for c, _, t in FIELDS[self.kind]])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, self.kind)


class _Reader(DataSourceReader):
    def __init__(self, options, kind: str):
        self.folder, self.kind, self.project, self.iid = options["path"], kind, options.get("project"), options.get("iid")

    def partitions(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        found = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = f.path.rsplit("/", 1)[-1]
            below = f.path[len(root) :]
            if f.is_file and name[0] not in "._" and _part(below, "kind") == self.kind:
                project = _part(below, "project")
                if self.project in (None, project):
                    found.append(_File(f.path, project))
        return sorted(found, key=lambda x: x.uri) or [_File("", "")]

    def read(self, partition):
        from pyarrow import fs

        if not partition.uri:
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(partition.uri) as stream:
            rows = []
            for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                if line.strip():
                    rows += self._rows(json.loads(line))
                if len(rows) > 1000:
                    yield self._batch(partition.project, rows)
                    rows = []
            yield self._batch(partition.project, rows)

    def _rows(self, answer: dict) -> list[tuple]:
        status, iid, page = answer.get("status", 200), answer.get("iid"), answer.get("page")
        if self.iid is not None and str(iid) != self.iid:
            return []
        if self.kind == "raw" and status in (200, 404):
            return [(iid, page, 0, answer | {"body": b64decode(answer["body"]) if status == 200 else None})]
        if status != 200:
            return []
        body = answer["body"] if isinstance(answer["body"], list) else [answer["body"]]
        return [(iid, page, i, b) for i, b in enumerate(body)]

    def _batch(self, project: str, rows: list[tuple]) -> pa.RecordBatch:
        keys = [pa.array([project] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32())))]
        values = [pa.array([_at(r[3], path) for r in rows], _ARROW[t]) for _, path, t in FIELDS[self.kind]]
        return pa.RecordBatch.from_arrays(keys + values, names=[n for n, _ in _KEYS] + [c for c, _, _ in FIELDS[self.kind]])


def read_host(spark: SparkSession, folder: str, kind: str, project: str | None = None, iid: int | None = None) -> DataFrame:
    spark.dataSource.register(ReviewHost)
    reader = spark.read.format("review_host").option("kind", kind)
    if project is not None:
        reader = reader.option("project", project)
    if iid is not None:
        reader = reader.option("iid", str(iid))
    return reader.load(folder)


def record_answers(answers: DataFrame, folder: str, most: int = 100_000) -> None:
    """Write answers (project, kind, answer as JSON text) in the layout that ``ReviewHost`` reads; ``most`` answers a file."""
    rows = answers.select("project", "kind", F.col("answer").alias("value")).repartition("project", "kind")
    rows.write.mode("append").option("maxRecordsPerFile", most).partitionBy("project", "kind").text(folder)


def changes(diffs: DataFrame) -> DataFrame:
    """File changes out of ``diffs``: binary where there is no diff, or a binary patch."""
    binary = F.col("raw_unidiff").isNull() | is_binary_patch(F.col("raw_unidiff"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return diffs.select("project", "iid", "page", "ord", "old_path", "new_path", flag("is_new"), flag("is_deleted"), flag("is_renamed"), binary.alias("is_binary"), "raw_unidiff", (F.coalesce("too_large", F.lit(False)) | F.coalesce("generated", F.lit(False))).alias("is_truncated"))


def files_at(wanted: DataFrame, raw: DataFrame) -> DataFrame:
    """wanted (project, ref, path) with the content of each file at its ref, null where the host has none."""
    once = raw.groupBy("project", "ref", "path").agg(F.max_by("content", F.struct(F.col("content").isNotNull(), F.coalesce("page", F.lit(-1)))).alias("content"))
    return wanted.join(once, ["project", "ref", "path"], "left")


def bundles(file_changes: DataFrame) -> DataFrame:
    """files and is_truncated of each change request, as one row."""
    one = F.struct("page", "ord", *[c for c in file_changes.columns if c not in ("project", "iid", "page", "ord", "is_truncated")])
    return file_changes.groupBy("project", "iid").agg(F.array_sort(F.collect_list(one)).alias("files"), F.bool_or("is_truncated").alias("is_truncated"))


def cached_bundles(cache: BucketedTable, requests: DataFrame, fetch, provider: str = "gitlab", most_files: int = 200, most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """bundles of requests (project, iid, head_sha), with ``from_cache``; read through ``cache`` (keyed by ``key``).

    What the cache holds under the hash of provider, project, number and head comes from there. ``fetch`` is called with the other
    requests only, if there are any, and gives their file changes; bundles of more files or bytes of diff than given, or that the
    host cut short, are stored. A changed head has another key."""
    spark = requests.sparkSession
    key = ids.cache_key(F.lit(provider), F.col("project"), F.col("iid"), F.col("head_sha"))
    asked = requests.select(key.alias("key"), "project", "iid", "head_sha").distinct()
    held = cache.read() if cache.manifest() else None
    hits = held.join(asked.select("key"), "key", "left_semi") if held is not None else None
    missing = asked.join(held.select("key"), "key", "left_anti") if held is not None else asked
    if not missing.head(1):
        return hits.withColumn("from_cache", F.lit(True))
    folder = f"{cache.path}/fetched/{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    new = bundles(fetch(missing)).join(missing, ["project", "iid"])
    new.select("key", "project", "iid", "head_sha", "files", "is_truncated").write.parquet(folder)  # the host is asked once
    new = spark.read.parquet(folder)
    size = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(F.octet_length(f["raw_unidiff"]), F.lit(0)))
    cache.upsert(new.filter((F.size("files") > most_files) | (size > most_bytes) | F.col("is_truncated")))
    fresh = new.withColumn("from_cache", F.lit(False))
    return fresh if hits is None else hits.withColumn("from_cache", F.lit(True)).unionByName(fresh)
