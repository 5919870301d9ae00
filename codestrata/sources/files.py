"""Sources and sinks: repositories, JSON Lines, dumps, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.functions import paths as P

STRICT = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def scan_repo(spark: SparkSession, root: str, ignore: list[str] | None = None, generated: list[str] | None = None, max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """path, text, size, language, is_generated of the files below root; unknown languages stay.

    Size, pruned folders and ignored patterns are tested on the files' metadata, so that Spark leaves those files out when it
    lists them and opens none."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.col("_metadata.file_path")
    keep = F.col("_metadata.file_size") <= max_bytes
    for d in P.PRUNED_DIRS:
        keep = keep & ~F.contains(at, F.lit(f"/{d}/"))
    raw = raw.filter(keep)
    out = raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"))
    out = out.filter(~P.matches_globs(F.col("path"), ignore or []))
    return out.withColumn("language", P.detect_language(F.col("path"))).withColumn("is_generated", P.looks_generated(F.col("path")) | P.matches_globs(F.col("path"), generated or []))


#: What the project scan takes and leaves.
CODE_EXTENSIONS = ("dart", "kt", "kts", "swift", "ts", "tsx", "js", "jsx", "java")
CONFIG_EXTENSIONS = ("yaml", "yml", "json", "arb", "xml", "plist", "toml", "gradle", "properties")
EXCLUDED_DIRS = (".git", ".dart_tool", ".fvm", ".idea", ".ide", ".vscode", "build", "Pods", ".gradle")
GENERATED_ENDS = (".g.dart", ".freezed.dart", ".gr.dart", "flutter_app_icons.dart")


def scan_project(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path) with an allowed extension (as written), outside excluded folders, not generated."""
    p = P.unix_path(F.col("path"))
    ok = F.regexp_extract(p, r"[^/]\.([^./]*)$", 1).isin(*CODE_EXTENSIONS, *CONFIG_EXTENSIONS)
    for e in GENERATED_ENDS:
        ok = ok & ~p.endswith(e)
    for d in EXCLUDED_DIRS:
        ok = ok & ~F.contains(F.concat(F.lit("/"), p, F.lit("/")), F.lit(f"/{d}/"))
    return files.filter(ok)


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with id and text; any malformed line, or one without them, fails the read."""
    rows = spark.read.schema(STRICT).option("mode", "FAILFAST").json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a record without {c}")).cast("string")).otherwise(F.col(c))
    return rows.withColumn("id", need("id")).withColumn("text", need("text"))


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """One variant for each well-formed line; blank and malformed ones are skipped."""
    rows = spark.read.text(path)
    return rows.withColumn("v", F.try_parse_json("value")).filter("v is not null").withColumnRenamed("value", "raw")


def read_strict_or_fallback(spark: SparkSession, path: str) -> DataFrame:
    """Strict rows if all are, else the alias mapping of the tolerant ones. The choice is one small aggregate."""
    from codestrata.operators.records import map_any_line

    raw = spark.read.text(path).filter("trim(value) != ''")
    v = F.try_parse_json("value")
    bad = raw.agg(F.count_if(v.isNull() | F.try_variant_get(v, "$.id", "string").isNull() | F.try_variant_get(v, "$.text", "string").isNull()).alias("n")).first()["n"]
    return read_strict(spark, path) if not bad else map_any_line(raw, "value")


def latest_dump(spark: SparkSession, root: str) -> str | None:
    """The folder with the greatest name below root."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()] if fs.exists(jpath) else []
    return f"{root.rstrip('/')}/{max(names)}" if names else None


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """name, path and n_records of the files that a dump's summary lists."""
    listed = "files array<struct<name:string,path:string,n_records:long>>"
    return spark.read.schema(listed).option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph_jsonl(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes under ordinals by (file, id), edges by ordinals."""
    from codestrata.operators.graph import ordinals

    # Written once, so that nodes and edges see the same ordinals.
    ordinals(nodes, ["file", "id"]).write.mode("overwrite").json(f"{path}/nodes")
    o = nodes.sparkSession.read.json(f"{path}/nodes").select("id", "ordinal")
    e = edges.join(o.withColumnsRenamed({"id": "src", "ordinal": "from"}), "src").join(o.withColumnsRenamed({"id": "dst", "ordinal": "to"}), "dst")
    e.select("from", "to", "label").write.mode("overwrite").json(f"{path}/edges")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) rows of a GraphML document, in order of part."""
    from codestrata.functions.text import xml_escape

    spark = nodes.sparkSession
    keys = [("d0", "node", "name"), ("d1", "node", "kind"), ("d2", "node", "language"), ("d3", "node", "file"), ("d4", "node", "fqn"), ("e0", "edge", "label")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'] + [f'  <key id="{k}" for="{f}" attr.name="{n}" attr.type="string"/>' for k, f, n in keys] + ['  <graph edgedefault="directed">']
    frame = lambda p, ls: spark.createDataFrame([(p, i, x) for i, x in enumerate(ls)], "part int, pos long, line string")
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), xml_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("part"), F.col("ordinal").alias("pos"), F.concat(F.lit('    <node id="n'), F.col("ordinal").cast("string"), F.lit('">'), *[data(k, c) for k, f, c in keys if f == "node"], F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.monotonically_increasing_id().alias("pos"), F.concat(F.lit('    <edge source="n'), F.col("from").cast("string"), F.lit('" target="n'), F.col("to").cast("string"), F.lit('">'), data("e0", "label"), F.lit("</edge>")).alias("line"))
    return frame(0, head).unionByName(n).unionByName(e).unionByName(frame(3, ["  </graph>", "</graphml>"]))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, files: int = 1) -> None:
    """Files whose lines, one file after the other by name, are the document: one by default, as readers of the format want it.

    What leads to the lines runs in all tasks; only sorted writing is by file."""
    graphml_lines(nodes, edges).repartitionByRange(files, "part", "pos").sortWithinPartitions("part", "pos").select("line").write.mode("overwrite").text(path)


def upsert(batch: DataFrame, path: str, key: str = "id", order: Column | None = None) -> None:
    """Idempotent: rows of ``batch`` replace rows of the table at ``path`` by key, null being a key like any other.

    Of several rows of a key the last by ``order`` stays (by all columns, where it is not given). The new version is written
    whole beside the table; the old one steps aside before it takes its place, and a table that an earlier run left aside
    is put back first, so that a crash loses nothing."""
    spark = batch.sparkSession
    of = spark._jvm.org.apache.hadoop.fs.Path
    here, new, aside = of(path), of(f"{path}.new"), of(f"{path}.old")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(here):
            fs.delete(aside, True)
        else:
            fs.rename(aside, here)
    last = [order.desc()] if order is not None else [F.to_json(F.struct(*batch.columns)).desc()]
    batch = batch.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*last))).filter("_r = 1").drop("_r")
    if not fs.exists(here):
        batch.write.parquet(path)
        return
    old = spark.read.parquet(path)
    keys = batch.select(F.col(key).alias("_key"))
    kept = old.join(keys, old[key].eqNullSafe(F.col("_key")), "left_anti")
    kept.unionByName(batch, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}.new")
    fs.rename(here, aside)
    fs.rename(new, here)
    fs.delete(aside, True)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        spark.createDataFrame([], schema).write.parquet(path)


def reset_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def persist_all(tables: dict[str, DataFrame], root: str, stamp: str) -> dict[str, str]:
    """Write tables as JSON Lines below ``root/stamp`` with a summary of names, paths and counts; gives the paths."""
    paths = {name: f"{root.rstrip('/')}/{stamp}/{name}" for name in tables}
    for name, df in tables.items():
        write_jsonl(df, paths[name])
    spark = next(iter(tables.values())).sparkSession
    counts = {name: spark.read.text(path).count() for name, path in paths.items()}
    spark.createDataFrame([([(n, p, counts[n]) for n, p in paths.items()],)], "files array<struct<name:string,path:string,n_records:long>>").coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/{stamp}/summary")
    return paths


def ingest_file(spark: SparkSession, path: str, table: str) -> None:
    """Upsert the records of one file, strict or mapped, into a table."""
    upsert(read_strict_or_fallback(spark, path).select("id", "text", "source", "embedding"), table)


def ingest_latest(spark: SparkSession, root: str, table: str, name: str = "rag_records") -> str | None:
    """Upsert the records of the latest dump below root into a table; the dump's folder, or None without one."""
    dump = latest_dump(spark, root)
    if dump is not None:
        ingest_file(spark, f"{dump}/{name}", table)
    return dump


def dump_rows(rows: DataFrame, root: str, kind: str, key: str) -> str:
    """Prompts, hits or step reports of a review, as JSON Lines in a folder named by what they belong to."""
    path = f"{root.rstrip('/')}/{key}/{kind}"
    write_jsonl(rows, path)
    return path
