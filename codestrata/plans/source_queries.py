"""Sources and sinks: what is written to a folder is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.operators import records as M
from codestrata.plans.registry import query, scratch, table
from codestrata.sources import files as S
from codestrata.streaming import jsonl


def _records(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "text", "source")


@query("SELECT doc_id::VARCHAR AS id, text, source FROM documents")
def jsonl_strict(spark, d):
    path = scratch(spark)
    S.write_jsonl(_records(spark, d), path)
    return S.read_strict(spark, path).drop("embedding")


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 3 = 0")
def jsonl_tolerant(spark, d):
    """A third of the lines are records, a third are cut short, a third blank."""
    path = scratch(spark)
    k = F.col("doc_id") % 3
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text"))
    table(spark, d, "documents").select(F.when(k == 0, whole).when(k == 1, F.left(whole, F.char_length(whole) - 1)).otherwise(" ").alias("line")).write.text(path)
    return S.read_tolerant(spark, path).select(F.try_variant_get("v", "$.id", "string").alias("id"))


@query("SELECT url AS id, 'Page p' || page_id || ' (file: ' || url || ')' AS text, url AS source FROM pages")
def jsonl_fallback(spark, d):
    """Records under other names: not all strict, so all are mapped."""
    path = scratch(spark)
    S.write_jsonl(table(spark, d, "pages").select(F.col("url").alias("uuid"), F.lit("Page").alias("kind"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("file")), path)
    return S.read_strict_or_fallback(spark, path).select("id", "text", "source")


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text FROM documents")
def stream_ingest(spark, d):
    """A folder of records streamed into a table, twice from the start: the second time changes nothing."""
    folder, target = scratch(spark), scratch(spark)
    S.write_jsonl(_records(spark, d).select("id", F.md5(F.col("text").cast("binary")).alias("body"), F.col("id").alias("name"), F.lit("Function").alias("kind")), folder)
    for _ in range(2):
        records = jsonl.record_stream(spark, folder)
        jsonl.upsert_stream(records, target, scratch(spark)).awaitTermination()
    return spark.read.parquet(target).select("id", "text")


@query("SELECT o_custkey AS id, max(o_totalprice) AS best FROM (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey) GROUP BY o_custkey")
def upserted(spark, d):
    """Orders by customer in two batches into a table that is ensured and reset first: the last order of each stays."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("best"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    path = scratch(spark)
    S.ensure_table(spark, path, o.schema)
    S.reset_table(spark, path, o.schema)
    middle = F.lit("1995-01-01").cast("timestamp")
    for part in (o.filter(F.col("at.o_orderdate") < middle), o.filter(F.col("at.o_orderdate") >= middle)):
        S.upsert(part, path, order=F.col("at"))
    return spark.read.parquet(path).select("id", "best")


def _geography(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    none = F.lit("")
    nodes = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("Region").alias("kind"), none.alias("language"), F.lit("a & b").alias("file"), F.col("r_name").alias("fqn"))
    nodes = nodes.union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name", F.lit("Nation"), none, F.lit("b<c>"), "n_name"))
    edges = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.lit("declares").alias("label"))
    return nodes, edges


_ORDINALS = "nodes AS (SELECT *, row_number() OVER (ORDER BY file, id) - 1 AS o FROM (SELECT 'r' || r_regionkey AS id, r_name AS name, 'Region' AS kind, 'a & b' AS file FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation', 'b<c>' FROM nation))"


@query(f"WITH {_ORDINALS} SELECT a.o AS \"from\", b.o AS \"to\", 'declares' AS label FROM nation JOIN nodes a ON a.id = 'r' || n_regionkey JOIN nodes b ON b.id = 'n' || n_nationkey")
def graph_jsonl(spark, d):
    path = scratch(spark)
    S.write_graph_jsonl(*_geography(spark, d), path)
    return spark.read.json(f"{path}/edges").select("from", "to", "label")


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""WITH {_ORDINALS}, x AS (SELECT *, {_XML.format("file")} AS f FROM nodes)
SELECT '    <node id="n' || o || '"><data key="d0">' || name || '</data><data key="d1">' || kind || '</data><data key="d2"></data><data key="d3">' || f || '</data><data key="d4">' || name || '</data></node>' AS line FROM x
UNION ALL SELECT '    <edge source="n' || a.o || '" target="n' || b.o || '"><data key="e0">declares</data></edge>' FROM nation JOIN nodes a ON a.id = 'r' || n_regionkey JOIN nodes b ON b.id = 'n' || n_nationkey
UNION ALL SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="d0" for="node" attr.name="name" attr.type="string"/>', '  <key id="d1" for="node" attr.name="kind" attr.type="string"/>', '  <key id="d2" for="node" attr.name="language" attr.type="string"/>',
 '  <key id="d3" for="node" attr.name="file" attr.type="string"/>', '  <key id="d4" for="node" attr.name="fqn" attr.type="string"/>', '  <key id="e0" for="edge" attr.name="label" attr.type="string"/>', '  <graph edgedefault="directed">', '  </graph>', '</graphml>'])"""
)
def graphml(spark, d):
    from codestrata.operators.graph import ordinals

    nodes, edges = _geography(spark, d)
    numbered = ordinals(nodes, ["file", "id"])
    o = numbered.select("id", "ordinal")
    linked = edges.join(o.withColumnsRenamed({"id": "src", "ordinal": "from"}), "src").join(o.withColumnsRenamed({"id": "dst", "ordinal": "to"}), "dst")
    path = scratch(spark)
    S.write_graphml(numbered, linked, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT lang AS folder, sum(strlen(text) + 1)::BIGINT AS bytes, true AS generated FROM documents WHERE text IS NOT NULL GROUP BY lang")
def repo_scan(spark, d):
    """All documents in files below a folder for each language, which a pattern marks as generated."""
    path = scratch(spark)
    # Files of at most a thousand documents: one over the scan's bound would be left out.
    docs = table(spark, d, "documents").filter("text is not null").select("lang", "text")
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    found = S.scan_repo(spark, path, max_bytes=1 << 30, ignore=["**/_SUCCESS"], generated=["**/lang=*/*"])
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("folder")).agg(F.sum("size").alias("bytes"), F.bool_and("is_generated").alias("generated"))


_EXT = "CASE p_partkey % 8 WHEN 0 THEN 'dart' WHEN 1 THEN 'rs' WHEN 2 THEN 'java' WHEN 3 THEN 'yaml' WHEN 4 THEN 'md' WHEN 5 THEN 'g.dart' WHEN 6 THEN 'arb' ELSE 'kts' END"
_DIR = "CASE p_size % 5 WHEN 0 THEN 'build' WHEN 1 THEN 'ios/Pods' ELSE 'lib' END"


@query(f"SELECT {_DIR} || '/p' || p_partkey || '.' || {_EXT} AS path FROM part WHERE p_size % 5 > 1 AND p_partkey % 8 IN (0, 2, 3, 6, 7)")
def project_scan(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("dart", "rs", "java", "yaml", "md", "g.dart", "arb", "kts")]), (k % 8 + 1).cast("int"))
    folder = F.when(z % 5 == 0, "build").when(z % 5 == 1, "ios/Pods").otherwise("lib")
    return S.scan_project(table(spark, d, "part").select(F.concat(folder, F.lit("/p"), k.cast("string"), F.lit("."), ext).alias("path")))


@query("SELECT p_partkey, p_partkey % 4 = 1 AS ignored, p_partkey % 4 IN (0, 2) AS generated FROM part")
def globs(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 4 == 0, "lib/a.g.dart").when(k % 4 == 1, "a/b/skip.txt").when(k % 4 == 2, "x/y.freezed.dart").otherwise("lib/a.dart"))
    return table(spark, d, "part").select("p_partkey", P.matches_globs(path, ["**/skip.*", "[z-"]).alias("ignored"), P.looks_generated(path).alias("generated"))


@query("SELECT count(*) AS n, 'b' AS dump FROM documents")
def latest_ingest(spark, d):
    """Two dumps of records, of which the later is read and upserted, with its summary."""
    root, target = scratch(spark), scratch(spark)
    rows = _records(spark, d)
    S.persist_all({"rag_records": rows.limit(1)}, root, "a")
    S.persist_all({"rag_records": rows}, root, "b")
    dump = S.ingest_latest(spark, root, target)
    n = S.read_summary(spark, f"{dump}/summary").filter("name = 'rag_records'").select(F.col("n_records").alias("n"))
    return n.filter(F.col("n") == spark.read.parquet(target).count()).withColumn("dump", F.lit(dump.rsplit("/", 1)[-1]))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'dart' WHEN 1 THEN 'rust' ELSE 'unknown' END AS language, count(*) AS files, sum(strlen(p_name))::BIGINT AS bytes FROM part GROUP BY 1")
def files_by_language(spark, d):
    k = F.col("p_partkey")
    return M.file_summary(table(spark, d, "part").select(F.when(k % 3 == 0, "a.dart").when(k % 3 == 1, "b.rs").otherwise("c").alias("path"), F.col("p_name").alias("text")))
