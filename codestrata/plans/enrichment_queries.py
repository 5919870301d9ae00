"""Bodies and chunks with what is known of them, import lines and their names, escalation, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions import vectors as V
from codestrata.operators import context as K
from codestrata.operators import extract as X
from codestrata.plans.registry import query, table
from codestrata.plans.structure_queries import _FILES, _MANY_POINTS, _MANY_SPANS, _files, _points, _spans


@query(
    """WITH c AS (SELECT *, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank, round((conv_id % 10) / 10.0::DOUBLE, 6) AS confidence, conv_id * 37 % 5000 AS tokens FROM conversations)
SELECT conv_id, turn, (turn % 2 = 0 AND conv_id % 50 < 40 AND rank >= 2 AND (confidence < 0.7 OR tokens > 2500)) AS escalated FROM c"""
)
def escalations(spark, d):
    n, t = F.col("conv_id"), F.col("turn")
    severity = F.when(t % 3 == 0, "Low").when(t % 3 == 1, "Medium").otherwise("High")
    c = table(spark, d, "conversations").withColumn("confidence", F.round((n % 10) / 10, 6))
    return c.select("conv_id", "turn", V.should_escalate(F.when(t % 2 == 0, "fast").otherwise("slow"), severity, F.col("confidence"), n * 37 % 5000, n % 50).alias("escalated"))


@query(
    """SELECT c_custkey, list_sort(CASE c_custkey % 8 WHEN 0 THEN ['A' || c_custkey] WHEN 1 THEN ['B' || c_custkey, 'N' || c_nationkey] WHEN 2 THEN ['D' || c_custkey, 'N' || c_nationkey] WHEN 3 THEN ['h' || c_custkey]
WHEN 4 THEN ['E' || c_custkey] WHEN 5 THEN ['F' || c_custkey] WHEN 6 THEN ['g' || c_custkey] ELSE []::VARCHAR[] END) AS names FROM customer"""
)
def import_names(spark, d):
    """Each form of an import line: alias, braces, ``from``, include, dotted, ``use``, Go, and a line that is none."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    k = key.cast("string")
    forms = [("import 'x.dart' as A", k, ";"), ("import { B", k, ", type N", nation, " } from 'x';"), ("from a.b import D", k, ", N", nation), ("#include <lib/h", k, ".hpp>"), ("import static a.b.E", k, ";"), ("use a::b::F", k, ";"), ('import "host/p/g', k, '"'), ("final x", k, " = 1;")]
    line = F.coalesce(*[F.when(key % 8 == i, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in f])) for i, f in enumerate(forms)])
    return table(spark, d, "customer").select("c_custkey", F.array_sort(T.import_symbols(line)).alias("names"))


@query(
    """WITH p AS (SELECT p_partkey, unnest(['import ', '  include ', '#include <', 'using ', 'use ', chr(9) || 'require(', 'from ', 'x import y ', 'ximport ', 'reuse ']) || p_name AS line FROM part)
SELECT p_partkey, line, regexp_matches(line, '^\\s*(import |include |#include|using |use |require\\(|from )') OR contains(ltrim(line, ' ' || chr(9)), ' import ') AS found FROM p"""
)
def import_lines(spark, d):
    heads = ["import ", "  include ", "#include <", "using ", "use ", "\trequire(", "from ", "x import y ", "ximport ", "reuse "]
    lines = table(spark, d, "part").select("p_partkey", F.explode(F.transform(F.array(*[F.lit(h) for h in heads]), lambda h: F.concat(h, F.col("p_name")))).alias("line"))
    return lines.select("p_partkey", "line", X.import_like(F.col("line")).alias("found"))


# A file's body opens in line (file % 500) + 2 and closes ten lines on.
@query(
    f"""WITH s AS ({_MANY_SPANS}), p AS ({_MANY_POINTS}), j AS (SELECT o_orderkey, arg_min(struct_pack(s := start, e := "end"), ("end" - start, start, span_id)) AS b FROM p JOIN s ON p.file = s.file AND line BETWEEN start AND "end" GROUP BY o_orderkey),
f AS (SELECT DISTINCT file, file % 500 + 2 AS o FROM p)
SELECT p.o_orderkey, coalesce(j.b.s, CASE WHEN f.o BETWEEN p.line AND p.line + 4 THEN f.o END)::INT AS start, coalesce(j.b.e, CASE WHEN f.o BETWEEN p.line AND p.line + 4 THEN f.o + 10 END)::INT AS "end" FROM p LEFT JOIN j USING (o_orderkey) JOIN f USING (file)"""
)
def enclosing_bodies(spark, d):
    """The shortest span that holds a line, else the body that opens soon behind it."""
    points = _points(spark, d, _files(spark, d))
    body = F.concat(F.repeat(F.lit("\n"), (F.col("file") % 500 + 1).cast("int")), F.lit("void a() {\n"), F.repeat(F.lit("  x;\n"), F.lit(9)), F.lit("}\n"))
    files = points.select("file").distinct().select(F.col("file").alias("path"), body.alias("text"))
    targets = points.select(F.col("o_orderkey").alias("target_id"), F.col("file").alias("path"), "line")
    out = K.enclosing_body(targets, files, _spans(spark, d, _files(spark, d)).withColumnRenamed("file", "path"))
    return out.select(F.col("target_id").alias("o_orderkey"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


_CHUNKS = f"SELECT s_suppkey AS chunk_id, s_suppkey % {_FILES} AS file, (s_suppkey % 450)::INT AS start, (s_suppkey % 450 + 12)::INT AS \"end\" FROM supplier"


@query(
    f"""WITH s AS ({_MANY_SPANS}), c AS ({_CHUNKS}), w AS (SELECT chunk_id, span_id, s.start AS s, least(c."end", s."end") - greatest(c.start, s.start) AS o FROM c LEFT JOIN s ON c.file = s.file),
b AS (SELECT chunk_id, arg_min(span_id, (-CASE WHEN o > 0 THEN o WHEN o = 0 THEN 1 ELSE 0 END, greatest(0, -o), s, span_id)) AS symbol_id FROM w GROUP BY chunk_id),
g AS (SELECT o_custkey % {_FILES} AS file, count(*) FILTER (o_orderkey % 4 = 1) AS errors, count(*) FILTER (o_orderkey % 4 = 2) AS warnings FROM orders GROUP BY ALL),
h AS (SELECT p_partkey AS symbol_id, p_name AS hover FROM part WHERE p_size > 10),
r AS (SELECT l_partkey AS symbol_id, count(*) AS n, list_slice(list_sort(list(l_orderkey * 10 + l_linenumber)), 1, 32) AS sample FROM lineitem GROUP BY ALL)
SELECT c.chunk_id, b.symbol_id, c.file || '::C' || c.chunk_id AS fqn, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, hover, coalesce(r.n, 0) AS n_references, list_aggregate(r.sample, 'sum')::BIGINT AS sample FROM c JOIN b USING (chunk_id) LEFT JOIN g ON c.file = g.file LEFT JOIN h ON b.symbol_id = h.symbol_id LEFT JOIN r ON b.symbol_id = r.symbol_id"""
)
def enriched_chunks(spark, d):
    """Chunks with their best symbols, diagnostics, hovers and references; of these the first 32 are kept beside their number."""
    k, files = F.col("s_suppkey"), _files(spark, d)
    chunks = table(spark, d, "supplier").select(k.alias("chunk_id"), (k % files).cast("string").alias("file"), F.lit("method").alias("kind"), F.concat(F.lit("C"), k.cast("string")).alias("symbol_path"), (k % 450).cast("int").alias("start"), (k % 450 + 12).cast("int").alias("end"))
    symbols = _spans(spark, d, _files(spark, d)).select(F.col("span_id").alias("symbol_id"), F.col("file").cast("string").alias("file"), "start", "end")
    problems = table(spark, d, "orders").select((F.col("o_custkey") % files).cast("string").alias("file"), (F.col("o_orderkey") % 4).cast("int").alias("severity"))
    hovers = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("```dart\n\n "), "p_name", F.lit("\nmore\n```")).alias("text"))
    uses = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.lit("f").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    out = K.enrich_chunks(chunks, symbols, problems, hovers, uses)
    sample = F.aggregate("references", F.lit(0).cast("long"), lambda a, r: a + r["line"])
    return out.select("chunk_id", "symbol_id", "fqn", "errors", "warnings", "hover", "n_references", sample.alias("sample"))
