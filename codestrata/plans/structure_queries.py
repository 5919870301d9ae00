"""Intervals, runs and counts over chunks, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import diff as D
from codestrata.operators import intervals as I
from codestrata.operators import records as M
from codestrata.operators.graph import counts_by
from codestrata.plans.registry import query, table

# Intervals of lines: a line item as the piece [quantity, quantity + size) of its supplier's file.
_PIECES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS file, (l_partkey % 2000)::INT AS start, (l_partkey % 2000 + l_quantity)::INT AS \"end\", round(l_discount, 2) AS score FROM lineitem"


def _pieces(spark, d):
    r = table(spark, d, "lineitem")
    return r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 2000).cast("int").alias("start"), (F.col("l_partkey") % 2000 + F.col("l_quantity")).cast("int").alias("end"), F.round("l_discount", 2).alias("score"))


@query(
    f"""WITH p AS ({_PIECES}), r AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
b AS (SELECT *, sum(CASE WHEN start <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY start, id) AS b FROM r)
SELECT file, min(start) AS start, max("end") AS "end", count(*) AS n, arg_max(id, (score, -start, -id)) AS best_id, max(score) AS best_score FROM b GROUP BY file, b"""
)
def stitch_blocks(spark, d):
    return I.merge_intervals(_pieces(spark, d), ["file"])


# Spans: parts as symbols [p_partkey % 500, + p_size] in one of 20 files; points: orders.
_SPANS_OF = "SELECT p_partkey AS span_id, p_partkey % {files} AS file, (p_partkey % 500)::INT AS start, (p_partkey % 500 + p_size)::INT AS \"end\" FROM part"
_SPANS = _SPANS_OF.format(files=20)
_POINTS_OF = "SELECT o_orderkey, o_custkey % {files} AS file, (o_orderkey % 520)::INT AS line FROM orders"
_POINTS = _POINTS_OF.format(files=20)
# The same, with some fifty spans a file, so that files grow in number and not in size.
_FILES = "(SELECT count(*) // 50 + 20 FROM part)"
_MANY_SPANS, _MANY_POINTS = _SPANS_OF.format(files=_FILES), _POINTS_OF.format(files=_FILES)


def _files(spark, d):
    return table(spark, d, "part").count() // 50 + 20


def _spans(spark, d, files=20):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("span_id"), (k % files).alias("file"), (k % 500).cast("int").alias("start"), (k % 500 + F.col("p_size")).cast("int").alias("end"))


def _points(spark, d, files=20):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % files).alias("file"), (F.col("o_orderkey") % 520).cast("int").alias("line"))


@query(f'WITH s AS ({_SPANS}), p AS ({_POINTS}), j AS (SELECT o_orderkey, arg_min(span_id, ("end" - start, start, span_id)) AS span_id FROM p JOIN s ON p.file = s.file AND line BETWEEN start AND "end" GROUP BY o_orderkey) SELECT p.o_orderkey, p.file, p.line, j.span_id FROM p LEFT JOIN j USING (o_orderkey)')
def smallest_enclosing(spark, d):
    return I.smallest_enclosing(_points(spark, d), _spans(spark, d), "file", "line", "o_orderkey").select("o_orderkey", "file", "line", "span_id")


@query(f'WITH s AS ({_SPANS}) SELECT t.span_id AS target_id, s.span_id, row_number() OVER (PARTITION BY t.span_id ORDER BY s.start, s.span_id)::INT AS ord FROM s JOIN s t ON s.file = t.file AND s.start >= t.start AND s."end" <= t."end" AND s.span_id <> t.span_id QUALIFY ord <= 12')
def siblings(spark, d):
    s = _spans(spark, d).withColumnRenamed("file", "path")
    return I.siblings(s, s).select("target_id", "span_id", "ord")


@query(
    f"""WITH s AS ({_SPANS}), c AS (SELECT s_suppkey AS chunk_id, s_suppkey % 25 AS file, (s_suppkey % 450)::INT AS start, (s_suppkey % 450 + 12)::INT AS "end" FROM supplier),
j AS (SELECT chunk_id, span_id, s.start AS s, CASE WHEN span_id IS NOT NULL THEN least(c."end", s."end") - greatest(c.start, s.start) END AS o FROM c LEFT JOIN s ON c.file = s.file),
w AS (SELECT *, CASE WHEN o > 0 THEN o WHEN o = 0 THEN 1 ELSE 0 END AS ov, CASE WHEN o IS NOT NULL THEN greatest(0, -o) END AS g FROM j)
SELECT chunk_id, arg_min(span_id, (-ov, g, s, span_id)) AS symbol_id, max(ov)::INT AS overlap, arg_min(g, (-ov, g, s, span_id))::INT AS gap FROM w GROUP BY chunk_id"""
)
def best_overlap(spark, d):
    k = F.col("s_suppkey")
    chunks = table(spark, d, "supplier").select(k.alias("chunk_id"), (k % 25).alias("file"), (k % 450).cast("int").alias("start"), (k % 450 + 12).cast("int").alias("end"))
    out = I.best_overlap(chunks, _spans(spark, d).withColumnRenamed("span_id", "symbol_id"), "file")
    return out.select("chunk_id", "symbol_id", F.coalesce("overlap", F.lit(0)).cast("int").alias("overlap"), F.col("gap").cast("int").alias("gap"))


@query("WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events), n AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 3600 THEN 0 ELSE 1 END AS new FROM e), c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM n) SELECT user_id, cluster, count(*) AS n, min(s) AS first_s, max(s) AS last_s FROM c GROUP BY user_id, cluster")
def cluster_gap(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("s"))
    return I.clusters(e, ["user_id"], "s", 3600, tie=["event_id"]).groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_id FROM conversations")
def prev_next(spark, d):
    return I.prev_next(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")


@query(f'WITH s AS ({_SPANS}), p AS ({_POINTS}) SELECT s.span_id AS range_id, min(line) AS line FROM s LEFT JOIN p ON p.file = s.file AND line BETWEEN start AND "end" GROUP BY s.span_id')
def first_in_range(spark, d):
    return I.first_in_range(_points(spark, d), _spans(spark, d).withColumnRenamed("span_id", "range_id"), "file")


@query(f'WITH s AS ({_MANY_SPANS}) SELECT a.span_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey % {_FILES} AS file, (p_partkey * 7 % 300)::INT AS start, (p_partkey * 7 % 300 + p_size % 3)::INT AS "end" FROM part WHERE p_size > 25) b WHERE a.file = b.file AND a.start <= b."end" AND b.start <= a."end")')
def anti_overlapping(spark, d):
    files = _files(spark, d)
    s = _spans(spark, d, files)
    k = F.col("p_partkey")
    old = table(spark, d, "part").filter("p_size > 25").select((k % files).alias("file"), (k * 7 % 300).cast("int").alias("start"), (k * 7 % 300 + F.col("p_size") % 3).cast("int").alias("end"))
    return I.anti_overlapping(s, old, ["file"]).select("span_id")


@query("SELECT l_orderkey, l_linenumber, (l_quantity >= 10 AND l_quantity + 2 <= 20) OR (l_quantity >= 30 AND l_quantity + 2 <= 45) AS ok FROM lineitem")
def within_ranges(spark, d):
    ranges = F.array(F.struct(F.lit(10).alias("start"), F.lit(20).alias("end")), F.struct(F.lit(30).alias("start"), F.lit(45).alias("end")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", I.within_any(F.col("l_quantity"), F.col("l_quantity") + 2, ranges).alias("ok"))


@query("SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n FROM events GROUP BY 1")
def counts_by_kind(spark, d):
    return counts_by(table(spark, d, "events"), "event_type")


@query("SELECT source AS file, count(*) FILTER (toxic = 1) AS errors, count(*) FILTER (toxic = 2) AS warnings FROM documents JOIN labels USING (doc_id) GROUP BY source")
def diagnostics(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("file"), F.col("toxic").alias("severity"))
    return M.diagnostics(rows)


@query("SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) > 200 OR sum(strlen(text)) > 5242880 AS is_large FROM documents")
def bundle_is_large(spark, d):
    return D.is_large(table(spark, d, "documents").select(F.col("text").alias("raw_unidiff")))


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def top_per_group(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("l_orderkey", "l_suppkey", "l_linenumber")


@query(
    """WITH c AS (SELECT doc_id * 10000 + i AS id, doc_id AS file, (i * 3)::INT AS s, least(i * 3 + 4, len(string_split(text, chr(10))))::INT AS e, string_split(text, chr(10)) AS l, (doc_id * 7 + i * 13) % 50 / 50.0::DOUBLE AS score FROM documents, LATERAL (SELECT unnest(range((len(string_split(text, chr(10))) + 2) // 3)) AS i) WHERE (doc_id + i) % 3 <> 0),
r AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
b AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s, id) AS b FROM r),
g AS (SELECT file, min(s) AS start, max(e) AS "end", count(*) AS n, arg_max(id, (score, -s, -id)) AS best_id, max(score) AS best_score, any_value(l) AS l FROM b GROUP BY file, b)
SELECT file, start, "end", n, best_id, best_score, array_to_string(l[start + 1:"end"], chr(10)) AS code FROM g WHERE array_to_string(l[start + 1:"end"], chr(10)) <> '' ORDER BY best_score DESC, file, start LIMIT 50"""
)
def code_results(spark, d):
    from codestrata.operators.context import code_results as stitched

    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\r", "").alias("text"))
    n = F.size(F.split("text", "\n", -1))
    c = docs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 3)))).filter((F.col("doc_id") + F.col("i")) % 3 != 0)
    c = c.select((F.col("doc_id") * 10000 + F.col("i")).alias("id"), F.col("doc_id").alias("file"), (F.col("i") * 3).cast("int").alias("start_row"), F.least(F.col("i") * 3 + 4, F.col("n")).cast("int").alias("end_row"), ((F.col("doc_id") * 7 + F.col("i") * 13) % 50 / 50.0).alias("score"))
    hits = c.select("id", "score", F.lit(1).alias("rank"))
    return stitched(hits, c.drop("score"), docs.withColumnRenamed("doc_id", "path"), 50).drop("rank")
