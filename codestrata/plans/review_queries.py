"""Diffs, findings and drafts, made of orders, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import text as T
from codestrata.functions import vectors as V
from codestrata.operators import diff as D
from codestrata.operators import findings as N
from codestrata.plans.registry import query, scratch, table

# A raw diff for each customer with a file for each of its orders: changed, deleted or binary.
_HUNKS = ["@@ -1,3 +1,4 @@\n a", "\n-b\n+B\n+C\n d\n@@ -10 +11,2 @@ void f()\n k\n+l\n\\ No newline at end of file\n"]


def _changes(spark, d):
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("o"), key, F.lit(".dart"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"))
    old = F.concat(F.lit("--- a/"), name, F.lit("\n"))
    changed = F.concat(head, old, F.lit("+++ b/"), name, F.lit("\n" + _HUNKS[0]), key, F.lit(_HUNKS[1]))
    deleted = F.concat(head, old, F.lit("+++ /dev/null\n@@ -1,2 +0,0 @@\n-one"), key, F.lit("\n-two\n"))
    part = F.when(n % 3 == 0, changed).when(n % 3 == 1, deleted).otherwise(F.concat(head, F.lit("GIT binary patch\nliteral 0\n")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("x")))), lambda r: r["x"]), "")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("bundle")).agg(parts.alias("raw"))


@query("SELECT o_custkey AS bundle, CASE WHEN o_orderkey % 3 < 2 THEN 'o' || o_orderkey || '.dart' END AS old_path, CASE WHEN o_orderkey % 3 = 0 THEN 'o' || o_orderkey || '.dart' END AS new_path FROM orders")
def split_raw_diff(spark, d):
    return D.split_raw(_changes(spark, d), "raw").select("bundle", "old_path", "new_path")


@query(
    """SELECT 'o' || o_orderkey || '.dart' AS path, hunk, op, old_line, new_line, replace(content, '#', o_orderkey::VARCHAR) AS content FROM orders JOIN (VALUES (0, 1, 'context', 1, 1, 'a#'), (0, 1, 'removed', 2, NULL, 'b'), (0, 1, 'added', NULL, 2, 'B'), (0, 1, 'added', NULL, 3, 'C'),
 (0, 1, 'context', 3, 4, 'd'), (0, 2, 'context', 10, 11, 'k'), (0, 2, 'added', NULL, 12, 'l'), (1, 1, 'removed', 1, NULL, 'one#'), (1, 1, 'removed', 2, NULL, 'two')) v(m, hunk, op, old_line, new_line, content) ON o_orderkey % 3 = m"""
)
def diff_lines(spark, d):
    files = D.split_raw(_changes(spark, d), "raw").withColumn("path", F.coalesce("new_path", "old_path"))
    return D.parse_lines(files, "path", "body")


# Documents as diffs: the old version has every line, the new one drops lines of a number that 5 divides.
@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
o AS (SELECT doc_id, i, CASE WHEN i % 5 = 0 THEN 'removed' ELSE 'context' END AS op FROM l)
SELECT doc_id, i::INT AS old_line, CASE WHEN op = 'context' THEN sum(CASE WHEN op = 'context' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) END::INT AS new_line FROM o"""
)
def diff_numbering(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    body = F.transform("l", lambda x, i: F.concat(F.when((i + 1) % 5 == 0, "-").otherwise(" "), F.regexp_replace(x, "\r", "")))
    diff = docs.select("doc_id", F.concat(F.lit("@@ -1,9 +1,9 @@\n"), F.array_join(body, "\n"), F.lit("\n")).alias("diff"))
    return D.parse_lines(diff, "doc_id", "diff").select("doc_id", "old_line", "new_line")


@query(
    """WITH a AS (SELECT DISTINCT l_suppkey % 997 * 1000 + l_partkey % 400 AS line_id, l_suppkey % 997 AS path, (l_partkey % 400)::INT AS line FROM lineitem),
s AS (SELECT p_partkey AS span_id, p_partkey % 997 AS path, (p_partkey % 400)::INT AS decl_line, (p_partkey % 400)::INT AS start, (p_partkey % 400 + p_size)::INT AS "end" FROM part),
j AS (SELECT line_id, arg_min(span_id, ("end" - start, start, span_id)) AS span_id FROM a JOIN s ON a.path = s.path AND line BETWEEN start AND "end" GROUP BY line_id),
p AS (SELECT a.path, line, coalesce(j.span_id, -1) AS own, decl_line FROM a LEFT JOIN j USING (line_id) LEFT JOIN s ON s.span_id = j.span_id),
n AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY path, own ORDER BY line) <= 2 THEN 0 ELSE 1 END AS new FROM p),
c AS (SELECT *, sum(new) OVER (PARTITION BY path, own ORDER BY line ROWS UNBOUNDED PRECEDING) AS c FROM n),
g AS (SELECT path, own, c, min(line) AS start_line, max(line) AS end_line, coalesce(bool_or(line = decl_line), false) AS t FROM c GROUP BY path, own, c)
SELECT path, CASE WHEN own >= 0 THEN own END AS span_id, start_line, end_line, CASE WHEN t AND own >= 0 THEN 'symbol' WHEN start_line < end_line THEN 'range' ELSE 'line' END AS target_kind FROM g"""
)
def diff_targets(spark, d):
    r = table(spark, d, "lineitem")
    path, line = F.col("l_suppkey") % 997, F.col("l_partkey") % 400
    added = r.select((path * 1000 + line).alias("line_id"), path.alias("path"), line.cast("int").alias("line")).distinct()
    k = F.col("p_partkey")
    symbols = table(spark, d, "part").select(k.alias("span_id"), (k % 997).alias("path"), (k % 400).cast("int").alias("decl_line"), (k % 400).cast("int").alias("start"), (k % 400 + F.col("p_size")).cast("int").alias("end"))
    return D.targets(added, symbols)


@query("SELECT 'o' || o_orderkey || '.dart' AS path FROM orders WHERE o_orderkey % 3 = 0")
def candidate_paths(spark, d):
    files = D.split_raw(_changes(spark, d), "raw").withColumn("change_id", F.coalesce("old_path", "new_path")).withColumn("is_binary", D.is_binary_patch(F.col("body")) | F.contains("body", F.lit("GIT binary patch"))).withColumn("is_deleted", F.col("new_path").isNull())
    return D.candidate_paths(files, D.parse_lines(files, "change_id", "body"))


@query("SELECT 'o' || o_orderkey || '.dart' AS path, max(line) FILTER (line > 0)::INTEGER AS last_added, count(*) FILTER (line > 0)::INTEGER AS n FROM orders, (VALUES (2), (3), (12)) v(line) WHERE o_orderkey % 3 = 0 GROUP BY 1")
def added_lines(spark, d):
    files = D.split_raw(_changes(spark, d), "raw").withColumn("path", F.coalesce("new_path", "old_path"))
    return D.added_lines(D.parse_lines(files, "path", "body"), "path").select("path", F.array_max("added").alias("last_added"), F.size("added").alias("n"))


# Answers of a model, one an order: a think block, a finding, one outside of what is allowed, a duplicate, one without a title.
_ANSWER = [
    "<think>ignore\nANCHOR: 1-1\nTITLE: never\nBODY: never\n</think>\n<<<BEGIN_STRICT>>>\nANCHOR: ", "start", "-", "stop", "\nSEVERITY: high\nTITLE: First ", "key", "\nBODY: See lines ", "start", "-", "stop", " and line 99.\nMore of it.\nPATCH:\n```diff\n-a\n+b\n```\nANCHOR: 90-91\nTITLE: Outside\nBODY: dropped\nANCHOR: ",
    "start", "-", "stop", "\nTITLE: FIRST ", "key", "\nBODY: a duplicate\nTITLE lost\nANCHOR: ", "stop", "-", "stop", "\nTITLE: Second\nBODY: ", "o_orderpriority", "\n<<<END_STRICT>>> tail",
]


@query(
    """WITH a AS (SELECT o_orderkey AS target_id, (o_orderkey % 20 + 1)::INTEGER AS start, (o_orderkey % 20 + 2 + o_orderkey % 5)::INTEGER AS stop, o_orderpriority FROM orders)
SELECT target_id, start, stop AS "end", 'High' AS severity, 'First ' || target_id AS title, 'See lines ' || start || '-' || stop || ' and these lines.' || chr(10) || 'More of it.' AS body, '-a' || chr(10) || '+b' AS patch FROM a
UNION ALL SELECT target_id, stop, stop, 'Low', 'Second', o_orderpriority, NULL FROM a"""
)
def parse_findings(spark, d):
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").withColumns({"start": (n % 20 + 1).cast("string"), "stop": (n % 20 + 2 + n % 5).cast("string"), "key": n.cast("string")})
    raw = F.concat(*(F.col(p) if p in ("start", "stop", "key", "o_orderpriority") else F.lit(p) for p in _ANSWER))
    return N.parse_findings(rows.select(n.alias("target_id"), raw.alias("raw"), F.array(F.struct(F.lit(1).alias("start"), F.lit(40).alias("end"))).alias("allowed")))


def _drafts(spark, d):
    """Conversations as drafts: the conversation is the file, turns are anchors."""
    n, t = F.col("conv_id"), F.col("turn")
    return table(spark, d, "conversations").select((n * 100 + t).alias("id"), F.concat(F.lit("c"), (n % 40).cast("string")).alias("path"), F.when(n % 7 == 0, None).otherwise((n * 5 + t * 9).cast("int")).alias("start"), F.when(n % 7 == 0, None).otherwise((n * 5 + t * 9 + 2).cast("int")).alias("end"), F.when(t % 3 == 0, "High").when(t % 3 == 1, "Medium").otherwise("Low").alias("severity"), F.col("text").alias("body"))


_DRAFTS = "SELECT conv_id * 100 + turn AS id, 'c' || conv_id % 40 AS path, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE (conv_id * 5 + turn * 9)::INT END AS start, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE (conv_id * 5 + turn * 9 + 2)::INT END AS \"end\", CASE turn % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS severity, text AS body FROM conversations"


@query(
    f"""WITH d AS ({_DRAFTS}), l AS (SELECT *, lag(id) OVER w AS pid, lag(start) OVER w AS ps, lag("end") OVER w AS pe FROM d WINDOW w AS (PARTITION BY path ORDER BY start NULLS LAST, id)),
n AS (SELECT *, CASE WHEN pid IS NOT NULL AND (start IS NULL OR ps IS NULL OR (start <= pe AND ps <= "end") OR greatest(start - pe, ps - "end") <= 10) THEN 0 ELSE 1 END AS new FROM l)
SELECT id, path, sum(new) OVER (PARTITION BY path ORDER BY start NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS cluster FROM n"""
)
def anchor_clusters(spark, d):
    return N.anchor_clusters(_drafts(spark, d)).select("id", "path", "cluster")


@query()
def dedup_drafts(spark, d):
    """Greedy and order-sensitive: held against a Python version in the tests."""
    return N.dedup_drafts(_drafts(spark, d)).select("id", "path", "cluster", "theme", "value")


@query(f"WITH d AS ({_DRAFTS}) SELECT id, path FROM d QUALIFY row_number() OVER (PARTITION BY path ORDER BY CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, length(body) DESC, contains(body, '```diff') DESC, id) = 1")
def pick_best(spark, d):
    return N.pick_best(_drafts(spark, d), ["path"]).select("id", "path")


@query("WITH k AS (SELECT conv_id, turn, role || ':' || turn || '|line#' || left(sha256(text), 8) AS key FROM conversations), m AS (SELECT DISTINCT key FROM k WHERE conv_id % 3 = 0) SELECT conv_id, turn, key, CASE WHEN key IN (SELECT key FROM m) THEN 'skip' ELSE 'create' END AS action FROM k")
def publish_plan(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("path"), F.col("turn").alias("line"), F.lit("line").alias("kind"), F.substring(F.sha2("text", 256), 1, 8).alias("snippet_hash"))
    key = ids.idempotency_key(F.col("path"), F.col("line"), F.col("kind"), F.col("snippet_hash"))
    notes = c.filter("conv_id % 3 = 0").select(F.concat(F.lit("text <!-- review:key="), key, F.lit(" --> more <!-- review:key=other -->")).alias("body"))
    return N.publish_plan(c, N.markers(notes)).select("conv_id", "turn", "key", "action")


@query("WITH k AS (SELECT conv_id, turn, role || ':' || turn || '|line#' || left(sha256(text), 8) AS key FROM conversations) SELECT conv_id, turn, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE conv_id % 3 = 0)")
def unpublished(spark, d):
    return publish_plan(spark, d).filter("action = 'create'").drop("action")


@query("SELECT conv_id, turn, round(greatest(0.0, least(1.0, 0.6::DOUBLE + CASE WHEN contains(text, '```') OR contains(text, '::') OR contains(text, '()') THEN 0.15 ELSE 0 END + CASE WHEN strlen(text) > 300 THEN 0.05 ELSE 0 END - CASE WHEN conv_id * 900 > 20000 THEN 0.05 ELSE 0 END) - CASE WHEN turn % 2 = 1 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS confidence, CASE WHEN turn % 5 <> 4 AND conv_id % 50 < 40 AND (conv_id * 20 > 2500 OR turn % 5 = 0 OR turn % 5 IN (1, 2) AND turn * 30 >= 80) THEN 'slow' ELSE 'fast' END AS route, floor(length(text) / 4)::BIGINT AS tokens FROM conversations")
def confidence_and_route(spark, d):
    n, t = F.col("conv_id"), F.col("turn")
    kind = F.when(t % 5 == 0, "symbol").when(t % 5 == 3, "line").when(t % 5 == 4, "file").otherwise("range")
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.round(V.confidence(F.col("text"), n * 900, t % 2 == 1), 6).alias("confidence"), V.initial_route(n * 20, kind, t * 30, n % 50).alias("route"), V.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant FROM conversations")
def role_counts(spark, d):
    return N.counts(table(spark, d, "conversations"), "role", ["user", "assistant"])


@query(
    """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, l, l[1 + doc_id % len(l)] AS line FROM t),
r AS (SELECT doc_id, list_transform(l, lambda x: regexp_replace(x, '[ \\t\\n\\x0b\\f\\r]+$', '')) AS l, regexp_replace(line, '[ \\t\\n\\x0b\\f\\r]+$', '') AS line FROM b)
SELECT doc_id, true AS applies, list_position(l, line)::INT AS line FROM r WHERE line <> ''"""
)
def patch_positions(spark, d):
    docs = table(spark, d, "documents").withColumn("l", F.split("text", "\n", -1))
    docs = docs.withColumn("line", F.get("l", (F.col("doc_id") % F.size("l")).cast("int"))).filter(T.rtrim_ws(F.col("line")) != "")
    patch = F.concat(F.lit("-"), F.col("line"), F.lit("\n+new\n"))
    return docs.select("doc_id", D.patch_applies(patch, F.col("text")).alias("applies"), D.reanchor(patch, F.col("text")).alias("line"))


@query(
    """WITH m AS (SELECT o_orderkey, (o_orderkey % 4 + 10)::INTEGER AS s, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 4 + 10 + o_orderkey % 3)::INTEGER END AS e, o_orderkey % 3 + 10 AS n, o_orderpriority FROM orders)
SELECT o_orderkey, o_orderpriority || ': see ' || CASE WHEN s = n AND e = n THEN 'Line ' || n ELSE 'these lines' END || ' and ' || CASE WHEN s = 11 AND e = 12 THEN 'lines 11 - 12' ELSE 'these lines' END || ', baseline 10' AS body FROM m"""
)
def line_mentions(spark, d):
    n = F.col("o_orderkey")
    body = F.concat("o_orderpriority", F.lit(": see Line "), (n % 3 + 10).cast("string"), F.lit(" and lines 11 - 12, baseline 10"))
    start, end = (n % 4 + 10).cast("int"), F.when(n % 9 != 0, (n % 4 + 10 + n % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.sanitize_line_mentions(body, start, end).alias("body"))


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """A streaming query run to its end: counts of events in windows, with a watermark (an extension)."""
    from codestrata.streaming.jsonl import windowed_counts

    events = table(spark, d, "events")
    # pathGlobFilter: the folder holds other tables.
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(d)
    folder = scratch(spark)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/counts")  # complete mode: every batch brings all windows

    windowed_counts(source).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
