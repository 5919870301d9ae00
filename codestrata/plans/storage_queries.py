"""Bucketed upserts, a review host's answers, cached change sets, searches for many targets, packages, locations and rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import locations as L
from codestrata.operators import packages as K
from codestrata.operators import rules as U
from codestrata.operators import search_many as M
from codestrata.plans.registry import query, scratch, table
from codestrata.sources import review_host as H
from codestrata.sources.bucketed import BucketedTable


@query("SELECT 'c' || c_custkey AS id, coalesce(o.status, c_mktsegment) AS text, coalesce(o.priority, c_name) AS source FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def bucketed_upsert(spark, d):
    """All customers, then a batch of all orders in which the last one of a customer replaces its row."""
    t = BucketedTable(spark, scratch(spark))
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("id")
    t.upsert(table(spark, d, "customer").select(key("c_custkey"), F.col("c_mktsegment").alias("text"), F.col("c_name").alias("source")))
    batch = table(spark, d, "orders").select(key("o_custkey"), F.col("o_orderstatus").alias("text"), F.col("o_orderpriority").alias("source"), "o_orderkey")
    batch = batch.groupBy("id").agg(F.max_by("text", "o_orderkey").alias("text"), F.max_by("source", "o_orderkey").alias("source"))
    t.upsert(batch, batch_id="orders")
    t.upsert(batch.withColumn("text", F.lit("again")), batch_id="orders")  # was applied, changes nothing
    return t.read().select("id", "text", "source")


_ANSWERS = """o AS (SELECT o.*, 'g/n ' || c_nationkey AS project, o_custkey AS iid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders o JOIN customer ON c_custkey = o_custkey)"""


def _host(spark, d):
    """Answers of a review host: a change request for each customer with three orders a page, of which some have no diff."""
    folder = scratch(spark)
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("i", rank)
    diff = F.when(n % 5 == 0, None).when(n % 7 == 0, F.lit("GIT binary patch\nx")).otherwise(F.concat(F.lit("@@ -1 +1 @@\n+"), "o_orderpriority"))
    change = F.struct("i", F.struct(F.concat(F.lit("old/"), key).alias("old_path"), F.concat(F.lit("new/"), key).alias("new_path"), (n % 3 == 0).alias("new_file"), (n % 3 == 1).alias("deleted_file"), F.lit(False).alias("renamed_file"), F.when(n % 11 == 0, True).alias("too_large"), diff.alias("diff")).alias("x"))
    commit = F.struct("i", F.struct(F.concat(F.lit("sha"), key).alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("m\n"), key).alias("message"), F.lit("a").alias("author_name")).alias("x"))
    project = F.concat(F.lit("g/n "), F.col("c_nationkey").cast("string"))
    pages = o.groupBy(project.alias("project"), F.col("o_custkey").alias("iid"), F.floor(F.col("i") / 3).cast("int").alias("page")).agg(F.array_sort(F.collect_list(change)).alias("c"), F.array_sort(F.collect_list(commit)).alias("m"))
    answer = lambda kind, c: pages.select("project", F.lit(kind).alias("kind"), F.to_json(F.struct("iid", "page", F.lit(200).alias("status"), F.transform(c, lambda x: x["x"]).alias("body"))).alias("answer"))
    raw = o.select(project.alias("project"), F.lit("raw").alias("kind"), F.to_json(F.struct(F.col("o_custkey").alias("iid"), F.col("i").alias("page"), F.concat(F.lit("new/"), key).alias("path"), F.lit("head").alias("ref"), F.when(n % 4 == 0, 404).otherwise(200).alias("status"), F.when(n % 4 != 0, F.base64(F.encode("o_orderpriority", "UTF-8"))).alias("body"))).alias("answer"))
    H.record_answers(answer("diffs", "c").unionByName(answer("commits", "m")).unionByName(raw), folder)
    return folder


@query(
    f"""WITH {_ANSWERS} SELECT project, iid, 'new/' || o_orderkey AS new_path, o_orderkey % 3 = 0 AS is_new, o_orderkey % 3 = 1 AS is_deleted, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS is_binary,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'GIT binary patch' || chr(10) || 'x' ELSE '@@ -1 +1 @@' || chr(10) || '+' || o_orderpriority END AS raw_unidiff,
 bool_or(o_orderkey % 11 = 0) OVER (PARTITION BY project, iid) AS is_truncated, (i // 3)::INTEGER AS page, (i % 3)::INTEGER AS ord FROM o"""
)
def host_changes(spark, d):
    rows = H.changes(H.read_host(spark, _host(spark, d), "diffs"))
    flags = rows.groupBy("project", "iid").agg(F.bool_or("is_truncated").alias("is_truncated"))
    return rows.drop("is_truncated").join(flags, ["project", "iid"]).select("project", "iid", "new_path", "is_new", "is_deleted", "is_binary", "raw_unidiff", "is_truncated", "page", "ord")


@query(f"WITH {_ANSWERS} SELECT project, iid, 'sha' || o_orderkey AS id, o_orderpriority AS title, 'm' || chr(10) || o_orderkey AS message, 'a' AS author_name FROM o")
def host_commits(spark, d):
    return H.read_host(spark, _host(spark, d), "commits").select("project", "iid", "id", "title", "message", "author_name")


@query(f"WITH {_ANSWERS} SELECT project, 'new/' || o_orderkey AS path, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS content FROM o UNION ALL SELECT 'g/n ' || c_nationkey, 'none/' || c_custkey, NULL FROM customer")
def host_files(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    project = F.concat(F.lit("g/n "), F.col("c_nationkey").cast("string")).alias("project")
    wanted = o.select(project, F.lit("head").alias("ref"), F.concat(F.lit("new/"), F.col("o_orderkey").cast("string")).alias("path"))
    wanted = wanted.unionByName(table(spark, d, "customer").select(project, F.lit("head").alias("ref"), F.concat(F.lit("none/"), F.col("c_custkey").cast("string")).alias("path")))
    return H.files_at(wanted, H.read_host(spark, _host(spark, d), "raw")).select("project", "path", F.decode("content", "UTF-8").alias("content"))


@query(
    """WITH b AS (SELECT o_custkey AS iid, count(*)::INTEGER AS n_files, bool_or(o_orderkey % 11 = 0) AS cut FROM orders GROUP BY o_custkey)
SELECT iid, n_files, (n_files > 12 OR cut) AND iid % 3 <> 0 AS from_cache FROM b"""
)
def cached_changes(spark, d):
    """Asked twice, the second time with other heads for a third of the requests: what is large comes from the cache if its head is the same."""
    o = table(spark, d, "orders")
    cache = BucketedTable(spark, scratch(spark), "key")

    def fetch(missing):
        n = F.col("o_orderkey")
        rows = o.join(missing.select(F.col("iid").alias("o_custkey")), "o_custkey", "left_semi")
        return rows.select(F.lit("p").alias("project"), F.col("o_custkey").alias("iid"), F.lit(0).alias("page"), n.alias("ord"), F.col("o_orderpriority").alias("raw_unidiff"), (n % 11 == 0).alias("is_truncated"))

    ask = lambda head: o.select(F.lit("p").alias("project"), F.col("o_custkey").alias("iid"), head.alias("head_sha")).distinct()
    H.cached_bundles(cache, ask(F.lit("a")), fetch, most_files=12)
    again = H.cached_bundles(cache, ask(F.when(F.col("o_custkey") % 3 == 0, "b").otherwise("a")), fetch, most_files=12)
    return again.select("iid", F.size("files").alias("n_files"), "from_cache")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5"""
)
def knn_many(spark, d):
    e = table(spark, d, "embeddings")
    return M.search_many(e, e.select(F.col("vec_id").alias("query_id"), "embedding"), 5, id_col="vec_id")


_TARGETS = """t AS (SELECT conv_id || '-' || turn AS target_id, CASE WHEN turn % 4 <> 3 THEN 'lib/' || role || '.dart' END AS path, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS preview FROM conversations),
q AS (SELECT target_id, CASE WHEN strlen(preview) < 24 THEN 'context for ' || path ELSE preview END AS query FROM t WHERE path IS NOT NULL)"""


@query(
    f"""WITH {_TARGETS}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT DISTINCT query FROM q),
h AS (SELECT query, b.vec_id::VARCHAR AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u JOIN e a ON a.vec_id = length(query) % 200, e b),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 8),
r AS (SELECT target_id, score, CASE WHEN id::BIGINT % 3 <> 0 THEN 's' || id END AS source, CASE WHEN id::BIGINT % 4 <> 0 THEN 'snippet ' || id END AS snippet FROM q JOIN k USING (query) WHERE score >= 0.3),
o AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source NULLS FIRST, snippet NULLS FIRST) AS ord FROM r)
SELECT target_id, ord::INTEGER AS ord, coalesce(source, '<unknown>') AS path, snippet, 'RAG hit (score ' || printf('%.2f', score) || ')' AS why FROM o WHERE ord <= 3 AND snippet IS NOT NULL
UNION ALL SELECT target_id, 4, 'AST FACTS (read-only; from global index)', 'facts ' || target_id, 'Symbol/anchor facts for this file' FROM t WHERE path IS NOT NULL"""
)
def related_many(spark, d):
    """Targets from all turns of the conversations; a text's vector is the one of the row that its length names."""
    e = table(spark, d, "embeddings")
    key = F.col("vec_id").cast("string")
    payload = F.struct(key.alias("eid"), F.lit("").alias("text"), F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("s"), key)).alias("source"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("fqn"), F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("snippet "), key)).alias("snippet"), F.array().cast("array<string>").alias("tags"))
    points = e.select(key.alias("point_id"), F.col("embedding").alias("vector"), payload.alias("payload"))
    c = table(spark, d, "conversations")
    targets = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("target_id"), F.when(F.col("turn") % 4 != 3, F.concat(F.lit("lib/"), "role", F.lit(".dart"))).alias("path"), F.col("text").alias("preview"))
    embed = lambda q: q.withColumn("vec_id", F.char_length("query").cast("long") % 200).join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")
    facts = targets.select("target_id", F.concat(F.lit("facts "), "target_id").alias("text"))
    return M.related_context(targets, points, facts, embed, min_score=0.3)


def _packages(spark, d):
    s = table(spark, d, "supplier")
    k, up = F.col("s_suppkey").cast("string"), F.floor(F.col("s_suppkey") / 2).cast("string")
    name = F.concat(F.lit("# a package\nname: p"), k, F.lit("\ndependencies:\n  http: ^1.0.0\n  p"), up, F.lit(":\n    path: '../p"), up, F.lit("' # above\nflutter:\n  path: no\n  uses: {path: none}\ndev_dependencies:\n  q"), k, F.lit(": {path: tool/q}\n"))
    return s.select(F.concat(F.lit("pkgs/p"), k, F.lit("/pubspec.yaml")).alias("path"), name.alias("text"))


@query(
    """WITH RECURSIVE s AS (SELECT s_suppkey AS k FROM supplier), names AS (SELECT 'p' || k AS name FROM s),
direct AS (SELECT 'p' || k AS name, 'p' || k // 2 AS dep FROM s UNION SELECT 'p' || k, 'q' || k FROM s),
reach AS (SELECT * FROM direct UNION SELECT reach.name, direct.dep FROM reach JOIN direct ON direct.name = reach.dep),
uses AS (SELECT 'pkgs/p' || s.k || '/lib/c' || c_custkey || '.dart' AS path, s.k, c_custkey, c_custkey % 5 AS kind, least(c_custkey % 97, (SELECT max(k) FROM s)) AS other FROM customer JOIN s ON s.k = c_custkey % (SELECT count(*) FROM s)),
u AS (SELECT *, CASE kind WHEN 0 THEN 'package:p' || other || '/src/a.dart' WHEN 1 THEN 'package:q' || k || '/b.dart' WHEN 2 THEN 'package:unknown/c.dart' WHEN 3 THEN '../d.dart' ELSE 'package:p' || k // 2 || '/e.dart' END AS uri FROM uses)
SELECT path, uri, CASE kind WHEN 0 THEN 'pkgs/p' || other || '/lib/src/a.dart' WHEN 1 THEN 'pkgs/p' || k || '/tool/q/lib/b.dart' WHEN 3 THEN 'pkgs/p' || k || '/d.dart' WHEN 4 THEN 'pkgs/p' || k // 2 || '/lib/e.dart' END AS target, 'p' || k AS package,
 CASE kind WHEN 0 THEN other = k OR EXISTS (SELECT 1 FROM reach WHERE reach.name = 'p' || k AND reach.dep = 'p' || other) WHEN 1 THEN true WHEN 2 THEN false WHEN 4 THEN true END AS declared FROM u"""
)
def package_uris(spark, d):
    specs = K.specifications(_packages(spark, d))
    packages, pairs = K.registry(specs), K.reachable(specs, scratch(spark))
    n = table(spark, d, "supplier").count()
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey") % n)
    k, other, kind = F.col("k").cast("string"), F.least(F.col("c_custkey") % 97, F.lit(n - 1)).cast("string"), F.col("c_custkey") % 5
    up = F.floor(F.col("k") / 2).cast("string")
    uri = F.when(kind == 0, F.concat(F.lit("package:p"), other, F.lit("/src/a.dart"))).when(kind == 1, F.concat(F.lit("package:q"), k, F.lit("/b.dart"))).when(kind == 2, "package:unknown/c.dart").when(kind == 3, "../d.dart").otherwise(F.concat(F.lit("package:p"), up, F.lit("/e.dart")))
    uses = c.select(F.concat(F.lit("pkgs/p"), k, F.lit("/lib/c"), F.col("c_custkey").cast("string"), F.lit(".dart")).alias("path"), uri.alias("uri"))
    return K.resolve(uses, packages, pairs)


_UNITS = "CASE WHEN strlen(line[{i}:{i}]) = 4 THEN 2 WHEN line[{i}:{i}] = '' THEN 0 ELSE 1 END"


@query(
    f"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), n AS (SELECT *, doc_id % len(l) AS r FROM f),
x AS (SELECT doc_id, r, l[r + 1] AS line, coalesce(list_sum(list_transform(l[1:r], lambda y: strlen(y) + 1)), 0)::BIGINT AS base FROM n),
y AS (SELECT *, {_UNITS.format(i=1)} + {_UNITS.format(i=2)} AS two FROM x)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'package' ELSE 'sdk' END AS origin, CASE doc_id % 3 WHEN 0 THEN 'repo/d' || doc_id || '.dart' WHEN 1 THEN 'package:x/d' || doc_id || '.dart' ELSE 'dart:core' END AS target,
 CASE doc_id % 3 WHEN 0 THEN base + strlen(CASE WHEN two >= 3 THEN line[1:2] ELSE line[1:3] END) END AS start_byte, CASE doc_id % 3 WHEN 0 THEN base + strlen(line) END AS end_byte,
 CASE doc_id % 3 WHEN 0 THEN 'd' || doc_id || '#' || (r // 10) END AS chunk_id, 2 AS n FROM y"""
)
def definitions(spark, d):
    """Each document asks for a definition; the answers are a list of links, or one location; chunks are windows of ten lines."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    n, key = F.col("doc_id"), F.col("doc_id").cast("string")
    row = n % F.size(F.split("text", "\n", -1))
    uri = F.when(n % 3 == 0, F.concat(F.lit("file:///home/repo/d"), key, F.lit(".dart"))).when(n % 3 == 1, F.concat(F.lit("package:x/d"), key, F.lit(".dart"))).otherwise("dart:core")
    at = F.struct(F.struct(row.alias("line"), F.lit(3).alias("character")).alias("start"), F.struct(row.alias("line"), F.lit(1 << 30).alias("character")).alias("end"))
    other = F.struct(F.lit("file:///home/repo/none.dart").alias("uri"), F.struct(F.struct(F.lit(0).alias("line")).alias("start")).alias("range"))
    one, link = F.to_json(F.struct(uri.alias("uri"), at.alias("range"))), F.to_json(F.struct(uri.alias("targetUri"), at.alias("targetRange")))
    answer = F.concat(F.lit("["), F.when(n % 2 == 0, one).otherwise(link), F.lit(","), F.to_json(other), F.lit("]"))
    files = docs.select(F.concat(F.lit("repo/d"), key, F.lit(".dart")).alias("path"), "text")
    found = L.with_bytes(L.parse(docs.select("doc_id", answer.alias("j")), "doc_id", "j", F.lit("/home/repo")), files)
    chunks = docs.select(F.concat(F.lit("repo/d"), key, F.lit(".dart")).alias("path"), "doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n", -1)) - 1) / 10))).alias("c"))
    chunks = chunks.select("path", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("#"), F.col("c").cast("string")).alias("chunk_id"), (F.col("c") * 10).alias("start_row"), (F.col("c") * 10 + 9).alias("end_row"))
    out = L.definitions(found, "doc_id", chunks).join(L.references(found, "doc_id"), "doc_id")
    return out.select("doc_id", "origin", "target", "start_byte", "end_byte", "chunk_id", F.size("references_sample").alias("n"))


@query(
    """WITH r AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'dart' WHEN 2 THEN 'rust' ELSE 'unused' END AS folder, n_name || '.md' AS name, 'Rule of ' || n_nationkey AS text FROM nation),
b AS (SELECT folder, string_agg('### ' || name || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY name) AS body FROM r GROUP BY folder),
g AS (SELECT '## Global rules' || chr(10) || chr(10) || body AS x FROM b WHERE folder = 'global'), l AS (SELECT folder, '## Language rules (' || folder || ')' || chr(10) || chr(10) || body AS x FROM b),
f AS (SELECT 'p/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.DART' WHEN 1 THEN '.rs' WHEN 2 THEN '.py' ELSE '' END AS path, CASE doc_id % 4 WHEN 0 THEN 'dart' WHEN 1 THEN 'rust' END AS folder FROM documents)
SELECT path, sha256((SELECT x FROM g) || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || l.x, '')) AS rules FROM f LEFT JOIN l USING (folder)"""
)
def composed_rules(spark, d):
    k = F.col("n_nationkey")
    rules = table(spark, d, "nation").select(F.when(k % 4 == 0, "global").when(k % 4 == 1, "dart").when(k % 4 == 2, "rust").otherwise("unused").alias("folder"), F.concat("n_name", F.lit(".md")).alias("name"), F.concat(F.lit("Rule of "), k.cast("string")).alias("text"))
    n = F.col("doc_id")
    files = table(spark, d, "documents").select(F.concat(F.lit("p/"), n.cast("string"), F.when(n % 4 == 0, ".DART").when(n % 4 == 1, ".rs").when(n % 4 == 2, ".py").otherwise("")).alias("path"))
    return U.compose(files, rules).withColumn("rules", F.sha2("rules", 256))
