"""Chunk records, points, hits, retrieval paths, facts, predicates and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import paths as P
from codestrata.functions import semi as S
from codestrata.functions import spans
from codestrata.functions import text as T
from codestrata.operators import assembly as A
from codestrata.operators import diff as D
from codestrata.operators import extract as X
from codestrata.operators import findings as N
from codestrata.operators import graph as G
from codestrata.operators import records as M
from codestrata.operators import retrieval as R
from codestrata.plans import graph_queries as Q
from codestrata.plans.registry import query, table

_NL = "chr(10)"


@query(
    f"""WITH b AS (SELECT doc_id, lang, regexp_replace(text, '\\n+$', '') AS t FROM documents), l AS (SELECT *, string_split(t, {_NL}) AS l, len(string_split(t, {_NL})) AS n FROM b),
w AS (SELECT doc_id, lang, l, CASE WHEN n <= 12 AND length(t) <= 600 OR n <= 12 THEN [0] ELSE range(0, (ceil((n - 12) / 10.0) * 10 + 1)::BIGINT, 10) END AS s FROM l),
e AS (SELECT doc_id, lang, l, len(s) AS total, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM w),
c AS (SELECT *, left(array_to_string(l[s + 1:s + 12], {_NL}), 600) AS snippet FROM e)
SELECT CASE WHEN total > 1 THEN 'd' || doc_id || '#' || i ELSE 'd' || doc_id END AS id, snippet, i::INT AS index, total::INT AS total, 'd' || doc_id AS parent_id, sha256(snippet) AS hash_content, CASE lang WHEN 'en' THEN 'class' WHEN 'de' THEN 'function' ELSE '' END AS tags FROM c"""
)
def chunk_records(spark, d):
    kind = F.when(F.col("lang") == "en", "Class").when(F.col("lang") == "de", "Method").otherwise("Enum")
    nodes = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("symbol_id"), kind.alias("kind"), F.lit("n").alias("name"), F.lit("lib/a.dart").alias("file"), F.col("text").alias("snippet"))
    return A.chunk_nodes(nodes, 12, 2, 600).select("id", "snippet", "chunk.index", "chunk.total", "chunk.parent_id", "hash_content", F.array_join("tags", " ").alias("tags"))


def _points(spark, d):
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").join(e, F.col("doc_id") == F.col("vec_id"))
    extra = F.to_json(F.struct(F.col("lang").alias("language"), F.when(F.col("label") == 0, None).otherwise(F.concat(F.lit("k"), F.col("label").cast("string"))).alias("kind"), F.concat("source", F.lit("::f"), F.col("doc_id").cast("string")).alias("fqn"), F.array("lang", "source").alias("tags"), F.concat(F.lit("p/"), "source").alias("path")))
    records = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"), "embedding", extra.alias("extra"))
    return A.build_points(records, 64)


_POINTS = "p AS (SELECT doc_id::VARCHAR AS id, text, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'p/' || source END AS source, lang AS language, CASE WHEN label <> 0 THEN 'k' || label END AS kind, source || '::f' || doc_id AS fqn, lang || ' ' || source AS tags, embedding FROM documents JOIN embeddings ON doc_id = vec_id)"


@query(f"WITH {_POINTS} SELECT id, md5(text) AS text, source, language, kind, fqn, tags, 0.0::DOUBLE AS score FROM p")
def points(spark, d):
    h = A.payload_to_hit(_points(spark, d))
    return h.select("id", F.md5(F.col("text").cast("binary")).alias("text"), "source", "language", "kind", "fqn", F.array_join("tags", " ").alias("tags"), "score")


_PROBE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _probe(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"]]


@query(f"WITH {_POINTS}, s AS (SELECT *, round(list_cosine_similarity(embedding::DOUBLE[], {_PROBE}), 6) AS score FROM p WHERE language = 'en' OR kind = 'k2'), t AS (SELECT max(score) AS top FROM s) SELECT id, source, kind, fqn, score FROM s WHERE score >= (SELECT min(score) FROM (SELECT score FROM s ORDER BY score DESC LIMIT 12))")
def rag_context(spark, d):
    where = (F.col("payload.language") == "en") | (F.col("payload.kind") == "k2")
    return A.rag_context(_points(spark, d), _probe(spark, d), 12, where).select("id", "source", "kind", "fqn", "score")


@query()
def retrieve_context(spark, d):
    """The whole path with the greedy choice in it: held against a Python version in the tests."""
    return A.retrieve(_points(spark, d), _probe(spark, d), A.RetrievalConfig(top_k=40, context_k=8)).select("id", "score", "source", "fqn", "kind")


@query(
    """WITH h AS (SELECT conv_id AS target_id, round((turn * 37 + conv_id * 11) % 100 / 100.0, 2)::DOUBLE AS score, CASE WHEN turn % 4 <> 0 THEN role END AS source, CASE WHEN turn % 5 <> 0 THEN md5(text) END AS snippet FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source NULLS FIRST, snippet NULLS FIRST) AS ord FROM h WHERE score >= 0.5)
SELECT target_id, ord::INT AS ord, coalesce(source, '<unknown>') AS path, snippet, 'RAG hit (score ' || printf('%.2f', score) || ')' AS why FROM r WHERE ord <= 3 AND snippet IS NOT NULL
UNION ALL SELECT DISTINCT conv_id, 4, 'AST FACTS (read-only; from global index)', 'c' || conv_id, 'Symbol/anchor facts for this file' FROM conversations WHERE conv_id % 2 = 0"""
)
def related_context(spark, d):
    c = table(spark, d, "conversations")
    n, t = F.col("conv_id"), F.col("turn")
    hits = c.select(n.alias("target_id"), F.round((t * 37 + n * 11) % 100 / 100.0, 2).alias("score"), F.when(t % 4 != 0, F.col("role")).alias("source"), F.when(t % 5 != 0, F.md5(F.col("text").cast("binary"))).alias("snippet"))
    facts = c.filter(n % 2 == 0).select(n.alias("target_id"), F.concat(F.lit("c"), n.cast("string")).alias("text")).distinct()
    return A.related_blocks(hits, facts)


_KIND = "['Class', 'Function', 'Method', 'TypeAlias', 'Import', 'File', 'Impl'][o_orderkey % 7 + 1]"


@query(f"SELECT o_orderkey, {_KIND} NOT IN ('Import', 'File') AS symbolic, {_KIND} IN ('Class', 'Function', 'Method', 'File') AS indexed, CASE WHEN {_KIND} = 'TypeAlias' THEN 'type_alias' ELSE lower({_KIND}) END AS label FROM orders")
def kinds(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Class", "Function", "Method", "TypeAlias", "Import", "File", "Impl")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", spans.is_symbolic_kind(kind).alias("symbolic"), spans.should_index_kind(kind).alias("indexed"), spans.snake(kind).alias("label"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 40")
def embeddable_rows(spark, d):
    c = table(spark, d, "conversations").withColumn("id", F.when(F.col("conv_id") % 5 != 0, F.col("conv_id").cast("string")).otherwise(""))
    return A.embeddable(c, 40, skip_short=True).select("conv_id", "turn")


@query("SELECT l_orderkey, l_linenumber, greatest(0, (l_quantity - 3)::BIGINT) AS lines, greatest(l_suppkey - l_partkey % 50, 0) AS bytes, least(l_partkey % 50, 40) AS start_byte, greatest(l_suppkey, 90) AS end_byte FROM lineitem")
def span_measures(spark, d):
    q, p, s = F.col("l_quantity").cast("long"), F.col("l_partkey") % 50, F.col("l_suppkey")
    one = spans.span(F.lit(4).cast("long"), q, p, s)
    both = spans.merge(one, spans.span(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(40).cast("long"), F.lit(90).cast("long")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", spans.line_count(one).alias("lines"), spans.byte_len(one).alias("bytes"), both["start_byte"].alias("start_byte"), both["end_byte"].alias("end_byte"))


@query("SELECT n_name AS id, n_name || ' · ' || r_name AS text, 'node' AS origin FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name || '|in|' || r_name, n_name || ' · --in--> · ' || r_name, 'edge' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 's' || n_nationkey, 'sig :: doc' || chr(10) || n_name, 'ast' FROM nation UNION ALL SELECT r_name, r_name, 'rag' FROM region")
def united_records(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = both.select(F.lit(None).cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("r_name").alias("file"))
    edges = both.select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in").alias("label"))
    ast = n.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("symbol_id"), F.lit("n").alias("name"), F.lit("Class").alias("kind"), F.lit("f").alias("file"), F.lit("sig").alias("signature"), F.lit("doc").alias("doc"), F.col("n_name").alias("snippet"))
    rag = r.select(F.col("r_name").alias("id"), F.col("r_name").alias("text"), F.lit(None).cast("string").alias("source"))
    return A.united_records(rag, ast, nodes, edges).select("id", "text", "origin")


@query("WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\\s*[-+*/%]?=', 1)) AS name FROM pages), c AS (SELECT page_id, name, count(*) AS n FROM n GROUP BY ALL) SELECT page_id, name, n, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, name)::INT AS rank FROM c QUALIFY rank <= 6")
def assigned_names(spark, d):
    return X.writes_in_scope(table(spark, d, "pages"), "page_id", "html")


_LIKE = "(contains(text, 'import ') OR contains(text, '#include') OR contains(text, ' include ') OR contains(text, ' using ') OR contains(text, ' from ') OR contains(text, ' require(') OR contains(text, chr(10) || 'use '))"


@query(f"SELECT doc_id, {_LIKE} AS imports FROM documents")
def import_probes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.contains_import_like(F.col("text")).alias("imports"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'sdk' WHEN 1 THEN 'package' WHEN 2 THEN 'local' ELSE 'unknown' END AS origin, CASE page_id % 4 WHEN 0 THEN 'dart:' || url WHEN 1 THEN 'package:' || url WHEN 2 THEN 'flutter_sdk/bin/p' || page_id ELSE url END AS target FROM pages")
def origins(spark, d):
    k, u = F.col("page_id"), F.col("url")
    uri = F.when(k % 4 == 0, F.concat(F.lit("dart:"), u)).when(k % 4 == 1, F.concat(F.lit("package:"), u)).when(k % 4 == 2, F.concat(F.lit("file:///opt/flutter/bin/p"), k.cast("string"))).otherwise(u)
    return table(spark, d, "pages").select("page_id", P.origin(uri).alias("origin"), P.target_path(uri, F.lit("/repo")).alias("target"))


@query("SELECT conv_id, turn, ['return ' || role, 'return ' || turn] AS returns, list_filter(['dispose', 'close', 'finalize', 'deinit', '__del__', 'Drop', 'free', 'cancel', 'unsubscribe'], lambda n: regexp_matches(text || ' x.dispose()', '\\b' || n || '\\b')) AS cleanup FROM conversations WHERE NOT regexp_matches(text, '(?i)\\breturn\\b')")
def outlines(spark, d):
    c = table(spark, d, "conversations").filter(~F.col("text").rlike(r"(?i)\breturn\b"))
    body = F.concat(F.col("text"), F.lit(" x.dispose(); if (a) Return "), F.col("role"), F.lit(";\n  return "), F.col("turn").cast("string"), F.lit("; z"))
    return c.select("conv_id", "turn", T.returns_outline(body).alias("returns"), T.cleanup_like(body).alias("cleanup"))


@query("SELECT page_id, list_sort(list_distinct(['/p' || page_id, '/a'])) AS routes FROM pages")
def go_routes(spark, d):
    path = F.concat(F.lit("/p"), F.col("page_id").cast("string"))
    code = F.concat(F.lit("context.go('"), path, F.lit("'); x.go( \"/a\" ); y.push('/no'); z.go(name); w.go('"), path, F.lit("');"))
    return table(spark, d, "pages").select("page_id", X.go_routes(code).alias("routes"))


@query("SELECT doc_id, bit_count(xor(doc_id, n_chars))::INT AS distance FROM documents")
def hamming(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.hamming(F.col("doc_id"), F.col("n_chars")).alias("distance"))


@query("SELECT conv_id, turn, [turn::FLOAT, length(text)::FLOAT] AS vector FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, [length(text)::FLOAT, 1::FLOAT] FROM conversations WHERE conv_id % 2 = 1")
def embed_missing(spark, d):
    c = table(spark, d, "conversations")
    own = F.when(F.col("conv_id") % 2 == 0, F.array(F.col("turn").cast("float"), F.char_length("text").cast("float")))
    out = M.embed_missing(c.withColumn("embedding", own), lambda t: F.array(F.char_length(t).cast("float"), F.lit(1.0).cast("float")))
    return out.select("conv_id", "turn", F.col("embedding").alias("vector"))


@query(f"WITH {Q._NODES}, imp AS ({Q._IMP}), edges AS ({Q._DECL} UNION ALL SELECT * FROM imp UNION ALL {Q._VIA}) SELECT label, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY label")
def whole_graph(spark, d):
    nodes = Q._nodes(spark, d).withColumn("language", F.lit("dart"))
    return G.language_aware_graph(nodes).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderpriority AS symbol_path, o_orderkey % 4 AS start, o_orderkey % 4 + 3 AS "end", o_orderstatus AS owner, 'a b c d ' || o_orderkey % 2 AS signature FROM orders),
a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file, symbol_path, start, "end" ORDER BY id) = 1) SELECT id FROM a QUALIFY row_number() OVER (PARTITION BY file, owner, start ORDER BY id) = 1"""
)
def dedup_chunks(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("symbol_path"), (k % 4).alias("start"), (k % 4 + 3).alias("end"), F.col("o_orderstatus").alias("owner"), F.concat(F.lit("a b c d "), (k % 2).cast("string")).alias("signature"))
    return X.dedup_chunks(o).select("id")


@query("SELECT r_regionkey, r_name AS name, 0 AS depth FROM region UNION ALL SELECT n_regionkey, n_name, 1 FROM nation UNION ALL SELECT n_regionkey, 'of ' || n_name, 2 FROM nation")
def symbol_trees(spark, d):
    n = table(spark, d, "nation")
    leaf = F.struct(F.col("n_name").alias("name"), F.array(F.struct(F.concat(F.lit("of "), F.col("n_name")).alias("name"))).alias("children"))
    kids = n.groupBy("n_regionkey").agg(F.collect_list(leaf).alias("children"))
    trees = table(spark, d, "region").join(kids, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", F.to_json(F.array(F.struct(F.col("r_name").alias("name"), "children"))).alias("j"))
    return X.flatten_symbols(trees, "r_regionkey", "j").select("r_regionkey", "name", "depth")


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value FROM events, (SELECT json_keys(props)[1] AS k FROM events ORDER BY event_id LIMIT 1)")
def json_pointers(spark, d):
    e = table(spark, d, "events")
    key = e.orderBy("event_id").select(F.json_object_keys("props")[0].alias("k")).first()["k"]
    return e.select("event_id", S.pointer(S.parse(F.col("props")), f"/{key}", "string").alias("value"))


@query("SELECT user_id, list_sort(list_distinct(list(event_type)))[1:3] AS kinds FROM events GROUP BY user_id")
def distinct_lists(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("a")).select("user_id", S.sorted_distinct(F.col("a"), 3).alias("kinds"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_nationkey WHEN 1 THEN c_nationkey + 1 WHEN 2 THEN 7 END::INT AS target_start, CASE c_custkey % 5 WHEN 0 THEN c_nationkey WHEN 1 THEN c_nationkey + 9 WHEN 2 THEN 7 END::INT AS target_end, CASE WHEN c_custkey % 5 <> 4 THEN c_name END AS target_path, CASE WHEN c_custkey % 5 = 1 THEN 'range' WHEN c_custkey % 5 IN (0, 2) THEN 'line' WHEN c_custkey % 5 = 3 THEN 'file' ELSE 'global' END AS final FROM customer")
def targets_of_comments(spark, d):
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey")
    kind = F.when(k == 0, "line").when(k == 1, "range").when(k == 2, "symbol").when(k == 3, "file").otherwise("global")
    t = table(spark, d, "customer").select("c_custkey", kind.alias("kind"), F.col("c_name").alias("path"), n.alias("line"), (n + 1).alias("start"), (n + 9).alias("end"), F.lit(7).alias("decl_line"))
    b = A.target_bounds(t)
    return b.select("c_custkey", "target_start", "target_end", "target_path", D.final_target(F.col("kind"), F.col("target_start"), F.col("target_end")).alias("final"))


@query("SELECT p_partkey, '**' || p_name || '**' || chr(10) || chr(10) || p_type || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '```diff' || chr(10) || '-' || p_brand || chr(10) || '```' || chr(10) ELSE '' END AS md FROM part")
def finding_markdown(spark, d):
    patch = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), F.col("p_brand"), F.lit("\n")))
    return table(spark, d, "part").select("p_partkey", N.to_markdown(F.col("p_name"), F.concat(F.lit(" "), F.col("p_type")), patch).alias("md"))


@query("SELECT 'a/' || s_suppkey % 7 || '.dart' AS path, s_name AS snippet, round(max(CASE WHEN s_suppkey % 2 = 0 THEN 0.7 ELSE 0.5 END), 2)::DOUBLE AS score FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 GROUP BY 1, 2")
def symbols_only(spark, d):
    k = F.col("s_suppkey")
    hits = table(spark, d, "supplier").select(F.when(k % 3 == 0, F.lit("Supplier")).otherwise("none").alias("symbol"), F.concat(F.lit("a/"), (k % 7).cast("string"), F.lit(".dart")).alias("path"), F.col("s_name").alias("snippet"), F.when(k % 2 == 0, 0.7).otherwise(0.5).alias("score"))
    return R.symbols_only(hits).select("path", "snippet", "score")


@query("WITH q AS (SELECT p_brand AS kind, p_type AS query, p_name AS path, p_retailprice AS score FROM part), a AS (SELECT *, dense_rank() OVER (PARTITION BY kind ORDER BY query) AS q FROM q), h AS (SELECT * FROM a WHERE q <= 3 QUALIFY row_number() OVER (PARTITION BY kind, query ORDER BY score DESC, path) <= 2) SELECT path, score FROM (SELECT DISTINCT path, score FROM h) ORDER BY path, score DESC LIMIT 12")
def hint_searches(spark, d):
    p = table(spark, d, "part")
    return R.hints_fan_out(p.select(F.col("p_brand").alias("kind"), F.col("p_type").alias("query"), F.col("p_name").alias("path"), F.col("p_retailprice").alias("score")))


@query("SELECT url, regexp_extract_all(url, '[A-Za-z_]\\w*(?:(?:\\.|::)[A-Za-z_]\\w*)*') AS chains FROM pages")
def identifier_chains(spark, d):
    return table(spark, d, "pages").select("url", T.identifier_chains(F.col("url")).alias("chains"))


@query("SELECT (SELECT count(*) FROM orders) AS targets, count(*) AS drafts, count(*) FILTER (turn % 3 = 0) AS escalated, count(*) FILTER (turn % 4 = 0) AS without_anchor FROM conversations")
def review_totals(spark, d):
    from codestrata.operators.context import review_report

    c = table(spark, d, "conversations").select((F.col("turn") % 3 == 0).alias("escalated"), F.when(F.col("turn") % 4 != 0, F.col("turn")).alias("start"))
    return review_report(table(spark, d, "orders"), c)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name || '.dart' END AS old_path, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE 'new/' || n_name || '.dart' END AS new_path, n_nationkey % 4 = 0 AS is_new, n_nationkey % 4 = 1 AS is_deleted, '@@ ' || n_name AS raw_unidiff FROM nation")
def change_payloads(spark, d):
    k, n = F.col("n_nationkey"), F.col("n_name")
    change = F.struct(F.concat(n, F.lit(".dart")).alias("old_path"), F.concat(F.lit("new/"), n, F.lit(".dart")).alias("new_path"), (k % 4 == 0).alias("new_file"), (k % 4 == 1).alias("deleted_file"), F.concat(F.lit("@@ "), n).alias("diff"))
    rows = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.array(change).alias("changes"))).alias("j"))
    return A.change_rows(rows, "j").drop("is_renamed")


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 9 AS path, s_name AS name FROM supplier),
r AS (SELECT t.k AS target_id, s.k, s.name, row_number() OVER (PARTITION BY t.k ORDER BY abs(s.k - t.k), s.k, s.name) AS r FROM s t JOIN s USING (path))
SELECT target_id, string_agg('class ' || name || ' @' || k, chr(10) ORDER BY r) AS text FROM r WHERE r <= 3 GROUP BY target_id"""
)
def symbol_facts(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    targets = s.select(k.alias("target_id"), (k % 9).alias("path"), k.alias("line"))
    symbols = s.select((k % 9).alias("path"), F.col("s_name").alias("name"), F.lit("class").alias("kind"), k.alias("start"))
    return A.symbol_facts(targets, symbols, 3)
