"""The code graph over orders and line items (containers and members), nations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import extract as X
from codestrata.operators import graph as G
from codestrata.operators import records as M
from codestrata.plans.registry import query, table

# Nodes: customers' files with their orders as members; each imports or exports two of the first.
_NODES = """nodes AS (SELECT 'f' || c_custkey AS id, 'file' AS kind, 'n' || c_nationkey || '/c' || c_custkey || '.dart' AS name, 'n' || c_nationkey || '/c' || c_custkey || '.dart' AS file, NULL::VARCHAR AS target FROM customer
 UNION ALL SELECT 'o' || o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END, 'o' || o_orderkey, 'n' || c_nationkey || '/c' || c_custkey || '.dart', NULL::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'i' || a.c_custkey || '-' || b.c_custkey, CASE b.c_custkey % 2 WHEN 0 THEN 'import' ELSE 'export' END, 'c' || b.c_custkey || '.dart', 'n' || a.c_nationkey || '/c' || a.c_custkey || '.dart', 'n' || b.c_nationkey || '/c' || b.c_custkey || '.dart' FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey % 40 + 1 OR b.c_custkey = a.c_custkey % 17 + 2)"""


def _nodes(spark, d):
    c = table(spark, d, "customer")
    name = lambda n, k: F.concat(F.lit("n"), n.cast("string"), F.lit("/c"), k.cast("string"), F.lit(".dart"))
    file = name(F.col("c_nationkey"), F.col("c_custkey"))
    none = F.lit(None).cast("string")
    files = c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("id"), F.lit("file").alias("kind"), file.alias("name"), file.alias("file"), none.alias("resolved_target"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    label = F.concat(F.lit("o"), k.cast("string"))
    members = o.select(label.alias("id"), F.when(k % 3 == 0, "class").when(k % 3 == 1, "method").otherwise("function").alias("kind"), label.alias("name"), file.alias("file"), none.alias("resolved_target"))
    b = c.select(F.col("c_custkey").alias("bk"), F.col("c_nationkey").alias("bn"))
    links = c.withColumn("bk", F.explode(F.array_distinct(F.array(F.col("c_custkey") % 40 + 1, F.col("c_custkey") % 17 + 2)))).join(b, "bk")
    imports = links.select(F.concat_ws("-", F.concat(F.lit("i"), F.col("c_custkey").cast("string")), F.col("bk").cast("string")).alias("id"), F.when(F.col("bk") % 2 == 0, "import").otherwise("export").alias("kind"), F.concat(F.lit("c"), F.col("bk").cast("string"), F.lit(".dart")).alias("name"), file.alias("file"), name(F.col("bn"), F.col("bk")).alias("resolved_target"))
    return files.unionByName(members).unionByName(imports)


_FILES = "SELECT id, file FROM nodes WHERE kind = 'file'"
_DECL = f"SELECT f.id AS src, n.id AS dst, 'declares' AS label FROM ({_FILES}) f JOIN nodes n USING (file) WHERE n.kind NOT IN ('file', 'import', 'export', 'part', 'part_of')"
_IMP = f"SELECT s.id AS src, t.id AS dst, CASE n.kind WHEN 'import' THEN 'imports' ELSE 'exports' END AS label FROM nodes n JOIN ({_FILES}) s ON s.file = n.file JOIN ({_FILES}) t ON t.file = n.target WHERE n.kind IN ('import', 'export')"
_VIA = "SELECT i.src, e.dst, 'imports_via_export' AS label FROM imp i JOIN imp e ON i.dst = e.src WHERE i.label = 'imports' AND e.label = 'exports'"


@query(f"WITH {_NODES} {_DECL}")
def edges_declares(spark, d):
    return G.declares(_nodes(spark, d))


@query(f"WITH {_NODES} SELECT a.id AS src, b.id AS dst, 'same_file' AS label FROM nodes a JOIN nodes b ON a.file = b.file AND a.id <> b.id")
def edges_same_file(spark, d):
    return G.same_file(_nodes(spark, d))


@query(f"WITH {_NODES} {_IMP}")
def edges_imports(spark, d):
    return G.import_edges(_nodes(spark, d))


@query(f"WITH {_NODES}, imp AS ({_IMP}) {_VIA}")
def imports_via_export(spark, d):
    return G.imports_via_export(G.import_edges(_nodes(spark, d)))


@query("WITH c AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderpriority AS sig, split_part(o_orderpriority, '-', 2) AS name FROM orders) SELECT a.id AS src, b.id AS dst, 'calls' AS label FROM c a JOIN c b ON a.file = b.file AND a.id <> b.id AND b.name <> '' AND contains(a.sig, b.name)")
def intrafile_calls(spark, d):
    o = table(spark, d, "orders")
    name = F.coalesce(F.get(F.split("o_orderpriority", "-"), F.lit(1)), F.lit(""))
    n = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), F.lit("function").alias("kind"), F.col("o_orderpriority").alias("signature"), F.lit(None).cast("string").alias("doc"), name.alias("name"))
    return G.intrafile_calls(n)


_ALLOW = "(profile = 'file' AND label IN ('declares', 'imports', 'exports', 'imports_via_export', 'same_file') OR profile = 'class_like' AND label = 'declares' OR profile = 'callable' AND label = 'declares')"


@query(
    f"""WITH RECURSIVE {_NODES}, imp AS ({_IMP}), edges AS ({_DECL} UNION ALL SELECT * FROM imp UNION ALL {_VIA}),
both_ AS (SELECT src AS frm, dst AS nbr, label, 0 AS dir FROM edges UNION ALL SELECT dst, src, label, 1 FROM edges),
rec AS (SELECT id AS rec, file, CASE kind WHEN 'file' THEN 'file' WHEN 'class' THEN 'class_like' ELSE 'callable' END AS profile FROM nodes WHERE kind IN ('file', 'class', 'method', 'function')),
pri AS (SELECT * FROM (VALUES ('declares', 5), ('imports', 2), ('exports', 2), ('imports_via_export', 2)) v(label, p)),
h0 AS (SELECT rec, profile, nbr, label, 0 AS hop FROM (SELECT rec.rec, rec.profile, nbr, label, dir, p FROM rec JOIN both_ ON frm = rec JOIN pri USING (label) WHERE nbr <> rec AND {_ALLOW}) QUALIFY row_number() OVER (PARTITION BY rec, nbr ORDER BY dir, p DESC, label) = 1),
h1 AS (SELECT DISTINCT rec, profile, b.nbr, 'declares' AS label, 1 AS hop FROM h0 JOIN both_ b ON b.frm = h0.nbr AND b.label = 'declares' WHERE b.nbr <> rec AND (rec, b.nbr) NOT IN (SELECT (rec, nbr) FROM h0)),
h2 AS (SELECT DISTINCT rec, profile, b.nbr, 'declares' AS label, 2 AS hop FROM h1 JOIN both_ b ON b.frm = h1.nbr AND b.label = 'declares' WHERE b.nbr <> rec AND (rec, b.nbr) NOT IN (SELECT (rec, nbr) FROM h0) AND (rec, b.nbr) NOT IN (SELECT (rec, nbr) FROM h1)),
al AS (SELECT rec, nbr, label, hop FROM h0 UNION ALL SELECT rec, nbr, label, hop FROM h1 UNION ALL SELECT rec, nbr, label, hop FROM h2),
sc AS (SELECT al.*, greatest(0, p + CASE WHEN n.file = r.file THEN 2 ELSE 0 END + CASE WHEN starts_with(n.file || '::' || n.name, r.file || '::') THEN 1 ELSE 0 END - hop) AS score FROM al JOIN pri USING (label) JOIN nodes n ON n.id = nbr JOIN rec r USING (rec))
SELECT rec, nbr, label, hop::INT AS hop, score::INT AS score, row_number() OVER (PARTITION BY rec ORDER BY score DESC, hop, nbr)::INT AS rank FROM sc QUALIFY rank <= 24"""
)
def neighbours_top24(spark, d):
    nodes = _nodes(spark, d).withColumn("fqn", F.concat_ws("::", "file", "name"))
    e = G.import_edges(nodes)
    edges = G.declares(nodes).unionByName(e).unionByName(G.imports_via_export(e))
    records = nodes.filter(F.col("kind").isin("file", "class", "method", "function")).select("id", F.col("id").alias("node"), "file", "kind", F.concat("file", F.lit("::")).alias("owner"))
    return G.neighbours(records, nodes, edges).select("rec", "nbr", "label", "hop", "score", "rank")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders")
def ordinals(spark, d):
    return G.ordinals(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "ordinal")


@query("WITH c AS (SELECT doc_id AS id, source AS file, lang || '::' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN '::x' || doc_id ELSE '' END AS p FROM documents), q AS (SELECT *, CASE WHEN len(string_split(p, '::')) > 2 THEN array_to_string(string_split(p, '::')[:-2], '::') END AS pp FROM c), par AS (SELECT file, p, min(id) AS parent_id FROM c GROUP BY file, p) SELECT q.id, par.parent_id FROM q LEFT JOIN par ON q.file = par.file AND q.pp = par.p")
def chunk_parents(spark, d):
    n = F.col("doc_id")
    path = F.concat("lang", F.lit("::"), (n % 3).cast("string"), F.when(n % 2 == 0, F.concat(F.lit("::x"), n.cast("string"))).otherwise(""))
    c = table(spark, d, "documents").select(n.alias("id"), F.col("source").alias("file"), path.alias("symbol_path"))
    return G.children_and_parent(c).select("id", "parent_id")


@query("SELECT r_name AS source, n_name AS text, n_name || ' · --in--> · ' || r_name AS edge FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_records(spark, d):
    e = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in").alias("label"))
    m = M.map_graph_edge(e)
    return m.select(F.element_at(F.split("id", r"\|"), 3).alias("source"), F.element_at(F.split("id", r"\|"), 1).alias("text"), F.col("text").alias("edge"))


@query(
    """WITH f AS (SELECT 'n' || doc_id % 7 || '/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.dart' WHEN 1 THEN '.py' ELSE '.txt' END AS path, doc_id, CASE doc_id % 3 WHEN 0 THEN 'import ''src/a' || doc_id || '.dart'';' WHEN 1 THEN 'from m' || doc_id || ' import x' ELSE '' END || chr(10) || coalesce(text, '') AS text FROM documents)
SELECT path, CASE doc_id % 3 WHEN 0 THEN 'dart' WHEN 1 THEN 'python' ELSE 'other' END AS language, CASE doc_id % 3 WHEN 0 THEN 'src/a' || doc_id || '.dart' WHEN 1 THEN 'py:m' || doc_id ELSE '' END AS import,
 (len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END)::INTEGER AS end_row, sha256(text) AS content_sha256 FROM f"""
)
def generic_chunks(spark, d):
    n, key = F.col("doc_id"), F.col("doc_id").cast("string")
    ending = F.when(n % 3 == 0, ".dart").when(n % 3 == 1, ".py").otherwise(".txt")
    line = F.when(n % 3 == 0, F.concat(F.lit("import 'src/a"), key, F.lit(".dart';"))).when(n % 3 == 1, F.concat(F.lit("from m"), key, F.lit(" import x"))).otherwise("")
    files = table(spark, d, "documents").select(F.concat(F.lit("n"), (n % 7).cast("string"), F.lit("/d"), key, ending).alias("path"), F.concat(line, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    key = F.regexp_extract("path", r"/d(\d+)", 1)
    own = F.when(F.col("path").endswith(".dart"), F.concat(F.lit("src/a"), key, F.lit(".dart"))).when(F.col("path").endswith(".py"), F.concat(F.lit("py:m"), key))
    found = F.when(F.array_contains("imports", own), own).otherwise("")  # texts may hold what looks like more imports
    return X.generic_chunk(files).select("path", "language", found.alias("import"), "end_row", "content_sha256")


@query("WITH s AS (SELECT doc_id, source, lang FROM documents) SELECT doc_id, list_filter([CASE WHEN lang = 'en' THEN 'class' WHEN lang = 'de' THEN 'function' END, CASE WHEN contains(source, '1') THEN 'widget' END], lambda x: x IS NOT NULL) AS tags FROM s")
def tags(spark, d):
    kind = F.when(F.col("lang") == "en", "Class").when(F.col("lang") == "de", "Method")
    path = F.when(F.contains("source", F.lit("1")), F.lit("lib/widget.dart")).otherwise(F.lit("lib/x.dart"))
    return table(spark, d, "documents").select("doc_id", M.tags(kind, path).alias("tags"))
