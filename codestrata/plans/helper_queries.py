"""Text, path and span helpers, review context and enrichment over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import semi as S
from codestrata.functions import spans as N
from codestrata.functions import text as T
from codestrata.operators import assembly as A
from codestrata.operators import chunking as C
from codestrata.operators import context as K
from codestrata.operators import diff as D
from codestrata.operators import extract as X
from codestrata.operators import findings as G
from codestrata.operators import graph as Q
from codestrata.operators import records as M
from codestrata.operators import symbol_index as I
from codestrata.plans.registry import query, scratch, table
from codestrata.sources import files as W

_NL = "chr(10)"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Lines of a document as the library counts them.
_LINES = f"""l AS (SELECT doc_id, lang, source, text, CASE WHEN ends_with(text, {_NL}) THEN string_split(text, {_NL})[:-2] ELSE string_split(text, {_NL}) END AS l FROM (SELECT * REPLACE (replace(coalesce(text, ''), chr(13), '') AS text) FROM documents))"""


def _docs(spark, d):
    return table(spark, d, "documents").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""))


@query("SELECT p_partkey, p_name || CASE WHEN p_brand <> p_name THEN chr(10) || p_brand ELSE '' END || chr(10) || p_type AS text FROM part")
def composed_texts(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.compose_text(F.concat(F.lit(" "), "p_name", F.lit("\n")), F.lit("  "), F.col("p_brand"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type")).alias("text"))


@query("SELECT c_custkey, list_sort(list_distinct(['a' || c_custkey || '.dart', 'package:n' || c_nationkey || '/x.dart', 'p' || c_nationkey || '.dart'])) AS uris FROM customer")
def import_uris(spark, d):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("import 'package:n"), n, F.lit("/x.dart' as x;\n  export \"a"), k, F.lit(".dart\";\npart 'p"), n, F.lit(".dart';\n// import 'no.dart';\nfinal s = \"import 'no.dart'\";\nexport 'a"), k, F.lit(".dart';\n"))
    return table(spark, d, "customer").select("c_custkey", T.dart_import_uris(text).alias("uris"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey END AS alias, CASE WHEN c_custkey % 3 > 0 THEN ['X' || c_nationkey, 'Y'] ELSE []::VARCHAR[] END AS shown, CASE WHEN c_custkey % 3 = 0 THEN ['Z' || c_nationkey] ELSE []::VARCHAR[] END AS hidden FROM customer")
def import_modifiers(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    line = F.concat(F.lit("import 'x.dart'"), F.when(k % 2 == 0, F.concat(F.lit(" as a"), k.cast("string"))).otherwise(""), F.when(k % 3 > 0, F.concat(F.lit(" show X"), n, F.lit(" , Y"))).otherwise(F.concat(F.lit("  hide Z"), n)), F.lit(";"))
    return table(spark, d, "customer").select("c_custkey", T.import_modifiers(line).alias("m")).select("c_custkey", "m.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN 'A' || o_custkey END AS name, CASE WHEN o_orderkey % 4 = 1 THEN '''' || o_orderpriority || ''', (1)' END AS value FROM orders")
def annotation_lines(spark, d):
    n = F.col("o_orderkey")
    head = F.concat(F.lit("  @A"), F.col("o_custkey").cast("string"))
    line = F.when(n % 4 == 0, head).when(n % 4 == 1, F.concat(head, F.lit("('"), "o_orderpriority", F.lit("', (1)) "))).when(n % 4 == 2, F.concat(head, F.lit("()"))).otherwise("final x = 1;")
    return table(spark, d, "orders").select("o_orderkey", T.annotation(line).alias("a")).select("o_orderkey", "a.name", "a.value")


@query("SELECT c_custkey, to_json({'k': c_custkey, 's': c_name}) AS json FROM customer")
def fenced_json(spark, d):
    body = F.concat(F.lit('{"k":'), F.col("c_custkey").cast("string"), F.lit(',"s":"'), "c_name", F.lit('"}'))
    k = F.col("c_custkey") % 3
    fenced = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("\n ```\n"), body, F.lit(" ``` \n"))).otherwise(F.concat(F.lit("  "), body))
    return table(spark, d, "customer").select("c_custkey", T.strip_fences(fenced).alias("json"))


@query("SELECT c_custkey, 'repo/n' || c_nationkey || '/c' || c_custkey || '.dart' AS inside, '/else/' || c_custkey AS outside, 'n' || c_nationkey || '-app' AS name, 'c' || c_custkey || '_x.dart' AS safe FROM customer")
def repository_paths(spark, d):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    url = F.concat(F.when(F.col("c_custkey") % 2 == 0, "https://host/g/sub/n").otherwise("git@host:g/n"), n, F.lit("-app"), F.when(F.col("c_custkey") % 3 == 0, ".git").when(F.col("c_custkey") % 3 == 1, ".git/").otherwise(""))
    return table(spark, d, "customer").select(
        "c_custkey", P.repo_relative(F.concat(F.lit("\\home\\repo\\n"), n, F.lit("/c"), k, F.lit(".dart")), F.lit("/home/repo/")).alias("inside"), P.repo_relative(F.concat(F.lit("/else/"), k), F.lit("/home/repo")).alias("outside"),
        P.repo_name(url).alias("name"), P.safe_name(F.concat(F.lit("a/b\\c"), k, F.lit("@x.dart"))).alias("safe"),
    )


@query(f"WITH {_LINES} SELECT doc_id, left(list_filter(list_transform(l, lambda x: trim(x, {_WS})), lambda x: x <> '')[1], 256) AS head FROM l")
def hover_heads(spark, d):
    return _docs(spark, d).select("doc_id", T.hover_first_line(F.concat(F.lit("```dart\n"), F.col("text"), F.lit("\n```"))).alias("head"))


@query(f"WITH {_LINES} SELECT doc_id, array_to_string(list_transform(range(greatest(1, doc_id % 9 - 2), least(len(l), doc_id % 9 + 4) + 1), lambda i: lpad(i::VARCHAR, 6, ' ') || ' | ' || l[i]), {_NL}) AS shown FROM l")
def anchor_windows(spark, d):
    n = (F.col("doc_id") % 9).cast("int")
    return _docs(spark, d).select("doc_id", T.anchor_window(F.col("text"), n, n + 2, 2).alias("shown"))


@query("WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(13), '') AS text FROM documents), k AS (SELECT doc_id, text, doc_id % (length(text) + 1) AS pos FROM t) SELECT doc_id, (len(string_split(left(text, pos), chr(10))))::INTEGER AS line FROM k")
def lines_of_offsets(spark, d):
    at = (F.col("doc_id") % (F.char_length("text") + 1)).cast("int")
    return _docs(spark, d).select("doc_id", T.line_of(F.col("text"), at).alias("line"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z_$][A-Za-z0-9_$]*') AS whole, regexp_full_match(split_part(p_name, ' ', 1), '[A-Za-z_$][A-Za-z0-9_$]*') AS first, contains(lower(p_type), lower(split_part(p_type, ' ', 2))) AS found, contains(lower(p_type), lower(p_brand)) AS brand FROM part")
def identifier_tests(spark, d):
    first, word = F.get(F.split("p_name", " "), F.lit(0)), F.coalesce(F.get(F.split("p_type", " "), F.lit(1)), F.lit(""))
    return table(spark, d, "part").select("p_partkey", T.is_ident_like(F.col("p_name")).alias("whole"), T.is_ident_like(first).alias("first"), T.contains_ci(F.col("p_type"), F.upper(word)).alias("found"), T.contains_ci(F.col("p_type"), F.col("p_brand")).alias("brand"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS generated_at FROM events")
def run_stamps(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", T.run_stamp(ts).alias("stamp"), T.generated_at(ts).alias("generated_at"))


@query("SELECT c_custkey, 3 AS n, c_custkey::DOUBLE AS first, -3.0::DOUBLE AS last, ['/' || c_custkey, '/n' || c_nationkey] AS routes FROM customer")
def json_lists(spark, d):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(F.lit('{"values": ['), k, F.lit(', "x", 0.5, null, true, [1], -3], "facts": {"routes": ["/'), k, F.lit('", "/n'), n, F.lit('"]}}'))
    v = S.parse(text)
    vector = S.pick_vector(v, ["embedding", "vector", "values"])
    return table(spark, d, "customer").select("c_custkey", F.size(vector).alias("n"), F.get(vector, F.lit(0)).cast("double").alias("first"), F.element_at(vector, -1).cast("double").alias("last"), S.string_list(v, "$.facts.routes").alias("routes"))


@query("SELECT vec_id, len(embedding)::INTEGER AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def checked_vectors(spark, d):
    """The dimension is what the table's first row has; a row of another would fail the job."""
    e = table(spark, d, "embeddings")
    dim = e.orderBy("vec_id").select(F.size("embedding")).first()[0]
    v = S.require_dimension(F.col("embedding"), dim)
    return e.select("vec_id", F.size(v).alias("n"), F.round(F.get(v, F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT conv_id, string_agg(turn || '-' || turn + 3, ', ' ORDER BY turn) AS ranges FROM conversations GROUP BY conv_id")
def anchor_range_texts(spark, d):
    r = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("start"), (F.col("turn") + 3).alias("end"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(r.alias("r")).select("conv_id", G.anchor_ranges(F.col("r")).alias("ranges"))


@query(
    f"""WITH {_LINES}, t AS (SELECT doc_id, l, doc_id % 3 = 0 AS own, (doc_id % 7 + 1)::INTEGER AS line FROM l)
SELECT doc_id AS target_id, CASE WHEN own THEN 1 ELSE greatest(line - 5, 1) END AS scope_start, CASE WHEN own THEN 20 ELSE line + 5 END AS scope_end, ((line - 1) // 4)::INTEGER AS chunk_index,
 list_filter([CASE WHEN regexp_matches(array_to_string(l[CASE WHEN own THEN 1 ELSE greatest(line - 5, 1) END:CASE WHEN own THEN 20 ELSE line + 5 END], {_NL}), '\\bclose\\b') THEN 'close' END, CASE WHEN regexp_matches(array_to_string(l[CASE WHEN own THEN 1 ELSE greatest(line - 5, 1) END:CASE WHEN own THEN 20 ELSE line + 5 END], {_NL}), '\\bfree\\b') THEN 'free' END], lambda x: x IS NOT NULL) AS cleanup FROM t"""
)
def code_facts(spark, d):
    docs = _docs(spark, d)
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    targets = docs.select(F.col("doc_id").alias("target_id"), path.alias("path"), (F.col("doc_id") % 7 + 1).cast("int").alias("line"))
    spans = docs.filter("doc_id % 3 = 0").select(path.alias("path"), F.col("doc_id").alias("span_id"), F.lit(1).alias("start"), F.lit(20).alias("end"))
    out = K.code_facts(targets, docs.select(path.alias("path"), "text"), spans, 5, 4)
    return out.select("target_id", "scope_start", "scope_end", "chunk_index", F.filter("cleanup", lambda x: x.isin("close", "free")).alias("cleanup"))


@query(
    f"""WITH {_LINES}, t AS (SELECT doc_id, l, (doc_id % 60 + 1)::INTEGER AS s FROM l)
SELECT doc_id AS target_id, array_to_string(list_transform(range(greatest(1, s - 3), least(len(l), s + 5) + 1), lambda i: lpad(i::VARCHAR, 6, ' ') || ' | ' || l[i]), {_NL}) AS window, greatest(s - 3, 1) AS allowed_start, s + 5 AS allowed_end FROM t"""
)
def primary_contexts(spark, d):
    docs = _docs(spark, d)
    path, s = F.concat(F.lit("d"), F.col("doc_id").cast("string")), (F.col("doc_id") % 60 + 1).cast("int")
    out = K.primary_context(docs.select(F.col("doc_id").alias("target_id"), path.alias("path"), s.alias("start"), (s + 2).alias("end")), docs.select(path.alias("path"), "text"), 3)
    return out.select("target_id", "window", F.col("allowed")[0]["start"].alias("allowed_start"), F.col("allowed")[0]["end"].alias("allowed_end"))


@query("SELECT o_orderkey, (o_orderkey % 4 + 2)::INTEGER AS body_start, (o_orderkey % 4 + 6)::INTEGER AS body_end FROM orders")
def brace_bodies(spark, d):
    n = F.col("o_orderkey")
    text = F.concat(F.lit("head\n"), F.repeat(F.lit("x\n"), (n % 4).cast("int")), F.lit("void f() {\n  if (a) { b(); }\n  g({\n  });\n}\nvoid z() {\n}\n"))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return C.brace_body(rows, "o_orderkey", "text", F.lit(1), 8)


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS wrong FROM orders")
def unused_imports(spark, d):
    """Whether a claim that an import is unused is wrong: its name is a word of the body."""
    n = F.col("o_orderkey")
    name = F.concat(F.lit("Order"), n.cast("string"))
    snippet = F.concat(F.lit("   3 | import 'x.dart' as "), name, F.lit(";"))
    full = F.concat(F.lit("import 'y.dart';\nimport 'x.dart' as "), name, F.lit(";\n// "), name, F.lit("\nvoid a() {}\nvoid b() {}\nfinal c = "), F.when(n % 3 == 0, name).when(n % 3 == 1, F.concat(name, F.lit("x"))).otherwise("1"), F.lit(";\n"))
    return table(spark, d, "orders").select("o_orderkey", X.unused_import_is_false(snippet, full).alias("wrong"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'range' ELSE 'symbol' END AS kind, l_linenumber::INTEGER AS first, (CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber + 4 ELSE l_linenumber END)::INTEGER AS last, 's' || l_suppkey AS path FROM lineitem")
def bounds_of_targets(spark, d):
    n = F.col("l_linenumber").cast("int")
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n % 3 == 0, "line").when(n % 3 == 1, "range").otherwise("symbol").alias("kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), n.alias("line"), n.alias("start"), (n + 4).alias("end"), n.alias("decl_line"))
    return A.target_bounds(t).select("l_orderkey", "l_linenumber", "kind", F.col("target_start").alias("first"), F.col("target_end").alias("last"), F.col("target_path").alias("path"))


@query("SELECT c_custkey, 'lib/c' || c_custkey || '.dart' AS file, (c_custkey % 4 + 1)::INTEGER AS severity, (c_custkey * 3 + x)::INTEGER AS line FROM customer, (VALUES (0), (1)) v(x) WHERE c_custkey % 5 > 0")
def published_diagnostics(spark, d):
    k = F.col("c_custkey")
    one = lambda x: F.struct((k % 4 + 1).alias("severity"), F.struct(F.struct((k * 3 + x).alias("line")).alias("start")).alias("range"))
    uri = F.concat(F.when(k % 5 == 0, "file:///else/").otherwise("file:///repo/"), F.lit("lib/c"), k.cast("string"), F.lit(".dart"))
    message = F.to_json(F.struct(F.struct(uri.alias("uri"), F.array(one(0), one(1)).alias("diagnostics")).alias("params")))
    rows = table(spark, d, "customer").select(message.alias("j"))
    out = K.decode_diagnostics(rows, "j", "/repo")
    return out.select(F.regexp_extract("file", r"(\d+)\.dart$", 1).cast("long").alias("c_custkey"), "file", "severity", "line")


@query("SELECT o_orderkey, (o_orderkey % 5 + 2)::INTEGER AS line FROM orders")
def signature_lines(spark, d):
    n = F.col("o_orderkey")
    text = F.concat(F.lit("computeTotalOf outside\n"), F.repeat(F.lit("other words\n"), (n % 5).cast("int")), F.lit("int computeTotalOf(int a)\nab cde\n"))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return D.signature_line(rows, "o_orderkey", "text", F.array(F.lit("computeTotalOf"), F.lit("zz")), F.array(F.struct(F.lit(2).alias("start"), F.lit(90).alias("end"))))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['q' || c_custkey] ELSE []::VARCHAR[] END AS queries, CASE c_custkey % 3 WHEN 0 THEN ['p' || c_nationkey] ELSE []::VARCHAR[] END AS paths FROM customer")
def answered_hints(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    answer = F.when(k % 3 == 0, F.concat(F.lit('```json\n{"queries": ["q'), k.cast("string"), F.lit('"], "need_paths_like": ["p'), n, F.lit('"]}\n```'))).when(k % 3 == 1, "no json").otherwise("{}")
    return table(spark, d, "customer").select("c_custkey", K.context_hints(answer).alias("h")).select("c_custkey", F.col("h.queries").alias("queries"), F.col("h.need_paths_like").alias("paths"))


@query(
    f"""WITH {_LINES}
SELECT doc_id, l[least(1 + doc_id % 3, len(l))] AS line FROM l WHERE strlen(text) > 0"""
)
def slices_with_context(spark, d):
    """The whole line that a span of one byte at the start of a line touches."""
    docs = _docs(spark, d).filter("octet_length(text) > 0")
    every = T.lines(F.col("text"))
    row = F.least((F.col("doc_id") % 3 + 1).cast("int"), F.size(every))
    at = F.octet_length(F.array_join(F.transform(F.slice(every, F.lit(1), row - 1), lambda x: F.concat(x, F.lit("\n"))), ""))
    span = N.span(row, row, at.cast("int"), at.cast("int"))
    out = docs.select("doc_id", N.slice_with_context(F.col("text"), span, 1).alias("around"), row.alias("row"), F.size(F.split("text", "\n", -1)).alias("n"))
    own = F.get(F.split("around", "\n", -1), F.when(F.col("row") > 1, 1).otherwise(0))
    return out.select("doc_id", own.alias("line"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'Import' WHEN c_custkey % 4 = 2 THEN 'Export' ELSE 'Class' END AS kind, CASE WHEN c_custkey % 4 = 3 THEN 'Class c' || c_custkey END AS text FROM customer WHERE c_custkey % 4 = 3")
def records_without_imports(spark, d):
    k = F.col("c_custkey")
    kind = F.when((k % 4).isin(0, 1), "Import").when(k % 4 == 2, "Export").otherwise("Class")
    rows = table(spark, d, "customer").select("c_custkey", kind.alias("kind"), F.to_json(F.struct(kind.alias("kind"), F.concat(F.lit("c"), k.cast("string")).alias("name"))).alias("value"))
    kept = M.map_any_line(rows.select("value"), "value")
    return kept.select(F.regexp_extract("text", r"(\d+)$", 1).cast("long").alias("c_custkey"), F.lit("Class").alias("kind"), "text")


@query(
    """WITH c AS (SELECT *, 'lib/c' || c_custkey || '.dart' AS path, strlen('class C' || c_custkey || ' {' || chr(10)) AS base FROM customer)
SELECT path, kind, replace(name, '#', c_custkey::VARCHAR) AS name, first, decl_last, body_last, (CASE WHEN kind = 'Class' THEN 0 ELSE base + skip END)::INTEGER AS start_byte FROM c, (VALUES ('Class', 'C#', 1, 1, 6, 0), ('Field', 'a', 2, 2, 2, 2), ('Method', 'run', 3, 3, 5, 15)) v(kind, name, first, decl_last, body_last, skip) WHERE c_custkey % 4 > 1"""
)
def symbols_at_head(spark, d):
    """Files at a head: some are missing, some are not in UTF-8; the symbols of the others."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.concat(F.lit("class C"), key, F.lit(" {\n  int a = 1;\n  void run() {\n    go();\n  }\n}\n"))
    content = F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat(F.encode(text, "UTF-8"), F.lit(b"\xff"))).otherwise(F.encode(text, "UTF-8"))
    files = table(spark, d, "customer").select(F.concat(F.lit("lib/c"), key, F.lit(".dart")).alias("path"), content.alias("content"))
    out = I.symbol_records(I.decoded(files))
    return out.select("path", "kind", "name", F.col("decl_span.start_line").alias("first"), F.col("decl_span.end_line").alias("decl_last"), F.col("body_span.end_line").alias("body_last"), F.col("body_span.start_byte").alias("start_byte"))


@query("SELECT c_custkey, ['a', 'n', 'z'] AS keys, '{\"k\":' || c_nationkey || '}' AS n FROM customer")
def ordered_fields(spark, d):
    text = F.concat(F.lit('{"z": 1, "n": {"k": '), F.col("c_nationkey").cast("string"), F.lit('}, "a": [1, "x"]}'))
    return table(spark, d, "customer").select("c_custkey", S.ordered_extras(text).alias("m")).select("c_custkey", F.map_keys("m").alias("keys"), F.element_at("m", F.lit("n")).alias("n"))


@query(
    f"""WITH {_LINES}, t AS (SELECT doc_id, l, list_transform(range(1, least(len(l), 8) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: strlen(x))) + i - 1) AS used FROM l WHERE len(l) > 0),
k AS (SELECT doc_id, l, len(list_filter(used, lambda u: u <= 400)) AS n FROM t)
SELECT doc_id, n::INTEGER AS kept, n < len(l) AS marked FROM k"""
)
def clamped_snippets(spark, d):
    """Lines within 8 and 400 bytes, with an ellipsis where some are left out; at most as long with it."""
    docs = _docs(spark, d).withColumn("n", F.size(T.lines(F.col("text")))).filter("n > 0")
    out = docs.withColumn("s", T.clamp_ellipsis(F.col("text"), 400, 8)).withColumn("plain", T.clamp_ellipsis(F.col("text"), 400, 8, ellipsis=False))
    kept = F.size(T.within_budget(F.slice(T.lines(F.col("text")), 1, 8), 400, first_free=True))
    checked = F.when((F.octet_length("s") <= 400) | ~F.col("s").endswith("…"), F.col("s").endswith("…") & ~F.col("plain").endswith("…"))
    return out.select("doc_id", kept.alias("kept"), checked.alias("marked"))


@query("WITH t AS (SELECT doc_id, coalesce(replace(text, chr(13), ''), '') AS text FROM documents) SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, len(list_filter(range(1, 101), lambda k: strlen(left(text, k)) <= 100))) END AS capped FROM t")
def capped_texts(spark, d):
    return _docs(spark, d).select("doc_id", T.trim_to_cap(F.col("text"), 100).alias("capped"))


@query(
    """WITH c AS (SELECT o_orderkey AS id, o_custkey AS file, 'f' || o_custkey || '::C' || CASE WHEN o_orderkey % 4 > 0 THEN '::m' || o_orderkey ELSE '' END AS p FROM orders),
par AS (SELECT file, min(id) AS parent_id FROM c WHERE id % 4 = 0 GROUP BY file), k AS (SELECT parent_id, count(*) AS n, min(id) AS lo, max(id) AS hi FROM c JOIN par USING (file) WHERE id % 4 > 0 GROUP BY parent_id)
SELECT id, coalesce(k.n, 0)::INTEGER AS n, k.lo AS first, k.hi AS last FROM c LEFT JOIN k ON k.parent_id = id"""
)
def chunk_children(spark, d):
    """Orders as chunks of a class or its members: the children of each, by id."""
    n, key = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("f"), key.cast("string"), F.lit("::C"), F.when(n % 4 > 0, F.concat(F.lit("::m"), n.cast("string"))).otherwise(""))
    out = Q.children_and_parent(table(spark, d, "orders").select(n.alias("id"), key.alias("file"), path.alias("symbol_path")))
    return out.select("id", F.size("children").alias("n"), F.array_min("children").alias("first"), F.array_max("children").alias("last"))


@query("SELECT conv_id * 1000 + turn AS id, role AS path, role || ':' || turn || '|line#' || left(sha256(text), 8) AS idempotency_key, strlen(text)::INTEGER AS body_len, turn % 2 = 0 AS escalated FROM conversations")
def report_rows(spark, d):
    n, t = F.col("conv_id"), F.col("turn")
    c = table(spark, d, "conversations").select((n * 1000 + t).alias("id"), F.col("role").alias("path"), F.lit("line").alias("kind"), t.alias("line"), t.alias("start"), t.alias("end"), F.substring(F.sha2("text", 256), 1, 8).alias("snippet_hash"), F.lit("Low").alias("severity"), F.col("text").alias("body"), F.lit(0.5).alias("confidence"), F.lit(9).alias("prompt_tokens"), (t % 2 == 0).alias("escalated"))
    return G.report_rows(c).select("id", "path", "idempotency_key", "body_len", "escalated")


@query("SELECT conv_id, turn, md5(role || ': ' || text) AS prompt FROM conversations")
def dumped_prompts(spark, d):
    """Prompts of a review written for each that reads them later, and read back."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("prompt"))
    path = W.dump_rows(rows, scratch(spark), "prompts", "mr-1")
    return spark.read.schema("conv_id long, turn long, prompt string").json(path).select("conv_id", "turn", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 0 OR text IS NULL")
def materialized_files(spark, d):
    """Texts of targets from files that were stored at a head; what was not stored is null."""
    docs = table(spark, d, "documents")
    path = scratch(spark)
    name = F.concat(F.lit("h/d"), F.col("doc_id").cast("string")).alias("path")
    docs.filter("doc_id % 3 <> 0").select(name, "text").write.parquet(path)
    found = K.primary_context(docs.select(F.col("doc_id").alias("target_id"), name, F.lit(1).alias("start"), F.lit(1).alias("end")), spark.read.parquet(path))
    return found.select(F.col("target_id").alias("doc_id"), F.md5(F.col("full_text").cast("binary")).alias("text"))
