"""Symbols, directives and chunks out of source text, by patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import paths as P
from codestrata.functions import text as T

#: Patterns of directives and class-like declarations, one for each kind.
MODIFIERS = r"(?:(?:abstract|base|interface|final|sealed)\s+)*"
PATTERNS = [
    ("import", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    ("export", r"^\s*export\s+['\"]([^'\"]+)['\"]"),
    ("part", r"^\s*part\s+['\"]([^'\"]+)['\"]"),
    ("part_of", r"^\s*part\s+of\s+['\"]?([A-Za-z_][\w./]*)"),
    ("class", rf"^\s*{MODIFIERS}(?:mixin\s+)?class\s+([A-Za-z_]\w*)"),
    ("mixin", r"^\s*(?:base\s+)?mixin\s+(?!class\b)([A-Za-z_]\w*)"),
    ("enum", r"^\s*enum\s+([A-Za-z_]\w*)"),
    ("extension_type", r"^\s*extension\s+type\s+([A-Za-z_]\w*)\s*\("),
    ("extension", r"^\s*extension\s+(?!type\b)(?:([A-Za-z_]\w*)\s+)?on\s+"),
]
MEMBERS = [
    ("getter", r"^\s*(?:static\s+)?(?:[\w<>,?\[\] ]+\s+)?get\s+([A-Za-z_]\w*)"),
    ("setter", r"^\s*(?:static\s+)?set\s+([A-Za-z_]\w*)\s*\("),
    ("function", r"^\s*(?:(?:static|external|override|async)\s+)*[A-Za-z_][\w<>,?\[\] ]*\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{|=>)"),
    ("variable", r"^\s*(?:static\s+)?(?:late\s+)?(?:final|const|var)\s+(?:[A-Za-z_][\w<>,?\[\]]*\s+)?([A-Za-z_]\w*)\s*[=;]"),
]
CLASS_LIKE = ("class", "mixin", "enum", "extension_type", "extension")


def numbered_lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    return files.select("path", F.posexplode(T.lines(F.col(text_col))).alias("_p", "line")).withColumn("n", F.col("_p") + 1).drop("_p")


def symbols(files: DataFrame, members: bool = True) -> DataFrame:
    """path, kind, name, line, alias, owner, visibility, resolved_target of what each line declares.

    One pass over exploded lines; the owner of a member is the class-like declaration that is last above it and whose
    braces are still open there (depth by a running sum within the file)."""
    # Texts are dealt by path before they are cut, so that the windows shuffle no lines.
    rows = numbered_lines(files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path"))
    w = W.partitionBy("path").orderBy("n")
    without = lambda x: F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(x), F.lit("")))
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for k, p in reversed(PATTERNS + (MEMBERS if members else [])):
        found = F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))).otherwise(found)
    alias = F.nullif(F.regexp_extract("line", r"\bas\s+([A-Za-z_]\w*)", 1), F.lit(""))
    # Every pattern needs a letter. Only lines that declare or have braces go on; the lines themselves stay behind.
    rows = rows.select("path", "n", (without("{") - without("}")).alias("_delta"), F.when(F.col("line").rlike("[A-Za-z]"), found).alias("_found"), "line")
    rows = rows.filter("_delta <> 0 or _found is not null").select("path", "n", "_delta", F.col("_found.kind").alias("kind"), F.col("_found.name").alias("name"), F.when(F.col("_found.kind") == "import", alias).alias("_alias"))
    rows = rows.withColumn("_depth", F.coalesce(F.sum("_delta").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("name", F.when((F.col("kind") == "extension") & (F.col("name") == ""), "extension").otherwise(F.col("name")))
    control = F.col("name").isin("if", "for", "while", "switch", "catch", "return", "else")
    rows = rows.withColumn("kind", F.when(control & (F.col("kind") == "function"), None).otherwise(F.col("kind")))
    top = F.when(F.col("kind").isin(*CLASS_LIKE) & (F.col("_depth") == 0), F.col("name"))
    rows = rows.withColumn("_open", F.last(top, True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    owner = F.when((F.col("_depth") > 0) & ~F.col("kind").isin(*CLASS_LIKE), F.col("_open"))
    kind = F.when((F.col("kind") == "function") & owner.isNotNull(), "method").when((F.col("kind") == "variable") & owner.isNotNull(), "field").otherwise(F.col("kind"))
    out = rows.filter("kind is not null").withColumn("owner", owner)
    out = out.filter(~F.col("kind").isin("function", "variable") | (F.col("_depth") <= 1))
    target = F.when(F.col("kind").isin("import", "export", "part"), P.resolve_relative(F.col("path"), F.col("name")))
    return out.select("path", kind.alias("kind"), "name", F.col("n").alias("line"), F.col("_alias").alias("alias"), "owner", F.when(F.col("name").startswith("_"), "private").otherwise("public").alias("visibility"), target.alias("resolved_target"))


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select("path", F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast("string").alias("resolved_target"))


def ast_nodes(files: DataFrame) -> DataFrame:
    """File nodes of all languages, symbols of Dart files, with stable ids and qualified names."""
    lang = P.detect_language(F.col("path"))
    known = files.withColumn("language", lang).filter("language is not null")
    nodes = file_nodes(known).unionByName(symbols(known.filter("language = 'dart'")))
    nodes = nodes.withColumn("language", lang).withColumn("is_generated", P.looks_generated(F.col("path")))
    fqn = F.concat_ws("::", "path", "owner", "name")
    return nodes.withColumn("fqn", fqn).withColumn("symbol_id", ids.symbol_id(F.col("language"), F.col("path"), F.col("line"), F.col("line"), F.col("name"), F.col("kind")))


def docs_above(files: DataFrame, declared: DataFrame) -> DataFrame:
    """declared (path, line) with the ``///`` lines directly above it (blank and annotation lines may stand between)."""
    rows = numbered_lines(files)
    w = W.partitionBy("path").orderBy("n")
    code = ~F.col("line").rlike(r"^\s*(///|//!|@|$)")
    rows = rows.withColumn("_block", F.coalesce(F.sum(code.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    doc = F.when(F.col("line").rlike(r"^\s*///"), F.struct("n", F.regexp_replace("line", r"^\s*///\s?", "").alias("x")))
    blocks = rows.groupBy("path", "_block").agg(F.max("n").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(doc)), lambda r: r["x"]), "\n").alias("doc"))
    return declared.join(blocks.select("path", "line", F.nullif("doc", F.lit("")).alias("doc")), ["path", "line"], "left")


def generic_chunk(files: DataFrame, most_bytes: int = 2400, most_lines: int = 120) -> DataFrame:
    """One chunk for each file: clamped snippet, identifiers of the snippet, imports of the whole text."""
    snippet = T.clamp_ellipsis(F.col("text"), most_bytes, most_lines)
    d = files.withColumn("snippet", snippet)
    return d.select(
        ids.chunk_id(F.col("path"), F.lit("file"), F.lit(0), F.octet_length("text")).alias("id"), "path", P.guess_language(F.col("path")).alias("language"), F.lit("module").alias("kind"), F.lit("file").alias("symbol"), "snippet",
        T.identifiers(F.col("snippet")).alias("identifiers"), T.naive_imports(F.col("text")).alias("imports"), F.size(T.lines(F.col("text"))).alias("end_row"), F.sha2("text", 256).alias("content_sha256"),
    )


def calls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z_]\w*)\s*\("), 1))


def types(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z]\w*)\b"), 1))


def go_routes(c: Column, most: int = 128) -> Column:
    """What ``.go(`` calls name, sorted: up to the bracket, without quotes, beginning with /, of at most ``most`` bytes."""
    parts = F.split(c, r"\.go\(")
    inner = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.regexp_replace(T.trim_ws(F.substring_index(x, ")", 1)), r"^['\"]+|['\"]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(inner, lambda x: x.startswith("/") & (F.octet_length(x) <= most))))


def config_routes(c: Column, most: int = 128) -> Column:
    """Paths that a router's configuration names."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"\b(?:path|initialLocation)\s*:\s*['\"](/[^'\"]*)['\"]"), 1), lambda x: F.octet_length(x) <= most)))


def graph_hints(imports: Column, identifiers: Column, routes: Column, is_widget: Column) -> Column:
    """struct(targets, keywords, category)."""
    words = F.array_distinct(F.concat(identifiers, F.flatten(F.transform(imports, lambda x: T.keywords(x))), F.transform(routes, lambda r: F.concat(F.lit("route:"), r))))
    return F.struct(F.transform(imports, P.import_target).alias("targets"), words.alias("keywords"), F.when(is_widget, "flutter_widget").alias("category"))


def is_widget(c: Column) -> Column:
    return c.rlike(r"\bextends\s+\w*Widget\b")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """One chunk of (symbol_path, start, end), then one of (owner, start, first four words of the signature)."""
    w1 = W.partitionBy("file", "symbol_path", "start", "end").orderBy("id")
    once = chunks.withColumn("_r", F.row_number().over(w1)).filter("_r = 1").drop("_r")
    head = F.array_join(F.slice(F.split("signature", r"\s+"), 1, 4), " ")
    w2 = W.partitionBy("file", "owner", "start", head).orderBy("id")
    return once.withColumn("_r", F.row_number().over(w2)).filter("_r = 1").drop("_r")


def flatten_symbols(docs: DataFrame, key: str, json_col: str) -> DataFrame:
    """Nodes of document-symbol trees: name, first line of the detail and depth; a recursive view, to any depth."""
    spark = docs.sparkSession
    view = f"symbols_{uuid.uuid4().hex}"
    docs.select(F.col(key).alias("k"), F.explode(F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>")).alias("v")).select("k", F.to_json("v").alias("v")).createOrReplaceTempView(view)
    rows = spark.sql(f"""WITH RECURSIVE t(k, v, depth) MAX RECURSION LEVEL 10000 AS (SELECT k, v, 0 FROM {view} UNION ALL
        SELECT k, to_json(c.col), depth + 1 FROM t, LATERAL explode(try_variant_get(try_parse_json(v), '$.children', 'array<variant>')) AS c) SELECT k, depth, try_parse_json(v) AS v FROM t""")
    return rows.select(F.col("k").alias(key), F.try_variant_get("v", "$.name", "string").alias("name"), T.first_line(F.try_variant_get("v", "$.detail", "string"), 240).alias("detail"), F.try_variant_get("v", "$.range.start.line", "int").alias("start_line"), F.try_variant_get("v", "$.range.end.line", "int").alias("end_line"), "depth")


#: How a line of imports begins or what it holds, and what shows that a text has imports.
IMPORT_STARTS = ("import ", "include ", "#include", "using ", "use ", "require(", "from ")
IMPORT_INSIDE = (" import ",)
IMPORT_PROBES = ("import ", "#include", " include ", " using ", " from ", " require(", "\nuse ")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def import_like(c: Column) -> Column:
    """A line that begins like an import, or holds the word."""
    test = lambda begin: _any([begin.startswith(p) for p in IMPORT_STARTS] + [F.contains(begin, F.lit(p)) for p in IMPORT_INSIDE])
    return F.exists(F.array(T.ltrim_ws(c)), test)  # trimmed once, not for each test


def contains_import_like(c: Column) -> Column:
    return _any([F.contains(c, F.lit(p)) for p in IMPORT_PROBES])


def body_without_imports(c: Column) -> Column:
    """The lines behind the second one that is no import, blank or comment, without those that look like imports."""
    rows = F.transform(T.lines(c), lambda x: F.struct(x.alias("x"), T.ltrim_ws(x).alias("t")))
    rows = F.transform(rows, lambda r: F.struct(r["x"].alias("x"), r["t"].alias("t"), contains_import_like(r["t"]).alias("i")))
    head = lambda r: ~(r["i"] | (r["t"] == "") | r["t"].rlike(r"^(//|#!|/\*)"))

    def body(every):
        # Each line is looked at once: a number where it is no head, then the second of them.
        at = F.filter(F.transform(every, lambda r, i: F.when(head(r), i + 1)), lambda i: i.isNotNull())
        second = F.coalesce(F.get(at, F.lit(1)), F.size(every))
        rest = F.filter(F.slice(every, second + 1, F.greatest(F.size(every) - second, F.lit(0))), lambda r: ~r["i"])
        return F.array_join(F.transform(rest, lambda r: r["x"]), "\n")

    return F.get(F.transform(F.array(rows), body), F.lit(0))


def unused_import_is_false(snippet: Column, full: Column) -> Column:
    """Whether a symbol of the snippet's import lines (``12 | line`` or the line alone) is a token of the file's body."""
    shown = F.transform(T.lines(snippet), lambda x: T.trim_ws(F.when(F.contains(x, F.lit("|")), F.regexp_replace(x, r"^[^|]*\|", "")).otherwise(x)))
    names = F.flatten(F.transform(F.filter(shown, import_like), T.import_symbols))
    return F.coalesce(F.arrays_overlap(names, F.regexp_extract_all(body_without_imports(full), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)(?:\W|$)"), 1)), F.lit(False))


def _most_frequent(df: DataFrame, key: str, text_col: str, pattern: str, k: int) -> DataFrame:
    names = df.select(key, F.explode(F.regexp_extract_all(text_col, F.lit(pattern), 1)).alias("name")).groupBy(key, "name").agg(F.count("*").alias("n"))
    return names.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "name"))).filter(F.col("rank") <= k)


def writes_in_scope(df: DataFrame, key: str, text_col: str, k: int = 6) -> DataFrame:
    """The k most frequent targets of assignments in each text, ties by name."""
    return _most_frequent(df, key, text_col, r"(?m)\b([A-Za-z_][A-Za-z0-9_]*)\s*[\+\-\*/%]?=", k)


def top_calls(df: DataFrame, key: str, text_col: str, k: int = 6) -> DataFrame:
    """The k most frequent call names of each text, ties by name."""
    return _most_frequent(df, key, text_col, r"([A-Za-z_]\w*)\s*\(", k)
