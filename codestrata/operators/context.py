"""Compositions: stitched code results, review context, enrichment from language-server JSON, index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import text as T
from codestrata.operators import chunking as C
from codestrata.operators import extract as X
from codestrata.operators import intervals as I
from codestrata.operators import records as M


def code_results(hits: DataFrame, chunks: DataFrame, files: DataFrame, k: int, order_by: str = "score") -> DataFrame:
    """hits (id, score, rank) to stitched code: joined with chunks (id, file, start_row, end_row; 0-based, half-open),
    merged where they overlap or touch, cut out of files (path, text), best first; empty slices and missing files go.

    Hits are at most a few hundred rows: the small side of the join with the chunks."""
    pieces = chunks.join(hits.select("id", "score", "rank"), "id").select("id", "file", F.col("start_row").alias("start"), F.col("end_row").alias("end"), "score", "rank")
    blocks = I.merge_intervals(pieces, ["file"], gap=0)
    ranks = pieces.groupBy(F.col("id").alias("best_id")).agg(F.min("rank").alias("rank"))
    code = T.slice_rows(F.col("text"), F.col("start"), F.col("end"))
    found = blocks.join(ranks, "best_id").join(files.select(F.col("path").alias("file"), "text"), "file").withColumn("code", code).filter("code != ''").drop("text")
    order = [F.col("rank").asc()] if order_by == "rank" else [F.desc("best_score")]
    return found.orderBy(*order, "file", "start").limit(k)


def primary_context(targets: DataFrame, files: DataFrame, pad: int = 20, near_top: int = 30) -> DataFrame:
    """targets (target_id, path, start, end): a numbered window, the lines that may be named, and the whole file where the
    target is near its top or the window has imports."""
    d = targets.join(files.select("path", "text"), "path", "left")
    window = T.anchor_window(F.col("text"), F.col("start"), F.col("end"), pad)
    whole = (F.col("start") <= near_top) | X.contains_import_like(window)
    return d.select("target_id", "path", window.alias("window"), F.array(F.struct(F.greatest(F.col("start") - pad, F.lit(1)).alias("start"), (F.col("end") + pad).alias("end"))).alias("allowed"), F.when(whole, F.col("text")).alias("full_text"))


def code_facts(targets: DataFrame, files: DataFrame, spans: DataFrame, pad: int = 80, chunk_lines: int = 160) -> DataFrame:
    """targets (target_id, path, line): the enclosing scope (else ``pad`` lines each way), the chunk that holds the line, and
    the scope's most frequent calls and assigned names, its returns and clean-up names."""
    placed = I.smallest_enclosing(targets, spans, "path", "line", "target_id")
    scope = placed.join(spans.select("span_id", F.col("start").alias("_s"), F.col("end").alias("_e")), "span_id", "left")
    scope = scope.withColumn("scope_start", F.coalesce("_s", F.greatest(F.col("line") - pad, F.lit(1)))).withColumn("scope_end", F.coalesce("_e", F.col("line") + pad))
    d = scope.join(files.select("path", "text"), "path").withColumn("body", T.slice_lines(F.col("text"), F.col("scope_start"), F.col("scope_end")))
    facts = d.select("target_id", "scope_start", "scope_end", F.floor((F.col("line") - 1) / chunk_lines).cast("int").alias("chunk_index"), T.returns_outline(F.col("body")).alias("returns"), T.cleanup_like(F.col("body")).alias("cleanup"))
    listed = lambda df, name: df.groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias(name))
    none = F.array().cast("array<string>")
    facts = facts.join(listed(X.top_calls(d, "target_id", "body"), "calls"), "target_id", "left").join(listed(X.writes_in_scope(d, "target_id", "body"), "writes"), "target_id", "left")
    return facts.withColumn("calls", F.coalesce("calls", none)).withColumn("writes", F.coalesce("writes", none))


def enclosing_body(targets: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """targets (target_id, path, line): the smallest span, else the body that braces give; null if neither.

    Texts are read only for lines that no span holds, once for each line of a file."""
    placed = I.smallest_enclosing(targets, spans, "path", "line", "target_id").join(spans.select("span_id", F.col("start").alias("_s"), F.col("end").alias("_e")), "span_id", "left")
    open_ = placed.filter("_s is null").select("path", "line").distinct().join(files.select("path", "text"), "path")
    braces = C.brace_body(open_.withColumn("at", F.struct("path", "line")), "at", "text", F.col("line")).select("at.path", "at.line", "body_start", "body_end")
    return placed.join(braces, ["path", "line"], "left").select("target_id", F.coalesce("_s", "body_start").alias("start"), F.coalesce("_e", "body_end").alias("end"))


def decode_diagnostics(messages: DataFrame, json_col: str, root: str) -> DataFrame:
    """file, severity, line out of published diagnostics; what lies outside root goes."""
    v = F.try_parse_json(json_col)
    base = root.rstrip("/") + "/"
    d = messages.select(F.try_variant_get(v, "$.params.uri", "string").alias("uri"), F.explode(F.try_variant_get(v, "$.params.diagnostics", "array<variant>")).alias("g"))
    path = F.regexp_replace("uri", "^file://", "")
    d = d.filter(path.startswith(base))
    return d.select(F.substr(path, F.lit(len(base) + 1)).alias("file"), F.try_variant_get("g", "$.severity", "int").alias("severity"), F.try_variant_get("g", "$.range.start.line", "int").alias("line"))


def enrich_chunks(chunks: DataFrame, symbols: DataFrame, diagnostics: DataFrame, hovers: DataFrame, references: DataFrame, most: int = 32) -> DataFrame:
    """chunks (chunk_id, file, kind, symbol_path, start, end) with the best symbol, default name and tags, counts of errors and
    warnings, the first hover line, and the number and a sample of references."""
    best = I.best_overlap(chunks, symbols, "file").select("chunk_id", "symbol_id")
    counts = M.diagnostics(diagnostics)
    hover = hovers.groupBy("symbol_id").agg(F.min(T.hover_first_line(F.col("text"))).alias("hover"))
    refs = references.groupBy("symbol_id").agg(F.count("*").alias("n_references"), F.slice(F.array_sort(F.collect_list(F.struct("file", "line"))), 1, most).alias("references"))
    d = chunks.join(best, "chunk_id", "left").join(counts, "file", "left").join(hover, "symbol_id", "left").join(refs, "symbol_id", "left")
    d = d.withColumn("fqn", F.concat("file", F.lit("::"), "symbol_path")).withColumn("tags", F.array(F.concat(F.lit("file:"), "file"), F.concat(F.lit("kind:"), "kind")))
    return d.fillna(0, ["errors", "warnings", "n_references"])


def index_rows(chunks: DataFrame) -> DataFrame:
    """chunks (id, file, kind, symbol_path, signature, doc, snippet, text, imports, routes, keywords): the text to embed and the
    payload with its search terms and blob."""
    imports = F.slice(F.array_sort(F.array_distinct("imports")), 1, 8)
    routes = F.array_sort(F.array_distinct(F.concat("routes", T.routes(F.col("snippet")))))
    words = F.slice(F.array_sort(F.array_distinct(F.concat("keywords", T.keywords(F.col("snippet"))))), 1, 32)
    preview = T.clamp_ellipsis(F.col("snippet"), 800, 40)
    d = chunks.select("id", "file", P.guess_language(F.col("file")).alias("language"), "kind", "symbol_path", "signature", T.first_line(F.col("doc"), 240).alias("doc_line"), imports.alias("imports_top"), routes.alias("routes"), words.alias("search_terms"), preview.alias("preview"))
    embed = M.embedding_text(F.col("language"), F.col("kind"), F.col("file"), F.col("signature"), F.col("doc_line"), F.col("imports_top"), F.col("routes"), F.col("search_terms"), F.col("preview"))
    return d.withColumn("embed_text", embed).withColumn("search_blob", M.search_blob(F.col("file"), F.col("symbol_path"), F.col("signature"), F.col("doc_line"), F.array_join("search_terms", " "), F.col("preview")))


#: Fixed value: what a model's answer about needed context may hold.
HINTS = "struct<queries:array<string>,need_paths_like:array<string>,need_symbols_like:array<string>>"


def context_hints(answer: Column) -> Column:
    """The hints of an answer, empty lists where it is no JSON."""
    h = F.from_json(T.strip_fences(answer), HINTS)
    empty = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(h[n], empty).alias(n) for n in ("queries", "need_paths_like", "need_symbols_like")])


def review_report(targets: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row: targets, drafts, drafts that a slow model looked at again, drafts without an anchor."""
    t = targets.agg(F.count("*").alias("targets"))
    return drafts.agg(F.count("*").alias("drafts"), F.count_if(F.col("escalated")).alias("escalated"), F.count_if(F.col("start").isNull()).alias("without_anchor")).crossJoin(F.broadcast(t))
