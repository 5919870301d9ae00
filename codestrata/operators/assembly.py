"""Whole paths through the operators: chunk records, points, hits, retrieval with context, related blocks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import semi as S
from codestrata.functions import text as T
from codestrata.operators import chunking as C
from codestrata.operators import records as M
from codestrata.operators import retrieval as R


@dataclass
class RetrievalConfig:
    """How much is fetched and kept; ``from_env`` reads the same names as other deployments set."""

    top_k: int = 12
    context_k: int = 6
    neighbor_k: int = 6
    mmr_lambda: float = 0.7
    score_floor: float = 0.0
    expand_neighbors: bool = True
    dim: int = 1024
    snippet_chars: int = 2000
    snippet_lines: int = 120

    #: The environment's names.
    NAMES = {"top_k": "INITIAL_TOP_K", "context_k": "CONTEXT_K", "neighbor_k": "NEIGHBOR_K", "mmr_lambda": "MMR_LAMBDA", "score_floor": "SCORE_FLOOR", "expand_neighbors": "EXPAND_NEIGHBORS", "dim": "EMBEDDING_DIM", "snippet_chars": "SNIPPET_MAX_CHARS", "snippet_lines": "SNIPPET_MAX_LINES"}

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> RetrievalConfig:
        """Values that do not parse leave the default, as do those that are not set."""
        env, out = os.environ if env is None else env, cls()
        for field, name in cls.NAMES.items():
            old = getattr(out, field)
            try:
                value = env[name]
                setattr(out, field, value.strip().lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(value))
            except (KeyError, ValueError):
                continue
        return out.validated()

    @staticmethod
    def filter_from_env(env: dict[str, str] | None = None) -> list[tuple[str, object]]:
        """The condition that every search begins with, for ``retrieval.payload_filter``: the value is read as JSON, so that ``5`` is a
        number and ``true`` a boolean, else as text; none where no key is set."""
        env = os.environ if env is None else env
        key, value = env.get("RAG_FILTER_KEY", "").strip(), env.get("RAG_FILTER_VALUE")
        if not key or value is None:
            return []
        try:
            return [(key, json.loads(value))]
        except ValueError:
            return [(key, value)]

    def validated(self) -> RetrievalConfig:
        if self.top_k < 1 or self.context_k < 1 or self.dim < 1 or not 0 <= self.mmr_lambda <= 1:
            raise ValueError("top_k, context_k and dim have to be positive, mmr_lambda between 0 and 1")
        return self


def chunk_nodes(nodes: DataFrame, max_lines: int = 200, overlap: int = 4, max_chars: int = 4000) -> DataFrame:
    """nodes (symbol_id, kind, name, file, snippet): a record for each chunk of the snippet, with its number, the number of
    all and its node; a node without a snippet has one empty record. The record's id carries the chunk's number."""
    d = nodes.withColumn("_body", F.coalesce("snippet", F.lit("")))
    out = C.split_chunks(d, "_body", max_lines, overlap, max_chars)
    return out.select(
        F.when(F.col("chunk_total") > 1, F.concat("symbol_id", F.lit("#"), F.col("chunk_index").cast("string"))).otherwise(F.col("symbol_id")).alias("id"), F.col("file").alias("path"), "kind", "name",
        F.col("chunk_text").alias("snippet"), F.struct(F.col("chunk_index").alias("index"), F.col("chunk_total").alias("total"), F.col("symbol_id").alias("parent_id")).alias("chunk"), M.tags(F.col("kind"), F.col("file")).alias("tags"),
        F.sha2("chunk_text", 256).alias("hash_content"),
    )


def build_points(records: DataFrame, dim: int, provider=None, policy: str = "precomputed_or", max_chars: int = 2000, max_lines: int = 120) -> DataFrame:
    """records (id, text, source, embedding, extra: a JSON text or null): point_id, vector and payload of each.

    The payload holds text, source (else the path in extra), eid, language, kind, fqn, a clamped snippet, tags, and neighbors,
    metrics and owner_path as they are. A vector of another length fails the job."""
    v = F.try_parse_json(F.coalesce("extra", F.lit("{}")))
    one = lambda k: S.pick_str(v, [k])
    vector = F.col("embedding") if provider is None else provider(F.col("text")) if policy == "provider_only" else F.coalesce("embedding", provider(F.col("text")))
    snippet = T.clamp_snippet(S.pick_str(v, ["snippet", "body", "code"]), max_chars, max_lines)
    as_text = lambda k: F.to_json(F.try_variant_get(v, f"$.{k}", "variant")).alias(k)
    payload = F.struct(
        "text", F.coalesce("source", one("path")).alias("source"), F.col("id").alias("eid"), one("language").alias("language"), one("kind").alias("kind"), one("fqn").alias("fqn"), F.nullif(snippet, F.lit("")).alias("snippet"),
        F.try_variant_get(v, "$.tags", "array<string>").alias("tags"), as_text("neighbors"), as_text("metrics"), as_text("owner_path"),
    )
    return records.select(ids.point_id(F.col("id")).alias("point_id"), S.require_dimension(vector, dim).alias("vector"), payload.alias("payload"))


def payload_to_hit(points: DataFrame, score: str | None = None) -> DataFrame:
    """point_id, score (0 for rows that were scrolled to) and the fields of the payload; what is missing is empty or null."""
    p = F.col("payload")
    fields = [p["eid"].alias("id"), F.coalesce(p["text"], F.lit("")).alias("text"), p["source"].alias("source"), p["language"].alias("language"), p["kind"].alias("kind"), p["fqn"].alias("fqn"), p["snippet"].alias("snippet"), F.coalesce(p["tags"], F.array().cast("array<string>")).alias("tags")]
    return points.select("point_id", F.lit(0.0).alias("score") if score is None else F.col(score).alias("score"), *fields, "vector")


def rag_context(points: DataFrame, query: list[float], top_k: int, where: Column | None = None) -> DataFrame:
    """Hits of the points nearest to a query's vector, best first, behind a payload filter."""
    return payload_to_hit(R.vector_top_k(points, query, top_k, "cosine", "point_id", "vector", where), "score")


def retrieve(points: DataFrame, query: list[float], config: RetrievalConfig | None = None, where: Column | None = None) -> DataFrame:
    """score, source, fqn, kind, snippet and clamped text of the context for a query: top_k hits, context_k of them by
    relevance against diversity, and near rows of their sources.

    The choice among hits is greedy over at most 3 * context_k rows on the driver; the rest are plans."""
    config = config or RetrievalConfig()
    spark = points.sparkSession
    hits = rag_context(points, query, config.top_k, where)
    pool = [r.asDict() | {"embedding": r["vector"]} for r in hits.collect()]  # top_k rows
    chosen = R.mmr_select(pool, query, config.context_k, config.mmr_lambda)
    selected = spark.createDataFrame([(h["id"], h["score"]) for h in chosen], "id string, score double")
    rows = payload_to_hit(points).drop("score")
    selected = rows.join(F.broadcast(selected), "id")  # context_k rows
    if config.expand_neighbors:
        near = R.expand_neighbors(selected, rows, config.neighbor_k, config.score_floor, config.context_k, "vector")
        out = near.join(rows.select("id", "kind", "snippet"), "id", "left")
    else:
        out = selected
    return out.select("id", "score", "source", "fqn", "kind", "snippet", T.clamp_snippet(F.col("text"), 800, 100).alias("text")).orderBy(F.desc("score"), "id")


def related_query(preview: Column, path: Column) -> Column:
    """What is asked for a target: its preview, or its path where that is under 24 bytes; nothing for the whole change."""
    short = F.octet_length(T.trim_ws(preview)) < 24
    return F.when(path.isNotNull(), F.when(short | preview.isNull(), F.concat(F.lit("context for "), path)).otherwise(T.trim_ws(preview)))


def related_blocks(hits: DataFrame, facts: DataFrame, take: int = 3, min_score: float = 0.50) -> DataFrame:
    """hits (target_id, score, source, snippet) and facts (target_id, text): blocks (target_id, ord, path, snippet, why).

    The first ``take`` hits of a target that reach ``min_score`` (those without a snippet take a place and give no block), then
    the facts on its symbols."""
    from pyspark.sql import Window as W

    ranked = hits.filter(F.col("score") >= min_score).withColumn("ord", F.row_number().over(W.partitionBy("target_id").orderBy(F.desc("score"), "source", "snippet")))
    found = ranked.filter((F.col("ord") <= take) & F.col("snippet").isNotNull())
    found = found.select("target_id", "ord", F.coalesce("source", F.lit("<unknown>")).alias("path"), "snippet", F.format_string("RAG hit (score %.2f)", F.col("score")).alias("why"))
    own = facts.select("target_id", F.lit(take + 1).alias("ord"), F.lit("AST FACTS (read-only; from global index)").alias("path"), F.col("text").alias("snippet"), F.lit("Symbol/anchor facts for this file").alias("why"))
    return found.unionByName(own)


def symbol_facts(targets: DataFrame, symbols: DataFrame, most: int = 12) -> DataFrame:
    """targets (target_id, path, line): one text of the symbols of the file, the ``most`` next to the line first.

    Symbols and targets of a file are sorted once together; a target then meets at most ``most`` symbols on each side of its line, by
    their numbers, and never all of its file."""
    from pyspark.sql import Window as W

    kind = targets.schema["target_id"].dataType
    own = symbols.select("path", F.col("start").cast("long").alias("at"), "name", "kind", F.lit(None).cast(kind).alias("target_id"))
    none = F.lit(None).cast("string")
    asked = targets.select("path", F.col("line").cast("long").alias("at"), none.alias("name"), none.alias("kind"), "target_id")
    is_symbol = F.when(F.col("target_id").isNull(), 1).otherwise(0)
    order = ["at", F.col("target_id").isNotNull(), "name", "kind"]
    both = own.unionByName(asked).withColumn("up", F.sum(is_symbol).over(W.partitionBy("path").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    # Downwards the nearest come first too, those of one line by name.
    both = both.withColumn("down", F.sum(is_symbol).over(W.partitionBy("path").orderBy(F.desc("at"), F.col("target_id").isNull(), "name", "kind").rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("n", F.sum(is_symbol).over(W.partitionBy("path")))
    s = both.filter("target_id is null").select("path", F.col("at").alias("_s"), "name", "kind", "up", "down")
    t = both.filter("target_id is not null")
    side = lambda first, name: t.select("path", "target_id", "at", F.explode(F.sequence(first + 1, first + most)).alias(name)).join(s, ["path", name]).select("target_id", "at", "_s", "name", "kind")
    # ``up`` counts the symbols at or above a target, so that those below begin behind it, and the others at n - up from the end.
    near = side(F.col("up"), "up").unionByName(side(F.col("n") - F.col("up"), "down"))
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("target_id").orderBy(F.abs(F.col("_s") - F.col("at")), "_s", "name")))
    row = F.struct("_r", F.concat_ws(" ", "kind", "name", F.concat(F.lit("@"), F.col("_s").cast("string"))).alias("x"))
    return near.filter(F.col("_r") <= most).groupBy("target_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]), "\n").alias("text"))


def united_records(rag: DataFrame | None = None, ast: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, most: int = 1200) -> DataFrame:
    """id, text, source and origin of the four kinds of records, one below the other."""
    none = F.lit(None).cast("string").alias("source")
    parts = []
    if rag is not None:
        parts.append(rag.select("id", "text", "source", F.lit("rag").alias("origin")))
    if ast is not None:
        parts.append(M.map_ast_node(ast, most).select("id", "text", "source", F.lit("ast").alias("origin")))
    if nodes is not None:
        parts.append(M.map_graph_node(nodes).select("id", "text", none, F.lit("node").alias("origin")))
    if edges is not None:
        parts.append(M.map_graph_edge(edges).select("id", "text", none, F.lit("edge").alias("origin")))
    if not parts:
        raise ValueError("no records")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def embeddable(records: DataFrame, min_chars: int = 16, skip_short: bool = False) -> DataFrame:
    """Rows with an id; with ``skip_short`` only those of at least ``min_chars`` characters."""
    rows = records.filter(F.coalesce("id", F.lit("")) != "")
    return rows.filter(F.char_length(T.trim_ws(F.col("text"))) >= min_chars) if skip_short else rows


def change_rows(payload: DataFrame, json_col: str) -> DataFrame:
    """old_path, new_path, flags and diff of the changed files in payloads of a review host's ``changes`` answer."""
    v = F.try_parse_json(json_col)
    d = payload.withColumn("_c", F.explode(F.try_variant_get(v, "$.changes", "array<variant>")))
    get = lambda k, t: F.try_variant_get("_c", f"$.{k}", t)
    flag = lambda k: F.coalesce(get(k, "boolean"), F.lit(False))
    diff = get("diff", "string")
    names = [c for c in payload.columns if c != json_col]
    return d.select(*names, F.when(~flag("new_file"), get("old_path", "string")).alias("old_path"), F.when(~flag("deleted_file"), get("new_path", "string")).alias("new_path"), flag("new_file").alias("is_new"), flag("deleted_file").alias("is_deleted"), flag("renamed_file").alias("is_renamed"), diff.alias("raw_unidiff"))


def prompt_blocks(hits: DataFrame, order: list[Column]) -> DataFrame:
    """hits (source, snippet, score) as numbered blocks of a prompt. A prompt holds a handful of hits: a window over them alone."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.orderBy(*order))
    return hits.withColumn("n", n).select("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("source", F.lit("<unknown>")), F.lit("\n"), F.coalesce("snippet", F.lit(""))).alias("block"))


def target_bounds(targets: DataFrame) -> DataFrame:
    """targets (kind, path, line, start, end, decl_line): first and last line and path that a target stands for."""
    k = F.col("kind")
    first = F.when(k == "line", F.col("line")).when(k == "range", F.col("start")).when(k == "symbol", F.col("decl_line"))
    last = F.when(k == "line", F.col("line")).when(k == "range", F.col("end")).when(k == "symbol", F.col("decl_line"))
    return targets.withColumn("target_start", first).withColumn("target_end", last).withColumn("target_path", F.when(k != "global", F.col("path")))
