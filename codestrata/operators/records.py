"""Records for retrieval: mapping, tags, embedding text, search blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import semi as S
from codestrata.functions import text as T

#: Aliases under which records name their fields.
ID_KEYS, SNIPPET_KEYS, PATH_KEYS, VECTOR_KEYS = ["id", "uuid", "hash"], ["snippet", "body", "code"], ["path", "file", "source", "uri"], ["embedding", "vector", "values"]


def tags(kind: Column, path: Column) -> Column:
    """Kind tags, ``test`` and ``widget``."""
    k = F.lower(kind)
    kind_tag = F.when(k == "class", "class").when(k.isin("function", "method"), "function").when(k == "variable", "variable").when(k == "import", "import").when(k == "export", "export").when(k == "file", "file")
    return F.filter(F.array(kind_tag, F.when(F.contains(path, F.lit("/test/")), F.lit("test")), F.when(F.contains(path, F.lit("widget")), F.lit("widget"))), lambda t: t.isNotNull())


def map_any_line(rows: DataFrame, json_col: str, keep_imports: bool = False) -> DataFrame:
    """Loose JSON records: id, text, source, embedding; malformed rows and imports or exports go.

    The text is signature, doc and snippet, else kind and name with the file, else the name, else the raw row."""
    v = F.try_parse_json(json_col)
    d = rows.withColumn("_v", v).filter("_v is not null")
    if not keep_imports:
        kind = S.pick_str(F.col("_v"), ["kind"])
        d = d.filter(kind.isNull() | ~kind.isin("Import", "Export"))
    one = lambda *k: S.pick_str(F.col("_v"), list(k))
    d = d.select("*", one(*ID_KEYS).alias("_id"), one(*SNIPPET_KEYS).alias("_s"), one("doc").alias("_d"), one("signature").alias("_g"), one("kind").alias("_k"), one("fqn", "name").alias("_n"), one(*PATH_KEYS).alias("source"))
    file = F.when(F.col("source").isNotNull(), F.concat(F.lit(" (file: "), F.col("source"), F.lit(")"))).otherwise("")
    full = T.compose_text(F.col("_g"), F.col("_d"), F.col("_s"))
    text = F.when(F.col("_s").isNotNull() & (full != ""), full).when(F.col("_k").isNotNull() & F.col("_n").isNotNull(), F.concat("_k", F.lit(" "), "_n", file)).otherwise(F.coalesce("_n", F.col(json_col)))
    return d.select(F.coalesce("_id", ids.record_id(F.col(json_col))).alias("id"), text.alias("text"), "source", S.pick_vector(F.col("_v"), VECTOR_KEYS).alias("embedding"))


def map_ast_node(nodes: DataFrame, most: int) -> DataFrame:
    """Records of graph nodes, by their symbol ids."""
    body = F.when(F.col("signature").isNotNull() & F.col("snippet").isNotNull(), F.concat(F.col("signature"), F.lit(" :: "), F.coalesce("doc", F.lit("")), F.lit("\n"), F.col("snippet")))
    text = F.coalesce(body, T.join_compact([F.col("kind"), F.col("name"), F.col("file")], most))
    return nodes.select(F.coalesce("symbol_id", "name").alias("id"), text.alias("text"), F.col("file").alias("source"))


def map_graph_node(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.coalesce(F.col("id").cast("string"), F.col("name")).alias("id"), F.concat_ws(" · ", "name", "kind", "file").alias("text"))


def map_graph_edge(edges: DataFrame) -> DataFrame:
    s, d = F.col("src").cast("string"), F.col("dst").cast("string")
    return edges.select(F.concat_ws("|", s, "label", d).alias("id"), F.concat(s, F.lit(" · --"), F.col("label"), F.lit("--> · "), d).alias("text"))


def embedding_text(language: Column, kind: Column, path: Column, signature: Column, doc: Column, imports: Column, routes: Column, words: Column, snippet: Column) -> Column:
    """A head line, then what is there of signature, first doc line, imports, routes, 16 keywords and 50 lines of code."""
    listed = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(name), F.array_join(a, ", ")))
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    return F.concat_ws("\n", F.concat_ws(" | ", language, kind, path), some("Signature: ", signature), some("Doc: ", T.first_line(doc, 240)), listed("Imports: ", imports), listed("Routes: ", routes), listed("Keywords: ", F.slice(words, 1, 16)), T.clamp_ellipsis(snippet, 1200, 50))


def search_blob(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[T.trim_ws(p) for p in parts]), lambda x: x.isNotNull() & (x != "")), "\n")


def embed_missing(records: DataFrame, provider, policy: str = "precomputed_or") -> DataFrame:
    """``provider``: text column to array<float> column (for example a pandas UDF); called where a vector is missing, or always."""
    own = provider(F.col("text"))
    return records.withColumn("embedding", own if policy == "provider_only" else F.coalesce("embedding", own))


def hashing_embedder(dim: int = 64):
    """A deterministic provider for tests: signed counts of word hashes, by built-in functions."""

    def provide(c: Column) -> Column:
        words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))

    return provide


def file_summary(files: DataFrame) -> DataFrame:
    """Counts by language, unknown ones under ``unknown``."""
    from codestrata.functions.paths import detect_language

    return files.groupBy(F.coalesce(detect_language(F.col("path")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


def diagnostics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count_if(F.col("severity") == 1).alias("errors"), F.count_if(F.col("severity") == 2).alias("warnings"))
