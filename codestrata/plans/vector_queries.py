"""Vector, lexical and hybrid retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import vectors as V
from codestrata.operators import retrieval as R
from codestrata.plans.registry import query, table

QUERY = 'en "of the" source:"src1" thtion er'


def _index(spark, d):
    """documents with the embedding of the same number: the index of hybrid search."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    return docs.join(e, "id")


def _probe(spark, d):
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vec_topk_cosine(spark, d):
    return R.vector_top_k(table(spark, d, "embeddings"), _probe(spark, d), 20, id_col="vec_id").select("vec_id", "score")


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vec_topk_dot(spark, d):
    return R.vector_top_k(table(spark, d, "embeddings"), _probe(spark, d), 20, "dot", id_col="vec_id").select("vec_id", "score")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings ORDER BY score, vec_id LIMIT 20")
def vec_topk_euclid(spark, d):
    return R.vector_top_k(table(spark, d, "embeddings"), _probe(spark, d), 20, "euclid", id_col="vec_id").select("vec_id", "score")


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings WHERE label = 3 OR label = 5 ORDER BY score DESC, vec_id LIMIT 20")
def vec_topk_filtered(spark, d):
    where = R.payload_filter([("label", 3), ("label", 5), ("label", 1.5)])
    return R.vector_top_k(table(spark, d, "embeddings"), _probe(spark, d), 20, id_col="vec_id", where=where).select("vec_id", "label", "score")


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 96")
def vec_over_fetch(spark, d):
    return R.over_fetch(table(spark, d, "embeddings"), _probe(spark, d), 12, id_col="vec_id").select("vec_id", "score")


@query("SELECT doc_id, lang, 0.0::DOUBLE AS score FROM documents WHERE lang = 'de' AND source = 'src3' ORDER BY doc_id LIMIT 40")
def scroll_filtered(spark, d):
    where = R.payload_filter([("lang", "de"), ("source", "src3")], mode="all")
    return R.scroll(table(spark, d, "documents"), where, 40, "doc_id").select("doc_id", "lang", "score")


@query("SELECT doc_id FROM documents WHERE list_has_any(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), ['src1', 'the', 'thtion', 'source'])")
def keyword_filter(spark, d):
    terms = F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")
    return table(spark, d, "documents").filter(R.term_filter(QUERY, terms)).select("doc_id")


# One table of tokens, quoted parts and pairs of QUERY, as the parser gives them.
def _rerank_sql(pool: str, limit: str = "") -> str:
    """The lexical boost over a pool (id, hay, lang, score) in SQL."""
    toks = {t: R.parse_query(QUERY).tokens.count(t) for t in R.parse_query(QUERY).tokens}
    s = lambda x: "'" + x.replace("'", "''") + "'"
    df = ", ".join(f"count(*) FILTER (contains(hay, {s(t)})) * {n} AS df{i}" for i, (t, n) in enumerate(toks.items()))
    boost = " + ".join(f"CASE WHEN contains(hay, {s(t)}) THEN 0.1::DOUBLE * {n} * (1 + ln(1 + n / df{i}::DOUBLE)) ELSE 0 END" for i, (t, n) in enumerate(toks.items()))
    q = R.parse_query(QUERY)
    for x in q.quoted:
        boost += f" + CASE WHEN contains(hay, {s(x)}) THEN 0.25::DOUBLE ELSE 0 END"
    boost += " + CASE WHEN " + " AND ".join(f"contains(hay, {s(x)})" for x in q.quoted) + " THEN 0.35::DOUBLE ELSE 0 END"
    for k, v in q.pairs:
        at = lambda x: f"strlen(split_part(hay, {s(x)}, 1))"
        boost += f" + CASE WHEN contains(hay, {s(k)}) AND contains(hay, {s(v)}) THEN CASE WHEN abs({at(k)} - {at(v)}) <= 120 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END ELSE 0 END"
    boost += f" + CASE WHEN contains(hay, {s(q.raw)}) THEN 0.4::DOUBLE ELSE 0 END"
    return f"SELECT p.*, round({boost}, 6) AS boost FROM {pool} p CROSS JOIN (SELECT greatest(count(*), 1) AS n, {df} FROM {pool}) s"


_IDX = f"idx AS (SELECT doc_id AS id, lower(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10)) AS hay, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS terms, lang, list_cosine_similarity(embedding::DOUBLE[], {_Q0}) AS sim FROM documents JOIN embeddings ON doc_id = vec_id)"


@query(f"WITH {_IDX}, pool AS (SELECT id, hay, round(sim, 6) AS score FROM idx ORDER BY score DESC, id LIMIT 160), b AS ({_rerank_sql('pool')}) SELECT id, score, boost, row_number() OVER (ORDER BY round(score + boost, 6) DESC, id)::INT AS rank FROM b")
def lexical_rerank(spark, d):
    hits = R.over_fetch(_index(spark, d), _probe(spark, d), 20)
    hay = R.haystack(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))
    return R.lexical_rerank(hits, QUERY, hay, F.col("lang")).select("id", "score", "boost", "rank")


@query(
    f"""WITH {_IDX}, pool AS (SELECT id, hay, terms, round(sim, 6) AS score FROM idx ORDER BY score DESC, id LIMIT 160),
b1 AS ({_rerank_sql("pool")}), first AS (SELECT id, hay, score FROM (SELECT *, row_number() OVER (ORDER BY round(score + boost, 6) DESC, id) AS r FROM b1) WHERE r <= 20 AND score >= 0),
lex AS (SELECT id, hay, 0.0::DOUBLE AS score FROM idx WHERE list_has_any(terms, ['the', 'source', 'src1', 'thtion']) ORDER BY id LIMIT 1600),
b2 AS ({_rerank_sql("lex")}), more AS (SELECT id, hay, score FROM (SELECT *, row_number() OVER (ORDER BY round(score + boost, 6) DESC, id) AS r FROM b2) WHERE r <= 40),
merged AS (SELECT * FROM first UNION ALL SELECT id, hay, score + 0.15::DOUBLE FROM more WHERE id NOT IN (SELECT id FROM first)),
b3 AS ({_rerank_sql("merged")}), ranked AS (SELECT id, score, boost, row_number() OVER (ORDER BY round(score + boost, 6) DESC, id)::INT AS rank FROM b3)
SELECT * FROM ranked WHERE rank <= 20"""
)
def hybrid_search(spark, d):
    hay = R.haystack(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))
    terms = F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")
    return R.hybrid_search(_index(spark, d), QUERY, _probe(spark, d), 20, hay, terms, F.col("lang")).select("id", "score", "boost", "rank")


@query("SELECT doc_id, (contains(lower(text), 'of the') OR contains(lower(text), 'en \"of the\" source:\"src1\" thtion er') OR contains(lower(text), 'src1')) AS strong FROM documents")
def strong_match(spark, d):
    return table(spark, d, "documents").select("doc_id", R.strong_match(QUERY, F.col("text")).alias("strong"))


@query(
    """WITH pairs AS (SELECT a.id AS seed, b.id, b.source, b.fqn, b.text, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM (SELECT doc_id AS id, source, lang AS fqn, md5(text) AS text, embedding FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 10 = 3) a
  JOIN (SELECT doc_id AS id, source, lang AS fqn, md5(text) AS text, embedding FROM documents JOIN embeddings ON doc_id = vec_id) b ON a.source = b.source AND a.id <> b.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS r FROM pairs) WHERE r <= 6),
sel AS (SELECT doc_id AS id, source, lang AS fqn, md5(text) AS text, 1.0::DOUBLE AS score FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 10 = 3),
un AS (SELECT id, source, fqn, text, score FROM sel UNION ALL SELECT id, source, fqn, text, score FROM near),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, fqn, text ORDER BY score DESC, id) AS r FROM un) WHERE r = 1)
SELECT id, source, fqn, text, score FROM once ORDER BY score DESC, id LIMIT 20"""
)
def neighbour_expansion(spark, d):
    idx = _index(spark, d).select("id", "source", F.col("lang").alias("fqn"), F.md5(F.col("text").cast("binary")).alias("text"), "embedding")
    selected = idx.filter("id % 10 = 3").withColumn("score", F.lit(1.0))
    return R.expand_neighbors(selected, idx, 6, 0.0, 10)


@query(
    """WITH h AS (SELECT source AS path, lang AS snippet, CASE doc_id % 3 WHEN 0 THEN 'symbols' WHEN 1 THEN 'paths' ELSE 'text' END AS channel, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 7) / 10.0::DOUBLE END AS base FROM documents)
SELECT path, snippet, round(coalesce(arg_min(base, (base IS NULL, CASE channel WHEN 'symbols' THEN 0 WHEN 'paths' THEN 1 ELSE 2 END, base)), 0.5) + sum(CASE channel WHEN 'symbols' THEN 0.30::DOUBLE WHEN 'paths' THEN 0.15 ELSE 0.10 END), 6) AS score
FROM h GROUP BY path, snippet ORDER BY score DESC, path, snippet LIMIT 8"""
)
def merge_channels(spark, d):
    n = F.col("doc_id")
    hits = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("lang").alias("snippet"), F.when(n % 3 == 0, "symbols").when(n % 3 == 1, "paths").otherwise("text").alias("channel"), F.when(n % 5 == 0, None).otherwise((n % 7) / 10.0).alias("base"))
    return R.merge_channels(hits)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'an') QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 6")
def search_path_like(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"))
    hit = s.filter(F.contains(F.lower("name"), F.lit("an")))
    return R.search_path_like(hit, "", 6).select(F.col("symbol_id").alias("p_partkey"), F.col("name").alias("p_name"), F.col("path").alias("p_brand"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR (NOT EXISTS (SELECT 1 FROM customer WHERE c_name = 'Customer#000000007') AND contains(lower(c_name), 'customer#000000007'))")
def search_symbol(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_name").alias("name"))
    return R.search_symbol(s, "Customer#000000007").select(F.col("symbol_id").alias("c_custkey"), F.col("name").alias("c_name"))


@query(
    """WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n, lang AS fqn, source, n_chars / 1000.0::DOUBLE AS score, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12),
b AS (SELECT *, printf('==[%d]== %s :: %s (score %.3f)' || chr(10), n, fqn, source, score) || text || chr(10) AS block FROM t),
e AS (SELECT *, sum(strlen(block)) OVER (ORDER BY n) AS e FROM b)
SELECT doc_id, n::INT AS n, CASE WHEN e <= 40000 THEN block ELSE left(block, (40000 - (e - strlen(block)))::BIGINT) END AS block FROM e WHERE e - strlen(block) < 40000"""
)
def pack_prompt(spark, d):
    hits = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(12).select("doc_id", F.col("lang").alias("fqn"), "source", (F.col("n_chars") / 1000.0).alias("score"), "text")
    return R.pack_prompt(hits, 40000, [F.desc("score"), F.col("doc_id")]).select("doc_id", "n", "block")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_keep_last(spark, d):
    return R.keep_last(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts")


@query("SELECT min(doc_id) AS doc_id, source, md5(text) AS text_md5 FROM documents GROUP BY source, text")
def dedup_source_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return docs.groupBy("source", "text_md5").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, source FROM (SELECT doc_id, 'first:' || source AS source, 0 AS p FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'second:' || source, 1 FROM documents WHERE source = 'src3') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) = 1")
def ordered_union(spark, d):
    docs = table(spark, d, "documents")
    one = docs.filter("lang = 'de'").select("doc_id", F.concat(F.lit("first:"), "source").alias("source"))
    two = docs.filter("source = 'src3'").select("doc_id", F.concat(F.lit("second:"), "source").alias("source"))
    return R.ordered_union(one, two, "doc_id")


@query()
def mmr_select(spark, d):
    """Greedy and order-sensitive: held against a Python version in the tests."""
    q = _probe(spark, d)
    pool = [r.asDict() for r in R.vector_top_k(table(spark, d, "embeddings"), q, 18, id_col="vec_id").select(F.col("vec_id").alias("id"), "score", "embedding").collect()]
    chosen = R.mmr_select(pool, q, 6)
    return spark.createDataFrame([(h["id"], h["score"]) for h in chosen], "vec_id long, score double")


@query(f"SELECT label, count(*) AS n, round(max(list_cosine_similarity(embedding::DOUBLE[], {_Q0})), 6) AS best FROM embeddings GROUP BY label")
def best_score_by_label(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _probe(spark, d)])
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.max(V.cosine(F.col("embedding"), q)), 6).alias("best"))
