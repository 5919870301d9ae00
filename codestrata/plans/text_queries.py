"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import ids as I
from codestrata.functions import paths as P
from codestrata.functions import text as T
from codestrata.operators import chunking as C
from codestrata.operators import extract as X
from codestrata.operators import records as M
from codestrata.plans.registry import query, table

_NL = "chr(10)"


def lines_sql(c: str) -> str:
    parts = f"string_split({c}, {_NL})"
    return f"list_transform(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END, lambda x: CASE WHEN right(x, 1) = chr(13) THEN left(x, -1) ELSE x END)"


def budget_sql(items: str, most: int, first_free: bool) -> str:
    """Indices up to which the running bytes stay within the budget."""
    extra = "i - 1" if first_free else "i"
    return f"list_filter({items}, lambda x, i: list_sum(list_transform(({items})[1:i], lambda y: strlen(y))) + {extra} <= {most})"


def docs(spark, d):
    return table(spark, d, "documents")


_WS = "[ \\t\\n\\x0b\\f\\r]+"


@query(
    f"""WITH l AS (SELECT doc_id, list_transform({lines_sql("text")}, lambda x: regexp_replace(x, '{_WS}$', '')) AS l FROM documents),
c AS (SELECT doc_id, list_filter(l, lambda x, i: NOT (i > 1 AND x = '' AND l[i - 1] = '')) AS l FROM l)
SELECT doc_id, array_to_string(list_transform({budget_sql("l", 1200, False)}, lambda x: x || {_NL}), '') AS body FROM c"""
)
def normalize_light(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_code_light(F.col("text"), 1200).alias("body"))


@query(f"WITH l AS (SELECT doc_id, ({lines_sql('text')})[1:20] AS l FROM documents) SELECT doc_id, regexp_replace(array_to_string({budget_sql('l', 800, False)}, {_NL}), '{_WS}$', '') AS body FROM l")
def clamp_snippet(spark, d):
    return docs(spark, d).select("doc_id", T.clamp_snippet(F.col("text"), 800, 20).alias("body"))


@query(f"WITH l AS (SELECT doc_id, {lines_sql('text')} AS f FROM documents), m AS (SELECT doc_id, f, f[1:12] AS l FROM l) SELECT doc_id, array_to_string({budget_sql('l', 700, True)}, {_NL}) AS body, len({budget_sql('l', 700, True)}) < len(f) AS cut FROM m")
def clamp_lines(spark, d):
    body = T.clamp_ellipsis(F.col("text"), 700, 12, ellipsis=False)
    kept = T.within_budget(F.slice(T.lines(F.col("text")), 1, 12), 700, True)
    return docs(spark, d).select("doc_id", body.alias("body"), (F.size(kept) < F.size(T.lines(F.col("text")))).alias("cut"))


@query("SELECT doc_id, lang || ' · ' || source || ' · ' || doc_id::VARCHAR AS body FROM documents")
def join_compact(spark, d):
    return docs(spark, d).select("doc_id", T.join_compact([F.col("lang"), F.lit("  "), F.col("source"), F.col("doc_id").cast("string")], 60).alias("body"))


@query(
    r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_./-]{3,}') AS raw FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(raw, lambda x: lower(x)), lambda x: NOT regexp_full_match(x, '[0-9]+')) AS whole,
  list_filter(flatten(list_transform(raw, lambda x: string_split_regex(x, '[/.\-_]'))), lambda x: length(x) >= 3) AS pieces FROM r),
q AS (SELECT doc_id, whole, list_filter(list_transform(flatten(list_transform(pieces, lambda x: string_split(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '))), lambda x: lower(x)), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')) AS parts FROM p)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(whole, parts)))[1:48], ' ') AS words FROM q"""
)
def keywords(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("words"))


@query(
    r"""WITH r AS (SELECT page_id, list_filter(list_concat(regexp_extract_all(html, '[''"](/[^''"]*)[''"]', 1), regexp_extract_all(html, '(/[A-Za-z0-9_\-/:]+)', 1)), lambda x: regexp_matches(x, '[^/]')) AS a FROM pages)
SELECT page_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS routes FROM r"""
)
def routes(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.routes(F.col("html")), " ").alias("routes"))


@query(
    r"""WITH r AS (SELECT doc_id, list_filter(string_split_regex(text, '[^\p{L}\p{N}_$]+'), lambda x: regexp_matches(x, '^[\p{L}_$]')) AS a FROM documents),
u AS (SELECT doc_id, list_sort(list_transform(list_distinct(a), lambda x: {'p': list_position(a, x), 'x': x})) AS a FROM r)
SELECT doc_id, array_to_string(list_transform(a[1:128], lambda s: s.x), ' ') AS words FROM u"""
)
def identifiers(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.identifiers(F.col("text")), " ").alias("words"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'glpat-[A-Za-z0-9.\-_]{16,}', '[REDACTED]', 'gi'), '\bBearer\s+[A-Za-z0-9\-_.=]{16,}', '[REDACTED]', 'gi'),
 '\btoken\s*[:=]\s*[A-Za-z0-9\-_.=]{16,}', '[REDACTED]', 'gi'), 'Authorization:\s*Bearer\s+[A-Za-z0-9\-_.=]{16,}', '[REDACTED]', 'gi') AS body FROM documents"""
)
def redact(spark, d):
    return docs(spark, d).select("doc_id", T.redact_secrets(F.col("text")).alias("body"))


@query(f"SELECT doc_id, trim(left(split_part(text, {_NL}, 1), coalesce(list_filter(range(1, 81), lambda k: strlen(left(split_part(text, {_NL}, 1), k)) >= 80)[1], 80))) AS head, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS short, length(text) > 500 AS cut FROM documents")
def first_lines(spark, d):
    return docs(spark, d).select("doc_id", T.first_line(F.col("text"), 80).alias("head"), T.truncate(F.col("text"), 120).alias("short"), T.maybe_truncate(F.col("text"), 500)["truncated"].alias("cut"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.xml_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') AS name, replace(url, '/', '_') AS flat FROM pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", P.safe_name(F.col("url")).alias("name"), P.slashes_to_underscores(F.col("url")).alias("flat"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'dispose') OR contains(lower(text), 'cancel(') OR contains(lower(text), 'leak') THEN 'cleanup' WHEN contains(lower(text), 'rebuild') OR contains(lower(text), 'setstate') OR contains(lower(text), 'performance') THEN 'rebuild' WHEN contains(lower(text), 'route') OR contains(lower(text), 'navigation') THEN 'routing' ELSE 'other' END AS theme FROM conversations")
def themes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.theme(F.col("text")).alias("theme"))


@query(f"WITH l AS (SELECT doc_id, list_filter({lines_sql('text')}, lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') AS l FROM documents) SELECT doc_id, left(coalesce(regexp_replace(regexp_replace(l[1], '{_WS}$', ''), '^{_WS}', ''), '') || CASE WHEN len(l) > 0 THEN ' — ' ELSE '' END || array_to_string(l[2:], ' '), 200) AS short FROM l")
def excerpts(spark, d):
    return docs(spark, d).select("doc_id", T.excerpt(F.col("text"), 200).alias("short"))


@query(f"WITH l AS (SELECT doc_id, {lines_sql('text')} AS l FROM documents) SELECT doc_id, array_to_string(list_transform(l, lambda x, i: printf('%6d | %s', i, x)), {_NL}) AS body FROM l")
def render_numbered(spark, d):
    return docs(spark, d).select("doc_id", T.numbered(F.col("text")).alias("body"))


@query(f"WITH l AS (SELECT doc_id, {lines_sql('text')} AS l, doc_id % 10 + 1 AS a, doc_id % 10 + 3 AS b FROM documents) SELECT doc_id, sha256(array_to_string(l[greatest(a - 3, 1):least(b + 3, len(l))], {_NL})) AS hash, array_to_string(l[a:least(b, len(l))], {_NL}) AS body FROM l")
def snippet_hashes(spark, d):
    a, b = F.col("doc_id") % 10 + 1, F.col("doc_id") % 10 + 3
    return docs(spark, d).select("doc_id", T.snippet_hash(F.col("text"), a.cast("int"), b.cast("int")).alias("hash"), T.slice_lines(F.col("text"), a.cast("int"), b.cast("int")).alias("body"))


@query("SELECT url, CASE WHEN ext IN ('html', 'htm') OR NOT contains(url, '.') THEN 'other' WHEN ext = 'js' THEN 'javascript' WHEN ext = 'json' THEN 'json' WHEN ext = 'py' THEN 'python' WHEN ext = 'xml' THEN 'xml' WHEN ext = 'md' THEN 'markdown' ELSE 'other' END AS language FROM (SELECT url, lower(string_split(url, '.')[-1]) AS ext FROM pages)")
def languages(spark, d):
    return table(spark, d, "pages").select("url", P.guess_language(F.col("url")).alias("language"))


_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query(f"SELECT doc_id, {_UUID} AS symbol_id FROM (SELECT doc_id, sha1(unhex('00000000000000000000000000000000') || ('sym|' || lang || '|' || source || '|0-' || n_chars || '|d' || doc_id || '|File')::BLOB) AS h FROM documents)")
def symbol_ids(spark, d):
    return docs(spark, d).select("doc_id", I.symbol_id(F.col("lang"), F.col("source"), F.lit(0), F.col("n_chars"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("File")).alias("symbol_id"))


@query("SELECT doc_id, sha256(source || '|' || lang || '|0|' || n_chars) AS chunk_id, 'rec_' || left(sha256(text), 16) AS record_id, left(sha256('gitlab:' || source || ':' || doc_id || ':' || lang), 12) AS cache_key, source || ':' || doc_id || '|line#' || left(sha256(text), 8) AS idempotency_key FROM documents")
def record_ids(spark, d):
    return docs(spark, d).select(
        "doc_id", I.chunk_id(F.col("source"), F.col("lang"), F.lit(0), F.col("n_chars")).alias("chunk_id"), I.record_id(F.col("text")).alias("record_id"),
        I.cache_key(F.lit("gitlab"), F.col("source"), F.col("doc_id"), F.col("lang")).alias("cache_key"), I.idempotency_key(F.col("source"), F.col("doc_id"), F.lit("line"), F.substring(F.sha2("text", 256), 1, 8)).alias("idempotency_key"),
    )


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 3) AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: ('0x' || left(md5(t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), 16))::UBIGINT)) AS h FROM t WHERE len(t) >= 3),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1::UBIGINT = 1 THEN 1 ELSE -1 END) AS v FROM g CROSS JOIN (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY doc_id, i),
s AS (SELECT doc_id, sum(CASE WHEN v >= 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::UBIGINT << i)::HUGEINT END ELSE 0::HUGEINT END)::BIGINT AS simhash FROM b GROUP BY doc_id)
SELECT documents.doc_id, coalesce(simhash, 0) AS simhash FROM documents LEFT JOIN s USING (doc_id)"""
)
def simhash(spark, d):
    return docs(spark, d).select("doc_id", I.simhash(F.col("text")).alias("simhash"))


@query(
    r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, ' ', '('), '([A-Za-z_]\w*)\s*\(', 1)) AS name FROM documents),
c AS (SELECT doc_id, name, count(*) AS n FROM n GROUP BY ALL) SELECT doc_id, name, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name)::INT AS rank FROM c QUALIFY rank <= 6"""
)
def top_calls(spark, d):
    """Every word that a blank follows as a call."""
    return X.top_calls(docs(spark, d).select("doc_id", F.replace(F.col("text"), F.lit(" "), F.lit("(")).alias("text")), "doc_id", "text")


_STARTS = "CASE WHEN n <= 8 THEN [0] ELSE range(0, (ceil((n - 8) / 6.0) * 6 + 1)::BIGINT, 6) END"


@query(
    f"""WITH b AS (SELECT doc_id, regexp_replace(text, '\\n+$', '') AS t FROM documents), l AS (SELECT doc_id, t, string_split(t, {_NL}) AS l, len(string_split(t, {_NL})) AS n FROM b),
w AS (SELECT doc_id, l, CASE WHEN n <= 8 AND length(t) <= 400 THEN [0] ELSE {_STARTS} END AS s FROM l),
e AS (SELECT doc_id, l, len(s) AS chunk_total, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS chunk_index FROM w)
SELECT doc_id, chunk_index::INT AS chunk_index, chunk_total::INT AS chunk_total, left(array_to_string(l[s + 1:s + 8], {_NL}), 400) AS chunk_text FROM e"""
)
def chunk_windows(spark, d):
    return C.split_chunks(docs(spark, d).select("doc_id", "text"), "text", 8, 2, 400).drop("text")


@query(
    f"""WITH l AS (SELECT doc_id, text, {lines_sql("text")} AS l FROM documents WHERE text <> ''), w AS (SELECT *, len(l) AS n FROM l WHERE len(l) > 0),
e AS (SELECT doc_id, text, l, n, unnest(CASE WHEN n <= 6 THEN [0] ELSE range(0, (ceil((n - 6) / 4.0) * 4 + 1)::BIGINT, 4) END) AS s FROM w),
x AS (SELECT doc_id, s, s // 4 AS ord, array_to_string(list_transform(l[1:s], lambda x: x || {_NL}), '') AS pre, array_to_string(list_transform(l[s + 1:s + 6], lambda x: x || {_NL}), '') AS raw, s + 6 >= n AND NOT ends_with(text, {_NL}) AS open, least(s + 6, n) AS e FROM e),
y AS (SELECT *, CASE WHEN open THEN left(raw, -1) ELSE raw END AS snippet FROM x)
SELECT doc_id, ord::INT AS ord, strlen(pre)::INT AS start_byte, (strlen(pre) + strlen(snippet))::INT AS end_byte, s::INT AS start_row, e::INT AS end_row, sha256(snippet) AS sha FROM y"""
)
def micro_chunks(spark, d):
    out = C.micro_chunks(docs(spark, d).select("doc_id", F.regexp_replace("text", "\r", "").alias("text")), "text", F.col("doc_id").cast("string"), F.lit(0), F.lit(0), 6, 2)
    return out.select("doc_id", F.col("ord").cast("int").alias("ord"), "start_byte", "end_byte", "start_row", "end_row", "sha")


@query(f"WITH l AS (SELECT doc_id, len({lines_sql('text')}) AS n FROM documents), e AS (SELECT doc_id, n, unnest(range(greatest(1, ceil(n / 10.0)::BIGINT))) AS i FROM l) SELECT doc_id, i::INT AS chunk_index, (i * 10 + 1)::INT AS first_line, least((i + 1) * 10, n)::INT AS last_line FROM e")
def chunk_by_lines(spark, d):
    return C.chunk_by_lines(docs(spark, d).select("doc_id", "text"), "text", 10).drop("text")


@query(f"WITH l AS (SELECT doc_id, len({lines_sql('text')}) AS n FROM documents) SELECT doc_id, (CASE WHEN n >= 12 THEN 1 ELSE 0 END)::INT AS chunk_index FROM l")
def pick_chunk(spark, d):
    chunks = C.chunk_by_lines(docs(spark, d).select("doc_id", "text"), "text", 10)
    return C.pick_chunk(chunks, "doc_id", F.lit(12), F.lit(14))


@query(
    f"""WITH l AS (SELECT doc_id, lang, source, split_part(coalesce(text, ''), {_NL}, 1) AS x FROM documents),
m AS (SELECT *, trim(left(x, coalesce(list_filter(range(1, 241), lambda k: strlen(left(x, k)) >= 240)[1], 240)), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS h FROM l)
SELECT doc_id, lang || ' | File | ' || source || CASE WHEN h <> '' THEN {_NL} || 'Doc: ' || h ELSE '' END AS head FROM m"""
)
def embedding_heads(spark, d):
    none = F.array().cast("array<string>")
    body = M.embedding_text(F.col("lang"), F.lit("File"), F.col("source"), F.lit(None).cast("string"), F.col("text"), none, none, none, F.lit(None).cast("string"))
    return docs(spark, d).select("doc_id", body.alias("head"))


@query("SELECT doc_id, lang || chr(10) || source || chr(10) || doc_id AS blob FROM documents")
def search_blobs(spark, d):
    return docs(spark, d).select("doc_id", M.search_blob(F.col("lang"), F.lit("  "), F.col("source"), F.lit(None).cast("string"), F.col("doc_id").cast("string")).alias("blob"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key')) AS k, json_valid(props) AS ok FROM events")
def json_aliases(spark, d):
    from codestrata.functions import semi as S

    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "string"), F.try_variant_get(v, "$.key", "string")).alias("k"), S.parse(F.col("props")).isNotNull().alias("ok"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages) GROUP BY page_id")
def hrefs(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("h")).groupBy("page_id").agg(F.count("*").alias("n"))
