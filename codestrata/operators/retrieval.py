"""Vector, lexical and hybrid retrieval.

A query string is parsed on the driver (it is one line of text); everything else is a plan over the index table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import vectors as V

#: Weights of the lexical boost, and the distance in bytes within which a key and its value are near.
W_TOKEN, W_SUB, W_ALL_SUBS, W_KV_NEAR, W_KV_ANY, W_FULL, W_LANG, NEAR_BYTES, LEXICAL_BONUS = 0.10, 0.25, 0.35, 0.70, 0.30, 0.40, 0.10, 120, 0.15
LANGUAGE_HINTS = {"ts": "typescript", "js": "javascript", "py": "python", "c#": "csharp", "c++": "cpp"}
LANGUAGES = ("dart", "typescript", "javascript", "go", "rust", "java", "kotlin", "swift", "python", "csharp", "cpp", "yaml", "json", "sql")


@dataclass
class ParsedQuery:
    """Tokens (repeats kept), quoted parts, key-value pairs and a language hint of a query string."""

    raw: str
    tokens: list[str] = field(default_factory=list)
    quoted: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    language: str | None = None


def parse_query(query: str) -> ParsedQuery:
    q = query.lower()
    quoted = [b for _, b in re.findall(r"(['\"])(.*?)\1", q, re.DOTALL) if b]
    tokens = [t for t in re.split(r"[^\w/:]+", q) if len(t.encode()) >= 2]
    pairs = re.findall(r"([a-z_][\w\-]*)\s*:\s*['\"]([^'\"]+)['\"]", q)
    first = tokens[0] if tokens else ""
    hint = LANGUAGE_HINTS.get(first, first if first in LANGUAGES else None)
    return ParsedQuery(q, tokens, quoted, pairs, hint)


def search_tokens(query: str) -> list[str]:
    """Tokens of the exact keyword filter: three bytes or more."""
    return [t for t in re.split(r"[^\w/:.]+", query.lower()) if len(t.encode()) >= 3]


def haystack(symbol_path: Column, file: Column, signature: Column, snippet: Column) -> Column:
    part = lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("\n"))
    return F.lower(F.concat(part(symbol_path), part(file), part(signature), part(snippet)))


def vector_top_k(index: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", where: Column | None = None, digits: int | None = 6) -> DataFrame:
    """The k nearest rows with a ``score``; cosine and dot fall, euclid rises. Ties go to the smaller id.

    One narrow projection, then TakeOrderedAndProject: each task keeps k rows, no shuffle of the index."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = {"cosine": V.cosine, "dot": V.dot, "euclid": V.euclid}[metric](F.col(vector_col), q)
    rows = index if where is None else index.filter(where)
    rows = rows.withColumn("score", F.round(score, digits) if digits is not None else score)
    return rows.orderBy(F.col("score").asc() if metric == "euclid" else F.col("score").desc(), id_col).limit(k)


def over_fetch(index: DataFrame, query: list[float], k: int, **options) -> DataFrame:
    return vector_top_k(index, query, V.fetch_k(k), **options)


def scroll(index: DataFrame, where: Column, limit: int, id_col: str = "id") -> DataFrame:
    """Rows that match, by id, with no score."""
    return index.filter(where).orderBy(id_col).limit(limit).withColumn("score", F.lit(0.0))


def payload_filter(conditions: list[tuple[str, object]], mode: str = "any") -> Column | None:
    """Equality on strings, integers and booleans; other kinds of values are skipped. ``any`` joins by OR, ``all`` by AND."""
    out = None
    for name, value in conditions:
        if value is None or isinstance(value, (float, list, dict)):
            continue
        one = F.col(name) == F.lit(value)
        out = one if out is None else (out | one if mode == "any" else out & one)
    return out


def term_filter(query: str, terms: Column) -> Column | None:
    """Rows that have a token of the query among their search terms; None without such tokens."""
    tokens = search_tokens(query)
    return F.arrays_overlap(terms, F.array(*[F.lit(t) for t in tokens])) if tokens else None


def strong_match(query: str, text: Column) -> Column:
    """The whole query or a quoted part stands in the text."""
    p = parse_query(query)
    out = F.contains(F.lower(text), F.lit(p.raw))
    for s in p.quoted:
        out = out | F.contains(F.lower(text), F.lit(s))
    return out


def lexical_boost(hits: DataFrame, query: str, hay: Column, language: Column | None = None) -> DataFrame:
    """Adds ``boost``. Document frequencies are one aggregate over the hits (a pool of bounded size), joined back."""
    p = parse_query(query)
    hits = hits.withColumn("_hay", hay)
    contains = lambda t: F.contains(F.col("_hay"), F.lit(t))
    distinct = list(dict.fromkeys(p.tokens))
    # A repeated token counts in the frequency as often as in the sum.
    stats = hits.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"), *[(F.count_if(contains(t)) * p.tokens.count(t)).alias(f"_df{i}") for i, t in enumerate(distinct)])
    boost = F.lit(0.0)
    for i, t in enumerate(distinct):
        boost = boost + F.when(contains(t), W_TOKEN * p.tokens.count(t) * V.idf(F.col("_n"), F.col(f"_df{i}"))).otherwise(0.0)
    every = F.lit(bool(p.quoted))
    for s in p.quoted:
        boost, every = boost + F.when(contains(s), W_SUB).otherwise(0.0), every & contains(s)
    boost = boost + F.when(every, W_ALL_SUBS).otherwise(0.0)
    for k, v in p.pairs:
        at = lambda s: F.octet_length(F.substring_index(F.col("_hay"), s, 1))
        boost = boost + F.when(contains(k) & contains(v), F.when(F.abs(at(k) - at(v)) <= NEAR_BYTES, W_KV_NEAR).otherwise(W_KV_ANY)).otherwise(0.0)
    if len(p.raw.encode()) >= 4:
        boost = boost + F.when(contains(p.raw), W_FULL).otherwise(0.0)
    if p.language and language is not None:
        boost = boost + F.when(F.lower(language) == p.language, W_LANG).otherwise(0.0)
    names = [c for c in hits.columns if c != "_hay"]
    return hits.crossJoin(F.broadcast(stats)).select(*names, F.round(boost, 6).alias("boost"))  # stats: one row


def lexical_rerank(hits: DataFrame, query: str, hay: Column, language: Column | None = None, id_col: str = "id") -> DataFrame:
    """Adds boost and ``rank`` (1 first) by score plus boost, ties by id; the score stays as it was.

    Hits are a fetched pool of at most a few thousand rows, so that one window over them is right."""
    boosted = lexical_boost(hits, query, hay, language).withColumn("_key", F.round(F.col("score") + F.col("boost"), 6))
    return boosted.withColumn("rank", F.row_number().over(W.orderBy(F.desc("_key"), id_col))).drop("_key")


def hybrid_search(index: DataFrame, query: str, vector: list[float], k: int, hay: Column, terms: Column, language: Column | None = None, min_score: float = 0.0, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Vector hits, reranked lexically, with hits of a keyword filter behind them; ranks over the merged list.

    Both channels are cut to pools whose sizes depend on k alone, before any window."""
    first = lexical_rerank(over_fetch(index, vector, k, id_col=id_col, vector_col=vector_col), query, hay, language, id_col)
    first = first.filter((F.col("score") >= min_score) & (F.col("rank") <= k)).drop("boost", "rank")
    where = term_filter(query, terms)
    merged = first
    if where is not None:
        more = lexical_rerank(scroll(index, where, V.scroll_limit(k), id_col), query, hay, language, id_col)
        more = more.filter((F.col("score") >= min_score) & (F.col("rank") <= min(V.scroll_limit(k), 2 * k))).drop("boost", "rank")
        more = more.join(first.select(id_col), id_col, "left_anti").withColumn("score", F.col("score") + LEXICAL_BONUS)
        merged = first.unionByName(more)
    return lexical_rerank(merged, query, hay, language, id_col).filter(F.col("rank") <= k)


def mmr_select(hits: list[dict], query: list[float], n: int, weight: float = 0.7, div_mode: str = "min") -> list[dict]:
    """Greedy choice of n among the first 3n hits: similarity to the query against similarity to what is chosen.

    hits: rows with id, score and embedding, at most 3n of which are looked at (a bounded pool on the driver)."""

    def cos(a, b):
        m = min(len(a), len(b))
        dots, x, y = sum(a[i] * b[i] for i in range(m)), sum(v * v for v in a[:m]) ** 0.5, sum(v * v for v in b[:m]) ** 0.5
        return dots / (x * y) if x * y > 0 else 0.0

    pool = sorted(hits, key=lambda h: (-h["score"], h["id"]))[: 3 * n]
    chosen: list[dict] = []
    while pool and len(chosen) < n:
        best, best_gain = None, None
        for h in pool:
            sims = [cos(h["embedding"], c["embedding"]) for c in chosen]
            div = (min if div_mode == "min" else max)(sims) if sims else 0.0
            gain = weight * cos(query, h["embedding"]) + (1 - weight) * (1 - div) + 0.001 * h["score"]
            if best_gain is None or gain >= best_gain:
                best, best_gain = h, gain
        chosen.append(best)
        pool.remove(best)
    return sorted(chosen, key=lambda h: (-h["score"], h["id"]))


#: Seeds that a task of ``expand_neighbors`` holds, and pairs that it looks at or keeps at once.
SEEDS, PAIRS = 1 << 16, 1 << 20


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length (null as empty, null components as 0): rows and matrix."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(0.0) if n else pa.array([], pa.float64())
        out[n] = at, flat.to_numpy(zero_copy_only=False).reshape(len(at), n)
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of pairs, added up in the order of the components, as ``vectors.dot`` does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class _Near:
    """The nearest rows so far of the seeds of a task."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.floor, self.new = ids, k, np.full(len(ids), -np.inf), 0
        self.who, self.score, self.rows = [], [], []

    def meet(self, mine: np.ndarray, q: np.ndarray, x: np.ndarray, rows: pa.RecordBatch) -> None:
        """Some seeds with their vectors, and rows of their source."""
        n = min(q.shape[1], x.shape[1])
        q, x = q[:, :n], x[:, :n]
        a, b = np.sqrt(_in_order(q, q)), np.sqrt(_in_order(x, x))
        own = rows.column("id").to_numpy(zero_copy_only=False)
        step = max(1, PAIRS // len(x))
        for s in range(0, len(mine), step):
            me = mine[s : s + step]
            norms = a[s : s + step, None] * b
            score = np.divide(q[s : s + step] @ x.T, norms, out=np.zeros(norms.shape), where=~(norms <= 0))
            score[np.isnan(score)] = np.inf
            score[self.ids[me][:, None] == own] = -np.inf
            if len(x) > self.k:  # rounded scores are within half a millionth, so that what is near the k-th stays
                self.floor[me] = np.maximum(self.floor[me], np.partition(score, len(x) - self.k, axis=1)[:, len(x) - self.k])
            w, r = np.nonzero((score >= self.floor[me][:, None] - 2e-6) & (score > -np.inf))
            if len(w):
                norms = norms[w, r]
                self.who.append(me[w])
                self.score.append(np.divide(_in_order(q[w + s], x[r]), norms, out=np.zeros(len(w)), where=~(norms <= 0)))
                self.rows.append(rows.take(pa.array(r)))
                self.new += len(w)
            if self.new > PAIRS:
                self.prune()

    def prune(self) -> None:
        """Of each seed what may be among the k best by rounded score and id; of equal scores the k least ids."""
        if not self.who:
            return
        who, score, rows = np.concatenate(self.who), np.concatenate(self.score), pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0]
        key = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((np.unique(rows.column("id").to_numpy(zero_copy_only=False), return_inverse=True)[1], -key, who))
        who, score, key = who[order], score[order], key[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last = place == self.k - 1
        self.floor[who[last]] = np.maximum(self.floor[who[last]], key[last])
        run = np.concatenate([[True], (who[1:] != who[:-1]) | (key[1:] != key[:-1])])
        alike = np.arange(len(who)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        keep = (key >= self.floor[who] - 2e-6) & (alike < self.k)
        self.who, self.score, self.rows, self.new = [who[keep]], [score[keep]], [rows.take(pa.array(order[keep]))], 0


def _near(k: int):
    def run(batches):
        """The seeds of a task, then rows by source."""
        ids, vectors, sources, near = [], [], [], None
        for b in batches:
            first = int((b.column("kind").to_numpy() == 0).sum())
            if first:
                ids.append(b.column("seed").slice(0, first).to_numpy(zero_copy_only=False))
                vectors.append(b.column("vector").slice(0, first))
                sources += b.column("_source").slice(0, first).to_pylist()
            if first == b.num_rows or not ids:
                continue
            if near is None:
                near, asked, names = _Near(np.concatenate(ids), k), {}, np.array(sources, dtype=object)
                for n, (at, q) in _by_length(pa.concat_arrays(vectors)).items():
                    order = np.argsort(names[at], kind="stable")
                    at, q = at[order], q[order]
                    ends = np.concatenate([[0], np.flatnonzero(names[at[1:]] != names[at[:-1]]) + 1, [len(at)]]).tolist()
                    for lo, hi in zip(ends, ends[1:], strict=False):
                        asked.setdefault(names[at[lo]], []).append((at[lo:hi], q[lo:hi]))
            rows = b.slice(first)
            source = rows.column("_source").to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.flatnonzero(source[1:] != source[:-1]) + 1, [len(source)]]).tolist()
            for lo, hi in zip(ends, ends[1:], strict=False):
                for mine, q in asked.get(source[lo], []):
                    part = rows.slice(lo, hi - lo)
                    for at, x in _by_length(part.column("vector")).values():
                        near.meet(mine, q, x, part.select(["id", "row"]).take(pa.array(at)))
        if near is not None:
            near.prune()
            for who, score, rows in zip(near.who, near.score, near.rows, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(near.ids[who], rows.column("id").type), pa.array(score), rows.column("row")], names=["seed", "score", "row"])

    return run


def expand_neighbors(selected: DataFrame, index: DataFrame, k: int, floor: float, n: int, vector_col: str = "embedding") -> DataFrame:
    """Rows of the selected ones' sources that are near them: k for each, equal (source, fqn, text) once, 2n in all.

    Groups of seeds meet blocks of the index in tasks, source by source as products of matrices, and keep their best k there; pairs are
    never rows. Scores are those of ``vectors.cosine``, rounded to six digits."""
    spark = index.sparkSession
    seeds = selected.filter((F.col("score") >= floor) & F.col("id").isNotNull() & F.col("source").isNotNull()).select(F.col("id").alias("seed"), F.col("source").alias("_source"), F.col(vector_col).alias("vector"))
    rows = index.filter(F.col("id").isNotNull() & F.col("source").isNotNull())
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, -(-seeds.count() // SEEDS))
    blocks = max(1, -(-tasks // groups))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    tile = (F.col("_g") * blocks + F.col("_b")).alias("tile")
    row = F.struct("id", "source", "fqn", "text").alias("row")
    no = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    left = seeds.withColumn("_g", F.pmod(F.xxhash64("seed"), F.lit(groups)).cast("int")).withColumn("_b", every(blocks))
    left = left.select(tile, F.lit(0).alias("kind"), "_source", "seed", no(rows, "id").alias("id"), "vector", F.lit(None).cast(rows.select(row).schema["row"].dataType).alias("row"))
    right = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_g", every(groups))
    right = right.select(tile, F.lit(1).alias("kind"), F.col("source").alias("_source"), no(seeds, "seed").alias("seed"), "id", F.col(vector_col).alias("vector"), row)
    tiles = left.unionByName(right).repartitionById(groups * blocks, F.col("tile")).sortWithinPartitions("kind", "_source").drop("tile")
    kind = tiles.schema
    found = tiles.mapInArrow(_near(k), f"seed {kind['seed'].dataType.simpleString()}, score double, row {kind['row'].dataType.simpleString()}")
    near = found.select("seed", F.round("score", 6).alias("score"), "row.*")
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= k)
    both = selected.select("id", "source", "fqn", "text", "score").unionByName(near.select("id", "source", "fqn", "text", "score"))
    once = both.withColumn("_r", F.row_number().over(W.partitionBy("source", "fqn", "text").orderBy(F.desc("score"), "id"))).filter("_r = 1").drop("_r")
    return once.orderBy(F.desc("score"), "id").limit(2 * n)


#: The weights of the three context channels.
CHANNEL_WEIGHT = {"symbols": 0.30, "paths": 0.15, "text": 0.10}


def merge_channels(hits: DataFrame, most: int = 8) -> DataFrame:
    """hits (path, snippet, channel, base): the first base (0.5 if none) plus the weight of every occurrence."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in CHANNEL_WEIGHT.items() for x in kv]), F.col("channel"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CHANNEL_WEIGHT) for x in (c, i)]), F.col("channel"))
    merged = hits.groupBy("path", "snippet").agg((F.coalesce(F.min_by("base", F.struct(F.col("base").isNull(), order, F.col("base"))), F.lit(0.5)) + F.sum(w)).alias("score"))
    return merged.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "path", "snippet").limit(most)


def symbols_only(hits: DataFrame, least: float = 0.60) -> DataFrame:
    """hits (symbol, path, snippet, score): each (path, snippet) once, with its symbol in the snippet or a high score."""
    ok = hits.filter(F.contains("snippet", F.col("symbol")) | (F.col("score") >= least))
    return ok.withColumn("_r", F.row_number().over(W.partitionBy("path", "snippet").orderBy(F.desc("score"), "symbol"))).filter("_r = 1").drop("_r")


def search_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """Exact names, else names that contain it in any case."""
    exact = symbols.filter(F.col("name") == name)
    has_exact = exact.agg(F.count("*").alias("_exact"))  # one row
    ranked = symbols.crossJoin(F.broadcast(has_exact))
    return ranked.filter(F.when(F.col("_exact") > 0, F.col("name") == name).otherwise(F.contains(F.lower("name"), F.lit(name.lower())))).drop("_exact")


def search_path_like(symbols: DataFrame, part: str, per_path: int = 6, order: str = "symbol_id") -> DataFrame:
    rows = symbols.filter(F.contains(F.lower("path"), F.lit(part.lower())))
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(order))).filter(F.col("_r") <= per_path).drop("_r")


def search_text(symbols: DataFrame, text: str) -> DataFrame:
    """Names, then paths; rows that match both come twice."""
    by_name = symbols.filter(F.contains(F.lower("name"), F.lit(text.lower()))).withColumn("matched", F.lit("name"))
    return by_name.unionByName(search_path_like(symbols, text).withColumn("matched", F.lit("path")))


def hints_fan_out(queries: DataFrame, each: int = 2, kinds: int = 3, total: int = 12) -> DataFrame:
    """queries (kind, query, path, score): the first ``kinds`` queries of a kind, ``each`` hits of a query, equal hits once, ``total`` in all."""
    q = W.partitionBy("kind").orderBy("query")
    hits = queries.withColumn("_q", F.dense_rank().over(q)).filter(F.col("_q") <= kinds)
    hits = hits.withColumn("_r", F.row_number().over(W.partitionBy("kind", "query").orderBy(F.desc("score"), "path"))).filter(F.col("_r") <= each)
    return hits.select("path", "score").distinct().orderBy("path", F.desc("score")).limit(total)


def pack_prompt(hits: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """hits (fqn, source, score, text) as numbered blocks within ``most`` bytes; the first that does not fit is cut.

    A prompt holds a handful of selected hits: a window over them alone."""
    w = W.orderBy(*order)
    head = F.format_string("==[%d]== %s :: %s (score %.3f)\n", F.col("n"), F.col("fqn"), F.col("source"), F.col("score"))
    rows = hits.withColumn("n", F.row_number().over(w)).withColumn("block", F.concat(head, F.col("text"), F.lit("\n")))
    rows = rows.withColumn("_end", F.sum(F.octet_length("block")).over(w)).withColumn("_before", F.col("_end") - F.octet_length("block"))
    return rows.filter(F.col("_before") < most).withColumn("block", F.when(F.col("_end") <= most, F.col("block")).otherwise(F.left("block", (F.lit(most) - F.col("_before")).cast("int")))).drop("_end", "_before")


def keep_last(points: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each id: an idempotent upsert."""
    return points.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def dedup_source_text(records: DataFrame, order: str = "id") -> DataFrame:
    """The first record of each (source, text)."""
    return records.withColumn("_r", F.row_number().over(W.partitionBy("source", "text").orderBy(order))).filter("_r = 1").drop("_r")


def ordered_union(first: DataFrame, second: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of both, an id once, the first's row before the second's."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(id_col).orderBy("_p"))).filter("_r = 1").drop("_p", "_r")
