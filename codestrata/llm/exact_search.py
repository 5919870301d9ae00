"""Exact top-k search with a vector-approximation file.

Vectors become integers (``integer_vectors``). Equal ones are stored once, with their k + 1 least ids, in two tables: the exact vectors,
and an approximation of one byte a component, the number of its cell among CELLS between bounds fitted on at most SAMPLE
rows (the outermost cells reach to the exact extremes of all rows, so bounds hold for every row).

Scan: queries in groups of at most GROUP meet the approximations in blocks. The upper bounds of a group and a batch are one matrix
product in single precision, with an allowance for its rounding, as q.x is within |q| (hi - lo) / 2 of q (lo + hi) / 2 for a cell's ends lo and hi;
lower bounds are taken of the pairs only whose upper bound counts. What a query's (k + 1)-th
best lower bound exceeds is dropped; of the rest a block gives at most HELD, the best upper bounds first, and the best
upper bound it left out. Read: the exact vectors of a query's candidates are read in the order of their bounds, the first
k + 1, then all whose upper bound reaches the k-th score found. A query is certain if no bound that a block left out
reaches its k-th score; the others (many vectors alike but for what cells tell) meet all exact vectors in blocks.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those of another length than
most, beyond the exact range, or without an id; zero vectors do. Equal rows count once; rows of one id with different
vectors are queries and candidates of their own. Ties go to the smaller id; with fewer than k candidates all are returned; an
empty table gives an empty result; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import partitions, store, table
from codestrata.llm.integer_vectors import as_integers, matrix

CELLS, SAMPLE, GROUP, SLICE, HELD, BLOCK = 64, 8000, 16_384, 512, 64, 1 << 22
#: Rows a product, rows that all bounds are taken of at first, pairs taken at once, and pairs that may wait before the best are kept.
CHUNK, FIRST, PAIRS, WAITING = 4096, 1024, 1 << 17, 1 << 21


def fit_cells(vectors: DataFrame, dim: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each cell: two matrices (dimension, cells)."""

    def extremes(batches):
        lo, hi = np.full(dim, np.iinfo(np.int32).max, np.int64), np.full(dim, np.iinfo(np.int32).min, np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("values"))
                lo, hi = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(lo), pa.array(hi)], names=["at", "lo", "hi"])

    ends = vectors.select("values").mapInArrow(extremes, "at int, lo long, hi long").groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("at").collect()
    sample = np.array([r["values"] for r in vectors.orderBy(F.xxhash64("row")).limit(SAMPLE).select("values").collect()])
    low, high = np.zeros((dim, cells), dtype=np.int64), np.zeros((dim, cells), dtype=np.int64)
    for j, r in enumerate(ends):
        inner = np.floor(np.linspace(*np.quantile(sample[:, j], [0.001, 0.999]), cells - 1)).astype(np.int64)
        low[j] = np.concatenate([[r["lo"]], np.clip(inner, r["lo"], r["hi"])])
        high[j] = np.maximum(low[j], np.append(low[j, 1:] - 1, r["hi"]))
    return low, high


def cells_of(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    return np.stack([np.searchsorted(low[j], x[:, j], "right") - 1 for j in range(x.shape[1])], axis=1).astype(np.uint8)


def _best(held: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row of two matrices, the least first."""
    if new.shape[1] > k:
        new = np.partition(new, new.shape[1] - k, axis=1)[:, -k:]
    return np.sort(np.hstack([held, new]), axis=1)[:, -k:]


class _Group:
    """Candidates of a group of queries within a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.q = q.astype(np.float64)
        self.size = np.abs(self.q)
        self.both = np.hstack([self.q, self.size]).astype(np.float32)
        self.lower = np.full((len(ids), k), -np.inf)
        self.rest = np.full(len(ids), -np.inf)
        self.held, self.new, self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    who, row, upper = (property(lambda self, i=i: self._settled()[i]) for i in range(3))

    def meet(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """A batch of rows with the ends of their cells."""
        # What rounding of the factors and of any order of the sums can take or add, in single precision and in double.
        most = max(np.abs(lo).max(), np.abs(hi).max())
        loose = (2 * lo.shape[1] + 8) * 2.0**-22 * self.size.sum(axis=1) * most
        slack = 2.0**-49 * lo.shape[1] * most * self.size.max()
        for c in range(0, len(rows), CHUNK):
            self._chunk(rows[c : c + CHUNK], (lo[c : c + CHUNK] + hi[c : c + CHUNK]) / 2, (hi[c : c + CHUNK] - lo[c : c + CHUNK]) / 2, loose, slack)

    def _chunk(self, rows: np.ndarray, middle: np.ndarray, half: np.ndarray, loose: np.ndarray, slack: float) -> None:
        ends = np.ascontiguousarray(np.hstack([middle, half]).astype(np.float32).T)
        for s in range(0, len(self.ids), SLICE):
            part, fresh = slice(s, s + SLICE), 0
            if np.isneginf(self.lower[part, 0]).any():  # the first rows, or too few so far
                fresh = FIRST
                self.lower[part] = _best(self.lower[part], self.q[part] @ middle[:fresh].T - self.size[part] @ half[:fresh].T - slack, self.k)
            upper = self.both[part] @ ends
            # Rounded down, so that a comparison in single precision loses nothing.
            least = np.nextafter((self.lower[part, 0] - loose[part] - slack).astype(np.float32), np.float32(-np.inf))
            at = np.flatnonzero(upper >= least[:, None])
            for i in range(0, len(at), PAIRS):
                w, r = np.divmod(at[i : i + PAIRS], len(rows))
                w += s
                score, wide = np.einsum("ij,ij->i", self.q[w], middle[r]), np.einsum("ij,ij->i", self.size[w], half[r])
                self.new.append((w, rows[r], score + wide + slack))
                self.waiting += len(w)
                self._raise(w[r >= fresh], (score - wide - slack)[r >= fresh])
        if self.waiting > WAITING:
            self._settled()

    def _raise(self, w: np.ndarray, lower: np.ndarray) -> None:
        """Raises the best lower bounds of queries by those of new pairs."""
        better = lower > self.lower[w, 0]
        w, lower = w[better], lower[better]
        order = np.lexsort((-lower, w))
        w, lower = w[order], lower[order]
        queries, begin, of = np.unique(w, return_index=True, return_inverse=True)
        place = np.arange(len(w)) - begin[of]
        best = np.full((len(queries), self.k), -np.inf)
        best[of[place < self.k], place[place < self.k]] = lower[place < self.k]
        self.lower[queries] = _best(self.lower[queries], best, self.k)

    def _settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the candidates with the best upper bounds (who, row, upper); pairs that wait are put among them."""
        if self.new:
            who, row, upper = (np.concatenate([h, *(n[i] for n in self.new)]) for i, h in enumerate(self.held))
            keep = upper >= self.lower[who, 0]
            who, row, upper = who[keep], row[keep], upper[keep]
            order = np.lexsort((row, -upper, who))
            who, row, upper = who[order], row[order], upper[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            out = place >= HELD
            np.maximum.at(self.rest, who[out], upper[out])
            self.held, self.new, self.waiting = (who[~out], row[~out], upper[~out]), [], 0
        return self.held

    def result(self) -> pa.RecordBatch:
        n = np.concatenate([[0], np.cumsum(np.bincount(self.who, minlength=len(self.ids)))]).astype(np.int32)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(n), pa.array(v))
        lower = pa.ListArray.from_arrays(pa.array(np.arange(len(self.ids) + 1, dtype=np.int32) * self.k), pa.array(self.lower.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(self.ids), lists(self.row), lists(self.upper), lower, pa.array(self.rest)], names=["q", "rows", "uppers", "lowers", "rest"])


def _scan(k: int, low: np.ndarray, high: np.ndarray):
    at = np.arange(len(low))

    def run(batches):
        """For each tile its queries first, then the approximations."""
        now, ids, q, group = None, [], [], None
        for b in batches:
            tile, kind = b.column("tile").to_numpy(), b.column("kind").to_numpy()
            ends = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(tile)]]).tolist()
            for s, e in zip(ends, ends[1:], strict=False):
                if s == e:
                    continue
                if tile[s] != now:
                    if group is not None:
                        yield group.result()
                    now, ids, q, group = tile[s], [], [], None
                if kind[s] == 0:
                    ids.append(b.column("row").slice(s, e - s).to_numpy())
                    q.append(matrix(b.column("values").slice(s, e - s)))
                elif ids:
                    group = group or _Group(np.concatenate(ids), np.vstack(q), k)
                    cell = np.frombuffer(b"".join(b.column("cells").slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1)
                    group.meet(b.column("row").slice(s, e - s).to_numpy(), low[at, cell].astype(np.float64), high[at, cell].astype(np.float64))
        if group is not None:
            yield group.result()

    return run


def _tiles(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int) -> DataFrame:
    """Queries (q, own, values) and rows (row, cells, values, ids) in tiles: each group of queries with each block of rows."""
    tasks = partitions(queries.sparkSession)
    groups = -(-n_queries // GROUP)
    blocks = max(-(-n_rows // BLOCK), min(-(-tasks // groups), -(-n_rows // 2048)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.withColumn("g", deal("q", groups)).withColumn("b", every(blocks))
    held = rows.withColumn("b", deal("row", blocks)).withColumn("g", every(groups))
    tile = (F.col("g") * blocks + F.col("b")).alias("tile")
    no = lambda kind: F.lit(None).cast(kind)
    first = asked.select(tile, F.lit(0).alias("kind"), F.col("q").alias("row"), "own", "values", no("array<long>").alias("ids"), no("binary").alias("cells"))
    then = held.select(tile, F.lit(1).alias("kind"), "row", no("long").alias("own"), "values", "ids", "cells")
    return first.unionByName(then).repartitionById(groups * blocks, F.col("tile")).sortWithinPartitions("tile", "kind")


def _products(batches):
    """Exact scores of pairs, and whether both are one vector."""
    for b in batches:
        if b.num_rows:
            a, x = matrix(b.column("a")).astype(np.int64), matrix(b.column("b"))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("row"), pa.array((a * x).sum(axis=1)), pa.array((a == x).all(axis=1))], names=["q", "row", "score", "same"])


def _whole(k: int):
    """For each tile its queries, then exact vectors: each query's best k candidates of that tile."""

    def run(batches):
        now, asked, q, best = None, [], None, {}
        for b in batches:
            for tile in np.unique(b.column("tile").to_numpy()).tolist():
                part = b.filter(pa.array(b.column("tile").to_numpy() == tile))
                if tile != now:
                    if best:
                        yield _found(best)
                    now, asked, q, best = tile, [], None, {}
                ask = pa.array(part.column("kind").to_numpy() == 0)
                new, rows = part.filter(ask), part.filter(pc.invert(ask))
                if new.num_rows:
                    asked += zip(new.column("row").to_pylist(), new.column("own").to_pylist(), strict=True)
                    more = matrix(new.column("values")).astype(np.int64)
                    q = more if q is None else np.vstack([q, more])
                if not rows.num_rows or q is None:
                    continue
                x, lists = matrix(rows.column("values")).astype(np.int64), rows.column("ids").to_pylist()
                for s in range(0, len(asked), SLICE):
                    score = q[s : s + SLICE] @ x.T
                    # k + 1 different vectors hold k candidates beside the query's own row; ties stay.
                    cut = np.partition(score, -min(k + 1, len(x)), axis=1)[:, -min(k + 1, len(x))]
                    for j, (me, own) in enumerate(asked[s : s + SLICE]):
                        near = np.flatnonzero(score[j] >= cut[j]).tolist()
                        new = [(-int(score[j, c]), v) for c in near for v in lists[c] if v != own or (x[c] != q[s + j]).any()]
                        best[me] = sorted(best.get(me, []) + new)[:k]
        if best:
            yield _found(best)

    return run


def _found(best) -> pa.RecordBatch:
    q = [r for r, f in best.items() for _ in f]
    pairs = [p for f in best.values() for p in f]
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([v for _, v in pairs], pa.int64()), pa.array([-s for s, _ in pairs], pa.int64())], names=["q", "vec_id", "score"])


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the greatest integer inner products for each query (``is_query`` refers to vec_id)."""
    spark = rows.sparkSession
    vectors, dim = as_integers(rows, id_col, vector_col, {}, "integers")
    vectors = vectors.filter(F.col("values").isNotNull() & F.col("vec_id").isNotNull())
    # Equal vectors once, with their k + 1 least ids (the limit is applied before and after the shuffle).
    one = W.partitionBy("values").orderBy("vec_id")
    distinct = vectors.distinct().withColumn("_r", F.row_number().over(one)).filter(F.col("_r") <= k + 1).groupBy("values").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    exact = store(distinct.select(F.monotonically_increasing_id().alias("row"), "ids", "values"), "exact")
    asked = vectors.filter(is_query).distinct()
    asked = store(asked.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("own"), "values"), "queries")
    n_rows, n_asked = exact.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = fit_cells(exact, dim, cells)

    def approximate(batches):
        for b in batches:
            if b.num_rows:
                code = cells_of(matrix(b.column("values")), low)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([c.tobytes() for c in code])], names=["row", "cells"])

    approximations = store(exact.select("row", "values").mapInArrow(approximate, "row long, cells binary"), "approximations")
    tiles = _tiles(asked, approximations.withColumns({"values": F.lit(None).cast("array<int>"), "ids": F.lit(None).cast("array<long>")}), n_asked, n_rows)
    scanned = tiles.mapInArrow(_scan(k + 1, low, high), "q long, rows array<long>, uppers array<double>, lowers array<double>, rest double")
    merged = scanned.groupBy("q").agg(
        F.flatten(F.collect_list(F.arrays_zip(F.col("uppers").alias("upper"), F.col("rows").alias("row")))).alias("found"),
        F.sort_array(F.flatten(F.collect_list("lowers")), asc=False)[k].alias("least"),
        F.max("rest").alias("rest"),
    )
    ordered = store(merged.select("q", F.sort_array(F.filter("found", lambda f: f["upper"] >= F.col("least")), asc=False).alias("found"), "rest"), "bounds")

    def read(pairs: DataFrame) -> DataFrame:
        both = pairs.join(exact.select("row", F.col("values").alias("b")), "row").join(asked.select("q", F.col("values").alias("a")), "q")
        scored = both.select("q", "row", "a", "b").mapInArrow(_products, "q long, row long, score long, same boolean")
        named = scored.join(exact.select("row", "ids"), "row").join(asked.select("q", "own"), "q").select("q", F.explode("ids").alias("vec_id"), "own", "score", "same")
        return named.filter(~F.col("same") | (F.col("vec_id") != F.col("own"))).select("q", "vec_id", "score")

    top = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k).drop("_r")
    first = store(best(read(ordered.select("q", F.explode(F.slice("found", 1, k + 1)["row"]).alias("row")))), "first")
    kth = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    reach = ordered.join(kth, "q", "left").select("q", F.explode(F.slice("found", F.lit(k + 2), F.size("found"))).alias("f"), "kth").filter(F.col("kth").isNull() | (F.col("f.upper") >= F.col("kth")))
    second = store(best(first.unionByName(read(reach.select("q", "f.row")))), "second")
    done = second.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    state = ordered.select("q", "rest").join(done, "q", "left").withColumn("certain", (F.col("rest") == float("-inf")) | F.coalesce(F.col("rest") < F.col("kth"), F.lit(False)))
    doubtful = store(state.filter(~F.col("certain")).select("q").join(asked, "q"), "doubtful")
    n_doubtful = doubtful.count()
    if n_doubtful:
        tiles = _tiles(doubtful, exact.withColumn("cells", F.lit(None).cast("binary")), n_doubtful, n_rows)
        second = second.join(doubtful.select("q"), "q", "left_anti").unionByName(best(tiles.mapInArrow(_whole(k), "q long, vec_id long, score long")))
    return second.join(asked.select("q", F.col("own").alias("query_id")), "q").withColumn("rank", F.row_number().over(top)).select("query_id", "rank", "vec_id", "score")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = {
    "op13_exact_search": """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""
}
