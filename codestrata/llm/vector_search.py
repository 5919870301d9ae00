"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to the cell ``floor((a . x + b) / width)`` of a few random Gaussian (2-stable) projections. A
query visits its own cell and perturbed cells in the order of their estimated success: the probability that a neighbour at
the typical distance falls into the cell, from the normal distribution of its projections. Candidates of all tables are
ranked by the exact inner product in double precision. Inner products are made a distance by one more coordinate, the
square root of the greatest squared norm less the vector's own, so that the nearest is the one with the largest product.

``fit`` finds the exact neighbours of a bounded sample of queries among all rows, in one pass, and tries widths of a cell around
their typical distance, 4 to 12 hashes and 2 or 4 tables. Of those with which the sampled queries reach ``recall`` it takes the one that
costs the least: the rows that its probes meet, as a share of a bounded sample of rows times the number of all rows, and the probes
themselves. More rows make finer cells worth their probes. Where no choice reaches the recall with cells within ``REACH``, all queries
are answered exactly. Every row is indexed; equal vectors are indexed once with their ``k + 1`` least ids, as no
more can be among the nearest. Cells are dealt to parts by a hash of their number, those of very many rows in blocks. A query
goes once to each part that holds cells of its list, with its vector and those cells' numbers, and keeps its best k there.
A query whose cells held fewer than k candidates is answered exactly: it meets blocks of all rows.

Defined cases: vectors that are null, zero, of another length than most (of equally frequent lengths the shortest), or
hold null or non-finite components take no part, neither as query nor as candidate, nor do rows without an id, which could
neither be named nor ranked; rows of a repeated id and vector are one candidate; ties go to the smaller id; with fewer than
k candidates all are returned; an empty table gives an empty result; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import partitions, store, table
from codestrata.llm.words import STEP, mix64

TABLES, HASHES, WIDTH, REACH, BLOCK, SAMPLE, QUERIES, RECALL, SEED = 4, 4, 1.35, 3, 2048, 8000, 64, 0.97, 11
#: What ``fit`` tries: widths as multiples of the typical distance, numbers of hashes and of tables.
FACTORS, ALL_HASHES, ALL_TABLES = (0.8, 1.2, 1.8, 2.7), (4, 8, 12), (2, 4)
#: Perturbed cells that are ordered for each query and table (the least perturbed of all).
PERTURBED = 2401
#: Cells over BLOCK rows are known to all tasks: there are at most so many, as BLOCK grows with the rows.
LARGE_CELLS, PART_BYTES = 1 << 16, 1 << 26
#: Queries that a task holds, placed rows of a part, products and candidates that are held at once, and parts without need.
GROUP, PART_ROWS, PAIRS, PARTS = 1 << 15, 1 << 17, 1 << 20, 64


@dataclass
class Index:
    """Projections, offsets, the greatest norm, the width of a cell, the typical deviation of a neighbour, the probes;
    whole: probes do not reach the recall, so that queries meet all rows."""

    dim: int
    most: float
    width: float
    deviation: float
    probes: int
    tables: int = TABLES
    hashes: int = HASHES
    whole: bool = False

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(self.tables, self.dim + 1, self.hashes))
        self.b = rng.uniform(0, 1, (self.tables, self.hashes))
        self.shifts = perturbations(self.hashes)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate: 0 for queries, which are scaled to the greatest norm; the missing norm for others."""
        norm = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.hstack([x * (self.most / norm)[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.most**2 - norm**2, 0))[:, None]])

    def projected(self, x: np.ndarray, t: int) -> np.ndarray:
        return x @ self.a[t] / (self.width * self.most) + self.b[t]

    @staticmethod
    def cell(slots: np.ndarray) -> np.ndarray:
        """A number for each row of slots. Should two cells have the same, their queries meet a few rows more."""
        out = np.zeros(len(slots), dtype=np.uint64)
        for j in range(slots.shape[1]):
            out = out * STEP + slots[:, j].astype(np.int64).view(np.uint64)
        return mix64(out).view(np.int64)

    def order(self, f: np.ndarray) -> np.ndarray:
        """Cells to probe for each row of projections, the likeliest to hold a neighbour first: (rows, probes)."""
        own, shifts, combos = np.floor(f), np.arange(-REACH, REACH + 1), self.shifts
        low = own[:, :, None] + shifts - f[:, :, None]
        z = lambda v: 0.5 * (1 + _erf(v / (self.deviation * 2**0.5)))
        logp = np.log(np.maximum(z(low + 1) - z(low), 1e-12))
        total = sum(logp[:, j, combos[:, j]] for j in range(self.hashes))
        best = np.argsort(-total, axis=1, kind="stable")[:, : self.probes]
        slots = own[:, None, :] + shifts[combos[best]]
        return self.cell(slots.reshape(-1, self.hashes)).reshape(len(f), -1)


def perturbations(hashes: int) -> np.ndarray:
    """Shifts of all hashes, as places in -REACH..REACH, by how far they are from none; the first PERTURBED."""
    out = np.zeros((1, 0), dtype=np.int64)
    for j in range(hashes):  # the least perturbed prefixes hold the prefixes of the least perturbed
        out = np.hstack([np.repeat(out, 2 * REACH + 1, axis=0), np.tile(np.arange(2 * REACH + 1), len(out))[:, None]])
        far = ((out - REACH) ** 2).sum(axis=1)
        out = out[np.argsort(far, kind="stable")[:PERTURBED]]
    return out


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1.5e-7 (a rational approximation)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * y


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (floats stay floats, other numbers are doubles) of the rows that take part."""
    kind = "array<float>" if dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("vector") == (sizes["n"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _neighbours(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """The vectors of the k exact nearest rows of each query but its own, by its place in ids: one pass over ``rows``."""
    asked = rows.sparkSession.sparkContext.broadcast((ids, q))  # at most QUERIES vectors
    kind = dict(rows.dtypes)["vector"]

    def run(batches):
        own, x = asked.value
        best = [(np.full(0, 0.0), np.zeros((0, x.shape[1]))) for _ in own]
        for b in batches:
            if not b.num_rows:
                continue
            m, name = _matrix(b.column("vector")), b.column("vec_id").to_numpy()
            score = x @ m.T
            score[own[:, None] == name[None, :]] = -np.inf
            for j, (s, v) in enumerate(best):
                near = np.argpartition(-score[j], k - 1)[:k] if len(name) > k else np.arange(len(name))
                near = near[np.isfinite(score[j][near])]
                s, v = np.concatenate([s, score[j][near]]), np.vstack([v, m[near]])
                top = np.argsort(-s, kind="stable")[:k]
                best[j] = s[top], v[top]
        at = np.repeat(np.arange(len(own)), [len(s) for s, _ in best])
        vectors = pa.array(list(np.vstack([v for _, v in best])), pa.list_(pa.float32() if kind == "array<float>" else pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.concatenate([s for s, _ in best])), vectors], names=["at", "score", "vector"])

    found = rows.mapInArrow(run, f"at long, score double, vector {kind}")
    found = found.withColumn("r", F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), "vector"))).filter(F.col("r") <= k)
    out: dict[int, list] = {}
    for r in found.collect():  # at most QUERIES * k rows
        out.setdefault(r["at"], []).append(r["vector"])
    return {at: np.array(v, dtype=np.float64) for at, v in out.items()}


def choose(x: np.ndarray, asked: np.ndarray, near: list[np.ndarray], n: int, most: float, recall: float = RECALL) -> tuple[Index, float]:
    """The cheapest index for n rows, of which x is a sample, that finds ``recall`` of the queries' neighbours; and what a query costs."""
    dim = x.shape[1]
    own = np.repeat(np.arange(len(near)), [len(v) for v in near])
    every = np.vstack(near)
    plain = Index(dim, most, 1.0, 1.0, 1)
    gap = np.sqrt(((plain.lifted(asked, True)[own] - plain.lifted(every, False)) ** 2).sum(axis=1)) / most
    far = max(float(np.quantile(gap, 0.9)), 1e-3)
    typical = max(float(np.median(gap)), far / 4)
    best, cost = None, math.inf
    for hashes in ALL_HASHES:
        for factor in FACTORS:
            index = Index(dim, most, factor * far, typical / (factor * far), PERTURBED, hashes=hashes)
            index.probes = limit = len(index.shifts)
            rows, lifted, ask = index.lifted(x, False), index.lifted(every, False), index.lifted(asked, True)
            first, met = np.full(len(own), limit), np.zeros(limit)
            for t in range(TABLES):
                probes = index.order(index.projected(ask, t))
                cells, count = np.unique(index.cell(np.floor(index.projected(rows, t))), return_counts=True)
                at = np.minimum(np.searchsorted(cells, probes), len(cells) - 1)
                met += np.where(cells[at] == probes, count[at], 0).mean(axis=0)
                goal = index.cell(np.floor(index.projected(lifted, t)))
                for lo in range(0, len(own), 256):  # the first probe of any table that meets the neighbour
                    same = probes[own[lo : lo + 256]] == goal[lo : lo + 256, None]
                    first[lo : lo + 256] = np.minimum(first[lo : lo + 256], np.where(same.any(axis=1), same.argmax(axis=1), limit))
                if (first == limit).mean() ** (TABLES / (t + 1)) > 1 - recall:
                    break  # neighbours that tables miss with a probability m are missed by j of them with m ** j or more often
                need = int(np.sort(first)[math.ceil(recall * len(first)) - 1]) + 1
                if t + 1 not in ALL_TABLES or need > limit:
                    continue
                work = float(met[:need].sum()) / len(x) * n + need * (t + 1)
                if work < cost:
                    cost, best = work, Index(dim, most, index.width, index.deviation, need, t + 1, hashes)
    return best or Index(dim, most, WIDTH, typical / WIDTH, 1, whole=True), cost


def fit(rows: DataFrame, k: int, recall: float = RECALL) -> Index | None:
    """An index for ``clean`` rows, fitted on the SAMPLE rows with the least hashes of their ids; the first QUERIES of them ask."""
    n, most = rows.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).first()
    if most is None:
        return None
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).collect()
    x, ids = np.array([r["vector"] for r in got], dtype=np.float64), np.array([r["vec_id"] for r in got])
    near = _neighbours(rows, ids[:QUERIES], x[:QUERIES], k)
    if not near:
        return Index(x.shape[1], math.sqrt(most), WIDTH, 1.0, 1)
    asked = sorted(near)
    return choose(x, x[asked], [near[at] for at in asked], n, math.sqrt(most), recall)[0]


_ROW = "part int, phase int, code long, vec_id long, ids array<long>, codes array<long>, vector {0}"
_BEST = "query_id long, best array<struct<nearness:double,vec_id:long>>"


def _code(table_: int, cell: np.ndarray, block: np.ndarray | int) -> np.ndarray:
    """A number for a block of a cell. Should two have the same, their queries meet a few rows more."""
    return mix64(mix64(cell.view(np.uint64) + np.uint64(table_)) + np.asarray(block).astype(np.uint64) * np.uint64(2))


def search(vectors: DataFrame, is_query: Column, k: int = 20, index: Index | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (``is_query`` refers to vec_id), fewer only where there are fewer."""
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vector_col)
    index = index or fit(rows, k)
    result = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], result)
    kind = dict(rows.dtypes)["vector"]
    # Equal vectors once, with their k + 1 least ids (the limit is applied before and after the shuffle).
    one = W.partitionBy("vector").orderBy("vec_id")
    distinct = rows.distinct().withColumn("_r", F.row_number().over(one)).filter(F.col("_r") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    distinct = store(distinct.select(F.monotonically_increasing_id().alias("row"), "ids", "vector"), "vectors")
    n, asked = distinct.count(), rows.filter(is_query).distinct()
    n_asked = asked.count()
    block = max(BLOCK, -(-n * index.tables // LARGE_CELLS))
    groups = max(1, -(-n_asked // GROUP))
    parts = max(min(partitions(spark), PARTS), -(-n * index.tables // PART_ROWS), -(-(n_asked // groups) * index.tables * index.probes * 24 // PART_BYTES))
    group_of = lambda ids: (mix64(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)

    def cells(batches):
        for b in batches:
            x = index.lifted(_matrix(b.column("vector")), False)
            for t in range(index.tables):
                c = index.cell(np.floor(index.projected(x, t)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t, np.int32)), pa.array(c)], names=["table", "cell"])

    def to_parts(df: DataFrame, f) -> DataFrame:
        return df.mapInArrow(f, _ROW.format(kind))

    def batch(n_rows: int, **columns) -> pa.RecordBatch:
        types = {"part": pa.int32(), "phase": pa.int32(), "code": pa.int64(), "vec_id": pa.int64(), "ids": pa.list_(pa.int64()), "codes": pa.list_(pa.int64()), "vector": pa.list_(pa.float32() if kind == "array<float>" else pa.float64())}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n_rows, t) for c, t in types.items()], names=list(types))

    def nearest(pairs: DataFrame, n_parts: int) -> DataFrame:
        ranked = pairs.repartitionById(n_parts, F.col("part")).sortWithinPartitions("phase", "code").mapInArrow(_rank(k), _BEST)
        return ranked.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))

    full, short = None, asked
    if not index.whole:
        large = distinct.select("vector").mapInArrow(cells, "table int, cell long").groupBy("table", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > block).collect()
        blocks = [{r["cell"]: -(-r["n"] // block) for r in large if r["table"] == t} for t in range(index.tables)]

        def place(batches):
            """Each row in the block of its cell, for each table."""
            for b in batches:
                x = index.lifted(_matrix(b.column("vector")), False)
                spread = mix64(pc.list_element(b.column("ids"), 0).to_numpy().view(np.uint64))
                for t in range(index.tables):
                    c = index.cell(np.floor(index.projected(x, t)))
                    many = np.array([blocks[t].get(v, 1) for v in c.tolist()], dtype=np.uint64)
                    code = _code(t, c, spread % many)
                    for g in range(groups):
                        part = (code % np.uint64(parts)).astype(np.int32) + np.int32(g * parts)
                        yield batch(len(c), part=pa.array(part), phase=pa.array(np.ones(len(c), np.int32)), code=pa.array(code.view(np.int64)), vec_id=b.column("row"), ids=b.column("ids"), vector=b.column("vector"))

        def probe(batches):
            """A row for each query and part: the cells of that part that it probes."""
            for b in batches:
                x = index.lifted(_matrix(b.column("vector")), True)
                who, codes = [], []
                for t in range(index.tables):
                    c = index.order(index.projected(x, t))
                    many = np.array([blocks[t].get(v, 1) for v in c.ravel().tolist()]) if blocks[t] else np.ones(c.size, np.int64)
                    own = np.repeat(np.arange(c.size), many)
                    who.append(own // c.shape[1])
                    codes.append(_code(t, c.ravel()[own], np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)))
                who, codes = np.concatenate(who), np.concatenate(codes)
                part = (codes % np.uint64(parts)).astype(np.int64) + group_of(b.column("vec_id").to_numpy())[who] * parts
                order = np.lexsort((codes, part, who))
                who, codes, part = who[order], codes[order], part[order]
                cut = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (part[1:] != part[:-1])])) if len(who) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([cut, [len(who)]]).astype(np.int32)), pa.array(codes.view(np.int64)))
                yield batch(len(cut), part=pa.array(part[cut].astype(np.int32)), phase=pa.array(np.zeros(len(cut), np.int32)), vec_id=b.column("vec_id").take(pa.array(who[cut])), codes=lists, vector=b.column("vector").take(pa.array(who[cut])))

        best = store(nearest(to_parts(distinct, place).union(to_parts(asked, probe)), groups * parts), "nearest")
        full = best.filter(F.size("best") >= k)
        short = asked.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if index.whole or short.head(1):
        # Blocks of all rows, whatever their cell.
        every = max(min(partitions(spark), PARTS, -(-n // block)), -(-n // PART_ROWS))
        no = lambda kind_: F.lit(None).cast(kind_)
        zero, fixed = F.lit(0).cast("long"), lambda v: F.lit(v).cast("int")
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        each = lambda m: F.explode(F.sequence(fixed(0), fixed(m - 1)))
        all_rows = distinct.withColumn("b", deal("row", every)).withColumn("g", each(groups)).select((F.col("g") * every + F.col("b")).alias("part"), fixed(1).alias("phase"), zero.alias("code"), F.col("row").alias("vec_id"), "ids", no("array<long>").alias("codes"), "vector")
        again = short.withColumn("g", deal("vec_id", groups)).withColumn("b", each(every)).select((F.col("g") * every + F.col("b")).alias("part"), fixed(0).alias("phase"), no("long").alias("code"), "vec_id", no("array<long>").alias("ids"), F.array(zero).alias("codes"), "vector")
        rest = nearest(all_rows.union(again), groups * every)
        best = full.union(rest) if full is not None else rest
    out = best.select("query_id", F.posexplode("best").alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "b.vec_id", (-F.col("b.nearness")).alias("score"))


class _Best:
    """The best rows so far of the queries of a part, by their products in blocks; the k best are those by ``exact`` in the end."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norms = np.sqrt((q * q).sum(axis=1))
        #: The (k + 1)-th best product of different rows, of which at most one holds nothing but the query's own id.
        self.floor = np.full(len(q), -np.inf)
        self.longest, self.new = 0.0, 0
        self.who, self.at, self.score = [], [], []
        self.rows, self.vectors, self.names, self.held = [], [], [], 0

    def meet(self, mine: np.ndarray, x: np.ndarray, rows: np.ndarray, names: pa.Array) -> None:
        """Different rows (their vectors, numbers and lists of ids) for some of the queries."""
        self.longest = max(self.longest, float(np.sqrt((x * x).sum(axis=1).max())))
        found = False
        step = max(1, PAIRS // len(x))
        for s in range(0, len(mine), step):
            me = mine[s : s + step]
            score = self.q[me] @ x.T
            slack = 4e-16 * x.shape[1] * self.longest * self.norms[me]  # of rounding, twice
            near = score >= (self.floor[me] - slack)[:, None]
            many = np.flatnonzero(near.sum(axis=1) > 2 * (self.k + 1))
            if len(many):
                cut = np.partition(score[many], len(x) - self.k - 1, axis=1)[:, len(x) - self.k - 1]
                self.floor[me[many]] = np.maximum(self.floor[me[many]], cut)
                near[many] = score[many] >= (self.floor[me[many]] - slack[many])[:, None]
            w, r = np.nonzero(near)
            if len(w):
                found = True
                self.who.append(me[w])
                self.at.append(r + self.held)
                self.score.append(score[w, r])
                self.new += len(w)
        if found:
            self.rows.append(rows)
            self.vectors.append(x)
            self.names.append(names)
            self.held += len(x)
        if self.new > PAIRS:
            self.prune()

    def prune(self) -> None:
        """Each row once, the best k + 1 of each query and what equals the last; rows that no query holds are let go."""
        if not self.who:
            return
        who, at, score = np.concatenate(self.who), np.concatenate(self.at), np.concatenate(self.score)
        rows, vectors, names = np.concatenate(self.rows), np.vstack(self.vectors), pa.concat_arrays(self.names)
        order = np.lexsort((rows[at], who))
        who, at, score = who[order], at[order], score[order]
        first = np.concatenate([[True], (who[1:] != who[:-1]) | (rows[at[1:]] != rows[at[:-1]])])
        who, at, score = who[first], at[first], score[first]
        order = np.lexsort((-score, who))
        who, at, score = who[order], at[order], score[order]
        last = np.arange(len(who)) - np.searchsorted(who, who) == self.k
        self.floor[who[last]] = np.maximum(self.floor[who[last]], score[last])
        keep = score >= self.floor[who] - 4e-16 * vectors.shape[1] * self.longest * self.norms[who]
        who, at, score = who[keep], at[keep], score[keep]
        used, at = np.unique(at, return_inverse=True)
        self.who, self.at, self.score, self.new = [who], [at], [score], 0
        self.rows, self.vectors, self.names, self.held = [rows[used]], [vectors[used]], [names.take(pa.array(used))], len(used)

    def result(self):
        """Batches of each query's k best."""
        self.prune()
        if not self.who:
            return
        who, at = self.who[0], self.at[0]
        names, vectors, ids = self.names[0].to_pylist(), self.vectors[0], self.ids.tolist()
        best: dict[int, list[tuple[float, int]]] = {}
        for m, c in zip(who.tolist(), at.tolist(), strict=True):
            others = [v for v in names[c] if v != ids[m]]
            if others:
                s = -exact(self.q[m], vectors[c])
                best.setdefault(ids[m], []).extend((s, v) for v in others)
            if len(best) > 20_000 and ids[m] not in best:
                yield _best_batch({i: sorted(set(f))[: self.k] for i, f in best.items()})
                best = {}
        yield _best_batch({i: sorted(set(f))[: self.k] for i, f in best.items()})


def _rank(k: int):
    def run(batches):
        """The queries of a part, then its cells' rows by code: each query's k best of the whole part."""
        ids, vectors, codes, best = [], [], [], None
        for b in batches:
            first = int((b.column("phase").to_numpy() == 0).sum())
            if first:
                ids.append(b.column("vec_id").slice(0, first).to_numpy())
                vectors.append(_matrix(b.column("vector").slice(0, first)))
                codes.append(b.column("codes").slice(0, first))
            if first == b.num_rows or not ids:
                continue
            if best is None:
                best, lists = _Best(np.concatenate(ids), np.vstack(vectors), k), pa.chunked_array(codes).combine_chunks()
                code_of = lists.flatten().to_numpy()
                who = np.repeat(np.arange(len(best.ids)), pc.list_value_length(lists).to_numpy())
                order = np.argsort(code_of, kind="stable")
                code_of, who = code_of[order], who[order]
            code, x, rows, names = b.column("code").slice(first).to_numpy(), _matrix(b.column("vector").slice(first)), b.column("vec_id").slice(first).to_numpy(), b.column("ids").slice(first)
            ends = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
            asked = np.searchsorted(code_of, code[ends[:-1]], "left").tolist(), np.searchsorted(code_of, code[ends[:-1]], "right").tolist()
            for (lo, hi), a, z in zip(pairwise(ends.tolist()), *asked, strict=True):
                if a < z:
                    best.meet(who[a:z], x[lo:hi], rows[lo:hi], names.slice(lo, hi - lo))
        if best is not None:
            yield from best.result()

    return run


def exact(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product in double precision, rounded once, whatever block it is computed in."""
    return math.fsum((a * b).tolist())


def _best_batch(best):
    kind = pa.list_(pa.struct([("nearness", pa.float64()), ("vec_id", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([[{"nearness": s, "vec_id": v} for s, v in x] for x in best.values()], kind)], names=["query_id", "best"])


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
