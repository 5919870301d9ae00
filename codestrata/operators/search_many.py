"""Nearest rows for many query vectors at once, and what a review's targets need from the index in one plan.

A k-NN join: queries, in groups, meet the index in blocks; a tile of both is one grouped task that keeps a running top k for each
query over Arrow batches, and the tiles' lists are merged by query. Queries and rows are replicated once for each block or
group of the other side, never paired before the tile; groups and blocks are sized by rows, so a tile's memory is
bounded (the vectors of a group of queries, one batch of rows and k hits a query)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import assembly as A

GROUP, BLOCK, SLICE = 8192, 1 << 20, 256


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs row by row, greater is nearer: the same sum whatever tile a pair is in."""
    if metric == "euclid":
        return -np.sqrt(((q - x) ** 2).sum(axis=1))
    return (q * x).sum(axis=1)


def _tile(k: int, metric: str, digits: int):
    def run(batches):
        now, names, q, best = None, [], None, {}
        for b in batches:
            tiles = b.column("tile").to_numpy()
            for tile in np.unique(tiles).tolist():
                part = b.filter(pa.array(tiles == tile))
                if tile != now:
                    if best:
                        yield _hits(best, metric)
                    now, names, q, best = tile, [], None, {}
                ask = part.column("kind").to_numpy() == 0
                asked, rows = part.filter(pa.array(ask)), part.filter(pa.array(~ask))
                if asked.num_rows:
                    x = _matrix(asked.column("vector"))
                    x = _unit(x) if metric == "cosine" else x
                    names += asked.column("key").to_pylist()
                    q = x if q is None else np.vstack([q, x])
                if q is None or not rows.num_rows:
                    continue
                x, keys = _matrix(rows.column("vector")), rows.column("key").to_pylist()
                x = _unit(x) if metric == "cosine" else x
                for s in range(0, len(names), SLICE):
                    mine = q[s : s + SLICE]
                    score = mine @ x.T
                    if metric == "euclid":
                        score = 2 * score - (x * x).sum(axis=1) - (mine * mine).sum(axis=1, keepdims=True)
                    low = np.partition(score, -min(k, len(x)), axis=1)[:, -min(k, len(x))] - 1e-6 * (1 + np.abs(score).max())
                    for j in range(len(mine)):
                        near = np.flatnonzero(score[j] >= low[j])
                        exact = np.round(_exact(np.broadcast_to(mine[j], (len(near), x.shape[1])), x[near], metric), digits)
                        name = names[s + j]
                        best[name] = sorted(best.get(name, []) + [(-v, keys[c]) for v, c in zip(exact.tolist(), near.tolist(), strict=True)])[:k]
        if best:
            yield _hits(best, metric)

    return run


def _hits(best: dict, metric: str) -> pa.RecordBatch:
    sign = 1.0 if metric == "euclid" else -1.0
    return pa.RecordBatch.from_arrays([pa.array([q for q, h in best.items() for _ in h], pa.string()), pa.array([i for h in best.values() for _, i in h], pa.string()), pa.array([sign * s + 0.0 for h in best.values() for s, _ in h], pa.float64())], names=["query_id", "id", "score"])


def search_many(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", query_col: str = "query_id", digits: int = 6, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank (from 1): the k nearest rows of each query (ids as text, ties to the smaller one).

    ``queries`` has ``query_col`` and ``vector_col``. Vectors that are null, empty or of another length than the queries'
    greatest take no part; repeated ids of one query or row are looked at as one with the best score. Scores are rounded to ``digits``."""
    if metric not in ("cosine", "dot", "euclid"):
        raise ValueError(metric)
    spark = index.sparkSession
    asked = queries.select(F.col(query_col).cast("string").alias("key"), F.col(vector_col).cast("array<double>").alias("vector")).filter("key is not null and size(vector) > 0")
    n, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    rows = index.select(F.col(id_col).cast("string").alias("key"), F.col(vector_col).cast("array<double>").alias("vector")).filter("key is not null and size(vector) > 0")
    if not n:
        return spark.createDataFrame([], "query_id string, id string, score double, rank int")
    asked, rows = asked.filter(F.size("vector") == dim), rows.filter(F.size("vector") == dim)
    groups = -(-n // group)
    total = rows.count()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-total // block), min(-(-tasks // groups), -(-total // 512)))
    deal = lambda n_: F.pmod(F.xxhash64("key"), F.lit(n_)).cast("int")
    every = lambda n_: F.explode(F.sequence(F.lit(0), F.lit(n_ - 1)))
    tile = (F.col("g") * blocks + F.col("b")).alias("tile")
    left = asked.withColumn("g", deal(groups)).withColumn("b", every(blocks)).select(tile, F.lit(0).alias("kind"), "key", "vector")
    right = rows.withColumn("b", deal(blocks)).withColumn("g", every(groups)).select(tile, F.lit(1).alias("kind"), "key", "vector")
    tiles = left.unionByName(right).repartitionById(groups * blocks, F.col("tile")).sortWithinPartitions("tile", "kind")
    found = tiles.mapInArrow(_tile(k, metric, digits), "query_id string, id string, score double")
    found = found.groupBy("query_id", "id").agg((F.min("score") if metric == "euclid" else F.max("score")).alias("score"))
    order = [F.asc("score") if metric == "euclid" else F.desc("score"), F.asc("id")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def related_context(targets: DataFrame, points: DataFrame, facts: DataFrame, embed, top_k: int = 8, take: int = 3, min_score: float = 0.50, enabled: bool = True) -> DataFrame:
    """Blocks for all targets (target_id, path, preview) in one plan: target_id, ord, path, snippet, why.

    What is asked for a target is its preview, or its path where that is short (``related_query``); targets without a path ask
    nothing and get nothing. ``embed`` maps a DataFrame with the column ``query`` to one with a column ``vector`` beside it, so that texts
    are embedded in one pass; equal questions are asked once. ``facts`` (target_id, text) come behind the hits."""
    asked = targets.select("target_id", "path", A.related_query(F.col("preview"), F.col("path")).alias("query")).filter("query is not null")
    if not enabled:
        return targets.sparkSession.createDataFrame([], "target_id string, ord int, path string, snippet string, why string")
    questions = embed(asked.select("query").distinct()).withColumn("query_id", F.sha2("query", 256))
    hits = search_many(points, questions.select("query_id", F.col("vector").alias("vector")), top_k, id_col="point_id", vector_col="vector")
    named = hits.join(A.payload_to_hit(points).select(F.col("point_id").cast("string").alias("_point"), "source", "snippet"), F.col("id") == F.col("_point")).select("query_id", "score", "source", "snippet")
    mine = asked.withColumn("query_id", F.sha2("query", 256)).select("target_id", "query_id").join(named, "query_id")
    return A.related_blocks(mine.select("target_id", "score", "source", "snippet"), facts.join(asked.select("target_id"), "target_id", "left_semi"), take, min_score)
