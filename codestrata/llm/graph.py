"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import HOT, Scratch, store

#: A node with more edges than this, and than twice a HOT-th of all, is a hub; a graph with fewer edges has none.
HUB = 1 << 16


def _pairs(df: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    """Rows (u, v) for each of the pairs in each row, without loops."""
    out = df.select(F.explode(F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in pairs))).alias("e"))
    return out.select("e.u", "e.v").filter("u != v")


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Large star: neighbours above a node are tied to its least neighbour; small star: the node and those below it.

    A hub meets its edges by a broadcast row: there are at most 2 * HOT hubs. Elsewhere a node's edges are a window."""
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    met = _pairs(edges, (u, v), (v, u)) if large else _pairs(edges, (F.greatest(u, v), F.least(u, v)))
    if n <= HUB:
        tied = met.withColumn("m", F.least(F.min("v").over(W.partitionBy("u")), u))
    else:
        share = max(HUB, n // HOT)
        least = met.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
        hubs = F.broadcast(least.filter(F.col("_n") > share).select("u", F.col("m").alias("_m")))
        found = met.join(hubs, "u", "left")
        tied = found.filter("_m is null").select("u", "v").join(least.filter(F.col("_n") <= share).select("u", "m"), "u").union(found.filter("_m is not null").select("u", "v", F.col("_m").alias("m")))
    return _pairs(tied.filter("v > u"), (v, m)) if large else _pairs(tied, (v, m), (u, m))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component) of each node that has an edge; edges (u, v); a component is named by its least id.

    Alternates large-star and small-star steps until the edges are stars round the least ids. Each round is a written
    table. It ends after about the squared logarithm of the nodes; should ``rounds`` not do, it raises and gives no
    unfinished components."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.store(_pairs(edges, (F.greatest("u", "v"), F.least("u", "v"))).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            out = now.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("e"))
            out = store(out.select("e.id", "e.component").distinct(), "components")
            scratch.clear()
            return out
        seen = tuple(mark)
        now = scratch.store(_star(_star(now, True, mark[0]), False, mark[0]).distinct(), "edges")
    raise RuntimeError(f"the components are not done after {rounds} rounds")
