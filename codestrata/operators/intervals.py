"""Joins and merges of line intervals.

Points meet intervals on the nodes of a binary tree over the lines: an interval is at most two nodes of each level, a line lies
below one, so that a join is by equality and its rows are the input's times a logarithm. What else overlaps is joined on
coarse cells (``CELL`` lines) of a common file. Rows in the same place are joined once, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = 64


def cells(start: Column, end: Column, size: int = CELL) -> Column:
    return F.sequence(F.floor(start / size), F.floor(end / size))


def nodes(start: Column, end: Column) -> Column:
    """The largest nodes (level, node) whose lines are those from start to end (whole numbers); none if end is before start."""
    end = F.greatest(start - 1, end)  # null stays out by the filter below
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - start + 1, F.lit(1)))).cast("int") + 1)

    def of(level: Column) -> Column:
        # The first node that begins in the interval, and the one behind the last that ends in it.
        size = F.pow(F.lit(2.0), level)
        first, behind = F.ceil(start / size), F.floor((end + 1) / size)
        one = lambda odd, n: F.when((first < behind) & (F.pmod(odd, F.lit(2)) == 1), F.struct(level.alias("level"), n.alias("node")))
        return F.array(one(first, first), one(behind, behind - 1))

    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def nodes_above(line: Column, levels: Column) -> Column:
    """The nodes that hold a line, of the levels from 0 to ``levels``."""
    return F.transform(F.sequence(F.lit(0), levels), lambda level: F.struct(level.alias("level"), F.floor(line / F.pow(F.lit(2.0), level)).alias("node")))


def merge_intervals(pieces: DataFrame, key: list[str], start: str = "start", end: str = "end", score: str = "score", id_col: str = "id", gap: int = 1) -> DataFrame:
    """Blocks of overlapping or adjacent pieces (``start <= running end + gap``): start, end, n, best_id, best_score."""
    w = W.partitionBy(*key).orderBy(start, id_col)
    islands = pieces.withColumn("_reach", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_new", F.when(F.col(start) <= F.col("_reach") + gap, 0).otherwise(1))
    islands = islands.withColumn("_block", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = F.struct(F.col(score), -F.col(start), -F.col(id_col))
    return islands.groupBy(*key, "_block").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), F.max_by(id_col, best).alias("best_id"), F.max(score).alias("best_score")).drop("_block")


def _meet(points: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points (_k, _at) and spans (_k, _s, _e), each with a row for each of its ``_n``, the nodes on which they meet."""
    s = spans.withColumn("_n", F.explode(nodes(F.col("_s"), F.col("_e"))))
    highest = s.agg(F.coalesce(F.max("_n.level"), F.lit(0)).alias("_levels"))  # one row
    return points.crossJoin(F.broadcast(highest)).withColumn("_n", F.explode(nodes_above(F.col("_at"), F.col("_levels")))).drop("_levels"), s


def smallest_enclosing(points: DataFrame, spans: DataFrame, key: str, point: str, point_id: str, start: str = "start", end: str = "end", span_id: str = "span_id") -> DataFrame:
    """points with the ``span_id`` of the shortest span that holds them (the first on a tie), null if none does."""
    places = points.select(F.col(key).alias("_k"), F.col(point).alias("_at")).distinct()
    p, s = _meet(places, spans.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(span_id).alias("_i")))
    least = s.groupBy("_k", "_n").agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("l"), F.col("_s").alias("s"), F.col("_i").alias("i"))).alias("_b"))
    best = p.join(least, ["_k", "_n"]).groupBy("_k", "_at").agg(F.min("_b")["i"].alias("span_id"))
    return points.join(best, (F.col(key) == F.col("_k")) & (F.col(point) == F.col("_at")), "left").drop("_k", "_at")


def siblings(target: DataFrame, symbols: DataFrame, most: int = 12) -> DataFrame:
    """target (path, span_id, start, end): other symbols inside (path, start, end, span_id), by start, at most 12 for each.

    Places of symbols are joined with places of targets, each with its first symbols; one more than asked for, as the
    target may be among them."""
    place = ["path", "start", "end"]
    first = W.partitionBy(*place).orderBy("span_id")
    held = symbols.filter("span_id is not null").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most + 1).groupBy(*place).agg(F.collect_list("span_id").alias("_ids"))
    t = target.select("path", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    met = held.withColumn("_cell", F.floor(F.col("start") / CELL)).join(t.withColumn("_cell", F.explode(cells(F.col("_s"), F.col("_e")))), ["path", "_cell"]).filter((F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")))
    by = W.partitionBy("path", "_s", "_e").orderBy("start", "span_id")
    found = met.select("path", "_s", "_e", "start", "end", F.explode("_ids").alias("span_id")).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most + 1)
    lists = found.groupBy("path", "_s", "_e").agg(F.array_sort(F.collect_list(F.struct("start", "span_id", "end"))).alias("_all"))
    own = target.select("path", F.col("span_id").alias("target_id"), F.col("start").alias("_s"), F.col("end").alias("_e")).join(lists, ["path", "_s", "_e"])
    out = own.select("path", "target_id", F.posexplode(F.slice(F.filter("_all", lambda x: x["span_id"] != F.col("target_id")), 1, most)).alias("_p", "x"))
    return out.select("path", "target_id", "x.span_id", "x.start", "x.end", (F.col("_p") + 1).alias("ord"))


def best_overlap(chunks: DataFrame, symbols: DataFrame, key: str, epsilon: int = 1) -> DataFrame:
    """chunks (chunk_id, start, end) with the symbol of most overlap (touching counts as ``epsilon``), else the nearest by gap.

    Chunks in the same place are asked for once, symbols in the same place are one. What may overlap meets on cells. For the other chunks the nearest symbols before and behind them come from one sorted
    pass over each file's symbols and chunks."""
    s = symbols.filter(F.col("end") >= F.col("start")).groupBy(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e")).agg(F.min("symbol_id").alias("symbol_id"))
    place = F.struct("_k", "start", "end")
    c = chunks.select(F.col(key).alias("_k"), "start", "end").filter("_k is not null").distinct().select(place.alias("chunk_id"), "_k", "start", "end")
    met = c.withColumn("_c", F.explode(cells(F.col("start"), F.col("end")))).join(s.withColumn("_c", F.explode(cells(F.col("_s"), F.col("_e")))), ["_k", "_c"])
    overlap = F.least("end", "_e") - F.greatest("start", "_s")
    met = met.withColumn("o", F.when(overlap > 0, overlap).when(overlap == 0, epsilon)).filter("o is not null")
    best = met.groupBy("chunk_id").agg(F.min(F.struct((-F.col("o")).alias("o"), F.lit(0).cast("bigint").alias("g"), F.col("_s").cast("bigint").alias("s"), F.col("symbol_id").alias("i"))).alias("b"))
    rest = c.join(best.select("chunk_id"), "chunk_id", "left_anti")
    # A symbol ends before the chunk begins, or begins behind its end: the nearest of each kind, of equal ones the first.
    symbol = F.struct(F.col("_s").cast("bigint").alias("s"), F.col("symbol_id").alias("i"))
    none = F.lit(None).cast(s.select(symbol.alias("x")).schema["x"].dataType)
    ends = s.groupBy("_k", F.col("_e").alias("at")).agg(F.min(symbol).alias("x")).select("_k", "at", "x", F.lit(None).cast(c.schema["chunk_id"].dataType).alias("chunk_id"))
    starts = s.groupBy("_k", F.col("_s").alias("at")).agg(F.min(symbol).alias("x")).select("_k", "at", "x", F.lit(None).cast(c.schema["chunk_id"].dataType).alias("chunk_id"))
    asked = lambda at: rest.select("_k", F.col(at).alias("at"), none.alias("x"), "chunk_id")
    found = F.struct("x", "at")
    before = W.partitionBy("_k").orderBy("at", F.col("chunk_id").isNull()).rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("_k").orderBy("at", F.col("chunk_id").isNotNull()).rowsBetween(1, W.unboundedFollowing)
    left = ends.union(asked("start")).withColumn("f", F.last(F.when(F.col("x").isNotNull(), found), True).over(before)).filter("chunk_id is not null").select("chunk_id", "f", (F.col("at") - F.col("f.at")).cast("bigint").alias("g"))
    right = starts.union(asked("end")).withColumn("f", F.first(F.when(F.col("x").isNotNull(), found), True).over(behind)).filter("chunk_id is not null").select("chunk_id", "f", (F.col("f.at") - F.col("at")).cast("bigint").alias("g"))
    near = left.union(right).filter("f is not null").groupBy("chunk_id").agg(F.min(F.struct(F.lit(0).alias("o"), F.col("g").alias("g"), F.col("f.x.s").alias("s"), F.col("f.x.i").alias("i"))).alias("b"))
    out = lambda df: df.select("chunk_id", F.col("b.i").alias("symbol_id"), (-F.col("b.o")).alias("overlap"), F.col("b.g").alias("gap"))
    every = out(best).union(out(near))
    asked_for = chunks.select("chunk_id", F.struct(F.col(key).alias("_k"), "start", "end").alias("_place"))
    return asked_for.join(every.withColumnRenamed("chunk_id", "_place"), "_place", "left").drop("_place")


def clusters(rows: DataFrame, key: list[str], value: str, gap: int, name: str = "cluster", tie: list[str] | None = None) -> DataFrame:
    """Number runs of values within a key: a new run where a value is more than ``gap`` above the one before."""
    w = W.partitionBy(*key).orderBy(value, *(tie or []))
    new = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def within_any(start: Column, end: Column, ranges: Column) -> Column:
    """Inside one of the ranges; with none, everything is."""
    return (F.size(ranges) == 0) | F.exists(ranges, lambda r: (start >= r["start"]) & (end <= r["end"]))


def first_in_range(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """ranges (range_id, start, end) with the least ``line`` of points in them."""
    r = ranges.select("range_id", F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    p, s = _meet(points.select(F.col(key).alias("_k"), F.col("line").alias("_at")).distinct(), r.select("_k", "_s", "_e").distinct())
    least = p.groupBy("_k", "_n").agg(F.min("_at").alias("line"))
    hit = s.join(least, ["_k", "_n"]).groupBy("_k", "_s", "_e").agg(F.min("line").alias("line"))
    return r.join(hit, ["_k", "_s", "_e"], "left").select("range_id", "line")


def anti_overlapping(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` that share no key (null is a key too) with a span of ``old`` that they overlap."""
    of = lambda df, s, e: df.select(F.to_json(F.struct(*key)).alias("_k"), F.col("start").alias(s), F.col("end").alias(e), F.explode(cells(F.col("start"), F.col("end"))).alias("_c"))
    met = of(new, "_s", "_e").join(of(old, "_s2", "_e2"), ["_k", "_c"]).filter((F.col("_s") <= F.col("_e2")) & (F.col("_s2") <= F.col("_e"))).select("_k", "_s", "_e").distinct()
    return new.join(met, (F.to_json(F.struct(*key)) == F.col("_k")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left_anti")


def prev_next(rows: DataFrame, key: str, order: str, id_col: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order, id_col)
    return rows.withColumn("prev_id", F.lag(id_col).over(w)).withColumn("next_id", F.lead(id_col).over(w))
