"""Mixing sources to target weights with a low-discrepancy source schedule.

Every source's documents are laid in a shuffled order (md5 of id and seed), and that stream of words is cut into
blocks of equal length; after its end the stream starts anew, up to ``cap`` times. The slots of the schedule take the
points of a golden-ratio sequence on a 2^31 grid, which the cumulative target shares map to sources: after any number
of slots each source's share is within a few slots of its target. The k-th slot of a source reads the source's k-th
block. Slots and words are ranked by two-level prefix sums over about sqrt(n) buckets, so that a source with a third of
all rows is never in one task.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows
that repeat (even whole rows) are each a row of the result; a null id is ordered by the empty text; equal keys are ordered
by id and size, so that ties only swap like with like; a text longer than many blocks fills them one after the other; an
empty table gives an empty result; columns other than the id, source and text are not read, and ``mixed_rows`` gives them
back whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import WORD, packed, store, table

#: Odd multiplier nearest to the golden section of 2^31, and that grid.
GOLDEN, GRID = 1327217885, 1 << 31


@dataclass
class Mix:
    """sources: targets by source; schedule: (slot, source_id, rank); pieces: runs of words in schedule order;
    documents: a row for each document with the words that the mix takes."""

    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    documents: DataFrame
    block: int
    slots: int


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, size (the number of words) and, where ``row_col`` names it, row."""
    return docs.select(
        *([F.col(row_col).alias("row")] if row_col else []), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def targets(sources: DataFrame, weights: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """Targets by water-filling: min(cap * size, level * weight), with the level that makes them sum to ratio * all sizes.

    ``sources`` has a row for each source; the windows over it are over that list alone, never over documents."""
    everything, by_name = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("_ratio", "source_id")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    return (
        sources.withColumn("source_id", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(ratio)))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_left"))
        .withColumn("_open", F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_open") * F.col("weight")), F.col("_cap")))
        .withColumn("_lo", F.coalesce(F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, -1)) / F.sum("target").over(everything), F.lit(0.0)))
        .withColumn("_hi", F.coalesce(F.lead("_lo").over(by_name), F.lit(1.0)))
        .select("source_id", "source", "source_size", "weight", "target", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, cap: int = 2, block: int = 2048, resolution: int = 4096, seed: str = "mix-1", **columns: str) -> Mix:
    """Mix ``docs``. A block has ``block`` words, or fewer where that would give under ``resolution`` slots a source."""
    spark = docs.sparkSession
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    base = store(sized(docs, **columns).withColumn("key", key), "mix-base")
    n = base.count()
    k = max(1, math.isqrt(n))
    # The order by (bucket, key) is the order by key, as the bucket is made of its leading bits.
    base = base.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * k / F.lit(1 << 32)).cast("long"))
    cells = base.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size"))
    sources = store(targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, ratio, cap), "mix-sources")
    few = sources.agg(F.count("*").alias("n"), F.sum("target").alias("t")).first()
    total = few["t"] or 0.0
    block = max(1, min(block, int(total // (resolution * max(1, few["n"])))))
    slots = round(total / block)
    c = max(1, math.isqrt(slots))
    # Sources by the cells of a grid over [0, 1) that their share touches: an equi-join finds the source of a point.
    grid = 4 * max(1, few["n"])
    share = sources.filter("hi > lo").select("source_id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1).cast("long")))).alias("cell"))
    points = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), (((F.col("id") % GRID) * GOLDEN) % GRID / F.lit(float(GRID))).alias("u"))
        .withColumn("cell", F.floor(F.col("u") * grid))
    )
    taken = points.join(share, "cell").filter("u >= lo and u < hi").select("slot", "source_id", F.floor(F.col("slot") / c).alias("chunk"))
    per_chunk = taken.groupBy("source_id", "chunk").agg(F.count("*").alias("_n"))
    before = per_chunk.select("source_id", "chunk", (F.sum("_n").over(W.partitionBy("source_id").orderBy("chunk")) - F.col("_n")).alias("_before"))
    schedule = taken.join(before, ["source_id", "chunk"]).select(
        "slot", "source_id", (F.col("_before") + F.row_number().over(W.partitionBy("source_id", "chunk").orderBy("slot")) - 1).alias("rank")
    )
    starts = (
        cells.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("cell_start", F.sum("cell_size").over(W.partitionBy("source_id").orderBy("bucket")) - F.col("cell_size"))
        .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "source_id", "source_size", "target", "cell_start")
    )
    row = ["row"] if "row" in base.columns else []
    in_cell = W.partitionBy("source_id", "bucket").orderBy("key", "doc_id", "size", *row)
    placed = (
        base.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .withColumn("place", F.row_number().over(in_cell))
        .withColumn("start", F.col("cell_start") + F.sum("size").over(in_cell.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    )
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    parts = (
        placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .withColumn("at", at)
        .withColumn("rank", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))))
        .withColumn("from_word", F.greatest(F.col("rank") * block - F.col("at"), F.lit(0).cast("long")))
        .withColumn("to_word", F.least((F.col("rank") + 1) * block - F.col("at"), F.col("size")))
    )
    joined = parts.join(schedule, ["source_id", "rank"], "left")
    own = ["source_id", "bucket", "place", "doc_id", "source", "size", "source_size", "target", *row]
    documents = joined.groupBy(*own).agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("to_word") - F.col("from_word"))), F.lit(0)).cast("long").alias("taken"))
    pieces = joined.filter("slot is not null").select("slot", "rank", "epoch", "source", "doc_id", "place", "bucket", "from_word", "to_word")
    return Mix(sources, schedule, pieces, documents, block, slots)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` for each document that the mix takes, once for each started pass (1 or 2 copies).

    Rows are told apart by id, source and text, null ids too; rows equal in all three are taken alike."""
    named = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    row = F.unhex(F.md5(F.concat_ws(":", F.md5(named("doc_id").cast("binary")), F.md5(named("source").cast("binary")), named("text")).cast("binary")))
    m = mix(docs.select("doc_id", "text", "source", row.alias("row_key")), row_col="row_key", **options)
    copies = m.documents.filter("taken > 0").groupBy(F.col("row").alias("row_key")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    return docs.select(packed(docs), row.alias("row_key")).join(copies, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.documents.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = {
    "op1_mixing": r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS key FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS source_size FROM base GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM src),
lv AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY 2 * source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
tg AS (SELECT *, coalesce(least(2 * source_size, weight * max(CASE WHEN level < 2 * source_size / weight THEN level END) OVER ()), 2 * source_size) AS target FROM lv),
lo AS (SELECT *, coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(target) OVER (), 0) AS lo FROM tg),
sh AS (SELECT *, coalesce(lead(lo) OVER (ORDER BY sid), 1.0) AS hi FROM lo),
dim AS (SELECT sum(target) AS t, greatest(1, least(2048, floor(sum(target) / (4096 * count(*)))))::BIGINT AS b FROM tg),
slots AS (SELECT ((i % 2147483648) * 1327217885) % 2147483648 / 2147483648.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT round_even(t / b, 0)::BIGINT FROM dim))) AS i)),
k AS (SELECT sid, (SELECT count(*) FROM slots WHERE u >= lo AND u < hi) AS n FROM sh),
pos AS (SELECT base.*, sh.sid, source_size::BIGINT AS source_size, target,
          sum(size) OVER (PARTITION BY sh.sid ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
        FROM base JOIN sh ON base.source IS NOT DISTINCT FROM sh.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (greatest(0, least(start + size, n * b) - start) + greatest(0, least(start + size, n * b - source_size) - start))::BIGINT AS taken
FROM pos JOIN k USING (sid) CROSS JOIN dim
"""
}
