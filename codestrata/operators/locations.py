"""Definitions and references that a language server names, tied to bytes and chunks of the files they point into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import text as T
from codestrata.operators.intervals import smallest_enclosing

#: Fixed value: how many references of a symbol are kept as a sample.
MAX_REFERENCES = 32


def parse(answers: DataFrame, key: str, json_col: str, root: Column) -> DataFrame:
    """key, ord, origin, target, start_row, start_col, end_row, end_col of each location in an answer: one object or a list, in the
    form of a location (``uri``, ``range``) or of a link (``targetUri``, ``targetRange``). Rows are null where a range is incomplete;
    what has no URI, or is no JSON, gives no row."""
    v = F.try_parse_json(json_col)
    many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    rows = answers.select(F.col(key), root.alias("_root"), F.posexplode(F.filter(many, lambda x: x.isNotNull())).alias("ord", "v"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string"))
    link = text("$.uri").isNull()
    uri = F.coalesce(text("$.uri"), text("$.targetUri"))
    number = lambda side, part: F.when(link, F.try_variant_get("v", f"$.targetRange.{side}.{part}", "int")).otherwise(F.try_variant_get("v", f"$.range.{side}.{part}", "int"))
    rows = rows.withColumn("_uri", uri).filter("_uri is not null")
    places = {"start_row": number("start", "line"), "start_col": number("start", "character"), "end_row": number("end", "line"), "end_col": number("end", "character")}
    rows = rows.withColumns(places)
    whole = F.col("start_row").isNotNull() & F.col("start_col").isNotNull() & F.col("end_row").isNotNull() & F.col("end_col").isNotNull()
    return rows.select(key, "ord", P.origin(F.col("_uri")).alias("origin"), P.target_path(F.col("_uri"), F.col("_root")).alias("target"), *(F.when(whole, F.col(c)).alias(c) for c in places))


def line_table(files: DataFrame, text_col: str = "text") -> DataFrame:
    """path, row (from 0), line, start_byte of each line: prefix sums of the lengths of the lines before it."""
    rows = files.select("path", F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("row", "line"))
    before = W.partitionBy("path").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))


def with_bytes(locations: DataFrame, files: DataFrame, text_col: str = "text") -> DataFrame:
    """Locations with start_byte and end_byte in their target; null where the target is no file of the table or has no such row.

    Columns count UTF-16 units; one beyond the end of its line is its end."""
    lines = line_table(files, text_col)
    out = locations
    for side in ("start", "end"):
        at = lines.select(F.col("path").alias("target"), F.col("row").alias(f"{side}_row"), F.col("line").alias("_line"), F.col("start_byte").alias("_base"))
        out = out.join(at, ["target", f"{side}_row"], "left")
        out = out.withColumn(f"{side}_byte", F.col("_base") + T.utf16_column_to_bytes(F.col("_line"), F.col(f"{side}_col"))).drop("_line", "_base")
    return out


def definitions(locations: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """The first location of each key, with ``chunk_id`` of the smallest chunk (chunk_id, path, start_row, end_row) that holds its start."""
    first = locations.groupBy(key).agg(F.min_by(F.struct(*[c for c in locations.columns if c != key]), "ord").alias("d")).select(key, "d.*")
    spans = chunks.select(F.col("path").alias("target"), F.col("start_row").alias("start"), F.col("end_row").alias("end"), F.col("chunk_id").alias("span_id"))
    placed = smallest_enclosing(first.filter("start_row is not null"), spans, "target", "start_row", key)
    return first.join(placed.select(key, F.col("span_id").alias("chunk_id")), key, "left")


def references(locations: DataFrame, key: str, most: int = MAX_REFERENCES) -> DataFrame:
    """references_count of each key, and its first ``most`` locations as ``references_sample``."""
    own = [c for c in locations.columns if c not in (key, "ord")]
    rank = F.row_number().over(W.partitionBy(key).orderBy("ord", *own))
    kept = F.when(F.col("_r") <= most, F.struct("_r", F.struct(*own).alias("x")))
    grouped = locations.withColumn("_r", rank).groupBy(key).agg(F.count("*").alias("references_count"), F.array_sort(F.collect_list(kept)).alias("_s"))
    return grouped.select(key, "references_count", F.transform("_s", lambda s: s["x"]).alias("references_sample"))
