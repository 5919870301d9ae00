"""Line windows over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import text as T


def window_starts(n: Column, most: int, stride: int) -> Column:
    """0-based starts; a window opens only while the one before has not reached the end. One start for an empty text."""
    return F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - most) / stride).cast("int") * stride, F.lit(stride)))


def split_chunks(df: DataFrame, text_col: str, max_lines: int = 200, overlap: int = 4, max_chars: int = 4000) -> DataFrame:
    """chunk_index, chunk_total and chunk_text (cut at ``max_chars``) for windows of lines; one chunk if all fits."""
    stride = max(max_lines - overlap, 1)
    body = F.regexp_replace(text_col, r"\n+$", "")
    d = df.withColumn("_l", F.split(body, "\n", -1)).withColumn("_whole", (F.size("_l") <= max_lines) & (F.char_length(body) <= max_chars))
    d = d.withColumn("_starts", F.when(F.col("_whole"), F.array(F.lit(0))).otherwise(window_starts(F.size("_l"), max_lines, stride)))
    out = d.select(*df.columns, "_l", F.size("_starts").alias("chunk_total"), F.posexplode("_starts").alias("_p", "_s"))
    chunk = F.array_join(F.slice("_l", F.col("_s") + 1, F.lit(max_lines)), "\n")
    return out.select(*df.columns, (F.col("_p") + 1).alias("chunk_index"), "chunk_total", F.left(chunk, F.lit(max_chars)).alias("chunk_text"))


def micro_chunks(df: DataFrame, text_col: str, parent: Column, base_byte: Column, base_row: Column, max_lines: int, overlap: int, role=None) -> DataFrame:
    """Windows that keep their line feeds, with byte and row spans counted from the parent's; ``role`` maps the snippet."""
    step = max(max_lines - overlap, 1)
    with_ends = F.transform(T.lines(F.col(text_col)), lambda x: F.concat(x, F.lit("\n")))
    # The last line has an end only if the text does.
    d = df.withColumn("_l", with_ends).withColumn("_open", (F.col(text_col) != "") & ~F.col(text_col).endswith("\n"))
    d = d.filter(F.size("_l") > 0).select(*df.columns, "_l", "_open", F.posexplode(window_starts(F.size("_l"), max_lines, step)).alias("ord", "_s"))
    joined = lambda a: F.array_join(a, "")
    raw = joined(F.slice("_l", F.col("_s") + 1, F.lit(max_lines)))
    last = F.col("_s") + max_lines >= F.size("_l")
    snippet = F.when(last & F.col("_open"), F.left(raw, F.char_length(raw) - 1)).otherwise(raw)
    before = F.octet_length(joined(F.slice("_l", F.lit(1), F.col("_s"))))
    out = d.withColumn("snippet", snippet).withColumn("start_byte", base_byte + before).withColumn("end_byte", F.col("start_byte") + F.octet_length("snippet"))
    out = out.withColumn("start_row", base_row + F.col("_s")).withColumn("end_row", base_row + F.least(F.col("_s") + max_lines, F.size("_l")))
    out = out.withColumn("end_col", F.when(F.col("snippet").endswith("\n"), F.octet_length(F.regexp_extract("snippet", r"([^\n]*)\n$", 1))).otherwise(F.octet_length(F.substring_index("snippet", "\n", -1))))
    out = out.withColumn("id", ids.micro_id(parent, F.col("ord"), F.col("start_byte"), F.col("end_byte"))).withColumn("sha", F.sha2("snippet", 256))
    return out.withColumn("role", role(F.col("snippet")) if role else F.lit(None).cast("string")).drop("_l", "_open", "_s")


def chunk_by_lines(df: DataFrame, text_col: str, max_lines: int) -> DataFrame:
    """chunk_index from 0 and 1-based first and last lines of parts that do not overlap; at least one."""
    n = F.size(T.lines(F.col(text_col)))
    parts = F.greatest(F.lit(1), F.ceil(n / max_lines).cast("int"))
    d = df.withColumn("_n", n).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), parts - 1)))
    return d.withColumn("first_line", F.col("chunk_index") * max_lines + 1).withColumn("last_line", F.least((F.col("chunk_index") + 1) * max_lines, F.col("_n"))).drop("_n")


def pick_chunk(chunks: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """The index of the first chunk that the anchor meets, else the first."""
    meets = (F.col("first_line") <= last) & (F.col("last_line") >= first)
    return chunks.groupBy(key).agg(F.coalesce(F.min(F.when(meets, F.col("chunk_index"))), F.min("chunk_index")).alias("chunk_index"))


def brace_body(df: DataFrame, key: str, text_col: str, from_line: Column, reach: int = 4) -> DataFrame:
    """The body that opens within ``reach`` lines of a declaration: first and last line by brace depth; null if none closes."""
    rows = F.transform(T.lines(F.col(text_col)), lambda x, i: F.struct((i + 1).alias("n"), (F.char_length(F.regexp_replace(x, r"[^{]", "")) - F.char_length(F.regexp_replace(x, r"[^}]", ""))).alias("d"), F.contains(x, F.lit("{")).alias("o")))
    opens = F.get(F.filter(rows, lambda r: r["o"] & (r["n"] >= from_line) & (r["n"] <= from_line + reach)), F.lit(0))["n"]
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
    step = lambda a, r: F.when(a["end"].isNotNull() | (r["n"] < F.col("_o")), a).otherwise(F.struct((a["depth"] + r["d"]).alias("depth"), F.when(a["depth"] + r["d"] <= 0, r["n"]).alias("end")))
    d = df.withColumn("_o", opens).withColumn("_rows", rows)
    return d.select(key, F.col("_o").alias("body_start"), F.when(F.col("_o").isNotNull(), F.aggregate("_rows", start, step, lambda a: a["end"])).alias("body_end"))
