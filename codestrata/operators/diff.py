"""Unified diffs as relations: files, hunks, numbered lines, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators.intervals import clusters, smallest_enclosing


def split_raw(df: DataFrame, raw_col: str) -> DataFrame:
    """Files of a raw diff of several: old_path, new_path and body; one nameless file where no header stands."""
    part = F.explode(F.filter(F.split(raw_col, r"(?:^|\n)diff --git "), lambda x: T.trim_ws(x) != ""))
    path = lambda side, mark: F.nullif(F.nullif(F.regexp_extract("body", rf"(?m)^{mark} (?:{side}/)?([^\n\t]+)", 1), F.lit("")), F.lit("/dev/null"))
    out = df.withColumn("body", part)
    return out.withColumn("old_path", path("a", "---")).withColumn("new_path", path("b", r"\+\+\+"))


def is_binary_patch(c: Column) -> Column:
    return F.contains(c, F.lit("GIT binary patch")) | c.startswith("Binary files ") | (c.startswith("Files ") & F.contains(c, F.lit(" and ")) & F.contains(c, F.lit(" differ")))


def parse_lines(changes: DataFrame, key: str, diff_col: str) -> DataFrame:
    """key, hunk, op (added, removed, context), old_line, new_line, content.

    A hunk's number is a running count of headers, a line's number the header's start plus running counts, all within one
    file's diff. A header without a comma gives its start as it stands; prelude and backslash lines go."""
    raw = changes.filter(F.col(diff_col).isNotNull() & ~is_binary_patch(F.col(diff_col)))
    # Diffs are dealt by key before they are cut, and all numbers come from one order of lines, so a task sorts its lines once.
    raw = raw.select(key, diff_col).repartition(int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    rows = raw.select(key, F.posexplode(T.lines(F.col(diff_col))).alias("pos", "line"))
    order = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    line = F.col("line")
    head = line.startswith("@@")
    number = lambda sign: F.regexp_extract("line", rf"^@@.*?{sign}(\d+)", 1).cast("int")
    op = F.when(head | line.startswith("\\"), None).when(line.startswith("+"), "added").when(line.startswith("-"), "removed").otherwise("context")
    rows = rows.select(key, "pos", "line", head.alias("_head"), op.alias("op"))
    count = lambda *ops: F.sum(F.col("op").isin(*ops).cast("int")).over(order)
    rows = rows.select("*", F.sum(F.col("_head").cast("int")).over(order).alias("hunk"), F.coalesce(count("removed", "context"), F.lit(0)).alias("_co"), F.coalesce(count("added", "context"), F.lit(0)).alias("_cn"))
    # A header's start less what was counted up to it; each side keeps the last start that could be read.
    last = lambda c: F.last(F.when(F.col("_head"), c), True).over(order)
    rows = rows.select("*", last(number("-")).alias("_o"), last(number(r"\+")).alias("_n"), last(F.col("_co")).alias("_ho"), last(F.col("_cn")).alias("_hn"))
    body = rows.filter((F.col("hunk") > 0) & F.col("op").isNotNull())
    body = body.withColumn("old_line", F.when(F.col("op") != "added", F.col("_o") + F.col("_co") - F.col("_ho") - 1)).withColumn("new_line", F.when(F.col("op") != "removed", F.col("_n") + F.col("_cn") - F.col("_hn") - 1))
    content = F.when(F.col("line").rlike(r"^[+\- ]"), F.substr("line", F.lit(2))).otherwise(F.col("line"))
    return body.select(key, F.col("hunk").cast("int").alias("hunk"), F.coalesce("op", F.lit("context")).alias("op"), F.col("old_line").cast("int").alias("old_line"), F.col("new_line").cast("int").alias("new_line"), content.alias("content"))


def candidate_paths(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """Paths of files that are neither binary nor deleted and have an added line."""
    added = lines.filter("op = 'added'").select("change_id").distinct()
    return changes.filter("not is_binary and not is_deleted").join(added, "change_id", "left_semi").select(F.coalesce("new_path", "old_path").alias("path")).distinct()


def added_lines(lines: DataFrame, key: str) -> DataFrame:
    return lines.filter("op = 'added'").groupBy(key).agg(F.array_sort(F.collect_list("new_line")).alias("added"))


def targets(added: DataFrame, symbols: DataFrame, gap: int = 2) -> DataFrame:
    """added (line_id, path, line); symbols (span_id, path, decl_line, start, end): a target for each run of added lines.

    Lines meet their smallest symbol; a run starts where a line is more than ``gap`` after the one before; a run that
    touches a declaration is the symbol, else a range, else a line."""
    placed = smallest_enclosing(added, symbols, "path", "line", "line_id").join(symbols.select("span_id", "decl_line"), "span_id", "left")
    runs = clusters(placed.withColumn("_own", F.coalesce("span_id", F.lit(-1))), ["path", "_own"], "line", gap)
    g = runs.groupBy("path", "_own", "cluster").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.coalesce(F.bool_or(F.col("line") == F.col("decl_line")), F.lit(False)).alias("touches"))
    kind = F.when(F.col("touches") & (F.col("_own") >= 0), "symbol").when(F.col("start_line") < F.col("end_line"), "range").otherwise("line")
    return g.select("path", F.when(F.col("_own") >= 0, F.col("_own")).alias("span_id"), "start_line", "end_line", kind.alias("target_kind"))


def final_target(kind: Column, start: Column, end: Column) -> Column:
    """A single line is a line, more a range, none keeps file or global, else line."""
    return F.when(start.isNull(), F.when(kind.isin("file", "global"), kind).otherwise("line")).when(start == F.coalesce(end, start), "line").otherwise("range")


def framed(c: Column) -> Column:
    """Right-trimmed lines between line feeds, for matching whole lines with ``contains``."""
    return F.concat(F.lit("\n"), F.array_join(F.transform(T.lines(c), T.rtrim_ws), "\n"), F.lit("\n"))


def removed_block(patch: Column) -> Column:
    return F.array_join(F.transform(F.filter(T.lines(patch), lambda x: x.startswith("-") & ~x.startswith("---")), lambda x: F.substr(x, F.lit(2))), "\n")


def added_block(patch: Column) -> Column:
    return F.array_join(F.transform(F.filter(T.lines(patch), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substr(x, F.lit(2))), "\n")


def patch_applies(patch: Column, head_text: Column) -> Column:
    """The removed lines stand together in the file; true without removed lines or without the file."""
    block = removed_block(patch)
    return F.when((block == "") | head_text.isNull(), True).otherwise(F.contains(framed(head_text), framed(block)))


def block_position(block: Column, text: Column) -> Column:
    """1-based line of the first place where the block's lines stand together; null if nowhere."""
    at = F.call_function("instr", framed(text), framed(block))
    return F.when((block != "") & (at > 0), F.char_length(F.regexp_replace(F.left(framed(text), at - 1), "[^\n]", "")) + 1)


def reanchor(patch: Column, text: Column) -> Column:
    """The place of the removed lines, else of the added ones."""
    return F.coalesce(block_position(removed_block(patch), text), block_position(added_block(patch), text))


def signature_line(df: DataFrame, key: str, text_col: str, tokens: Column, ranges: Column) -> DataFrame:
    """The first line in the allowed ranges with a token of 8 characters or more, or two of 3 or more."""
    rows = df.withColumn("_t", tokens).withColumn("_r", ranges).select(key, "_t", "_r", F.posexplode(T.lines(F.col(text_col))).alias("_p", "_l"))
    n = F.col("_p") + 1
    ok = (F.size("_r") == 0) | F.exists("_r", lambda r: (n >= r["start"]) & (n <= r["end"]))
    long = F.exists("_t", lambda t: (F.char_length(t) >= 8) & F.contains("_l", t))
    two = F.size(F.filter("_t", lambda t: (F.char_length(t) >= 3) & F.contains("_l", t))) >= 2
    return rows.filter(ok & (long | two)).groupBy(key).agg(F.min(n).alias("line"))


def is_large(changes: DataFrame, files: int = 200, size: int = 5 * 1024 * 1024) -> DataFrame:
    return changes.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("raw_unidiff")), F.lit(0)).alias("bytes")).withColumn("is_large", (F.col("files") > files) | (F.col("bytes") > size))
