"""Review findings: parsing, duplicates, markers, reports."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import ids
from codestrata.functions import text as T
from codestrata.functions.vectors import SEVERITY_RANK, rank_of
from codestrata.operators.intervals import within_any
from codestrata.session import scratch


def parse_findings(raw: DataFrame, key: str = "target_id", raw_col: str = "raw", allowed_col: str = "allowed") -> DataFrame:
    """key, start, end, severity, title, body, patch of each block that has a title and a body and a fitting anchor.

    Think blocks go with their text; a body runs to the next field; equal (title in lower case, anchor) count once."""
    text = T.strict_segment(T.strip_think(F.col(raw_col)))
    blocks = F.posexplode(F.filter(F.split(F.regexp_replace(text, r"(?m)^\s*(?=ANCHOR:)", "\u0001"), "\u0001"), lambda b: T.trim_ws(b) != ""))
    d = raw.select(key, allowed_col, blocks.alias("_p", "b"))
    one = lambda p, g=1: F.nullif(F.regexp_extract("b", p, g), F.lit(""))
    start, end = one(r"(?mi)^ANCHOR:\s*(\d+)\s*-\s*(\d+)\s*$").cast("int"), one(r"(?mi)^ANCHOR:\s*(\d+)\s*-\s*(\d+)\s*$", 2).cast("int")
    valid = (start > 0) & (end >= start)
    d = d.withColumn("start", F.when(valid, start)).withColumn("end", F.when(valid, end))
    d = d.withColumn("severity", F.initcap(F.coalesce(F.lower(one(r"(?mi)^SEVERITY:\s*(High|Medium|Low)\s*$")), F.lit("low"))))
    d = d.withColumn("title", F.trim(one(r"(?mi)^TITLE:\s*(.+)$"))).withColumn("body", F.nullif(T.trim_ws(F.regexp_extract("b", r"(?s)(?:^|\n)BODY:\s*(.+?)(?=\n[A-Z]{2,}:|\z)", 1)), F.lit("")))
    d = d.withColumn("patch", F.nullif(F.regexp_extract("b", r"(?s)PATCH:\s*```diff\s*(.+?)\s*```", 1), F.lit("")))
    ok = d.filter(F.col("title").isNotNull() & F.col("body").isNotNull() & (F.col("start").isNull() | within_any(F.col("start"), F.col("end"), F.col(allowed_col))))
    w = W.partitionBy(key, F.lower("title"), "start", "end").orderBy("_p")
    out = ok.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return out.select(key, "start", "end", "severity", "title", T.sanitize_line_mentions(F.col("body"), F.col("start"), F.col("end")).alias("body"), "patch")


def heuristic(severity: Column, body: Column, start: Column, end: Column) -> Column:
    """severity * 2000, 500 for a patch, a tenth of the bytes up to 600, less three a line up to 600; 600 without an anchor."""
    span = F.when(start.isNull(), 9999).otherwise(F.greatest(F.coalesce(end, start) - start, F.lit(0)))
    return rank_of(SEVERITY_RANK, severity) * 2000 + F.when(F.contains(body, F.lit("```diff")), 500).otherwise(0) + F.least(F.floor(F.octet_length(body) / 10), F.lit(600)) - F.least(span * 3, F.lit(600))


def anchor_clusters(drafts: DataFrame, gap: int = 10) -> DataFrame:
    """Adds cluster: drafts of a path in order of their anchors; a draft joins the one before if they overlap or are at
    most ``gap`` lines apart, or if either has no anchor."""
    w = W.partitionBy("path").orderBy(F.col("start").asc_nulls_last(), "id")
    ps, pe = F.lag("start").over(w), F.lag(F.coalesce("end", "start")).over(w)
    first = F.lag("id").over(w).isNull()
    close = F.col("start").isNull() | ps.isNull() | ((F.col("start") <= pe) & (ps <= F.coalesce("end", "start"))) | (F.greatest(F.col("start") - pe, ps - F.coalesce("end", "start")) <= gap)
    return drafts.withColumn("_new", F.when(first | ~close, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


#: Distinct hashes of a group that one task takes; larger groups are decided in rounds.
GROUP, LOWEST = 4096, 64


def greedy_near(hamming_max: int = 5):
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        """In id order, drop what is within ``hamming_max`` bits of a kept one."""
        pdf = pdf.sort_values(["id", "simhash"])
        kept, n, flags = np.empty(len(pdf), np.uint64), 0, []
        for h in pdf["simhash"].to_numpy(np.int64).view(np.uint64):
            flags.append(not (np.bitwise_count(kept[:n] ^ h) <= hamming_max).any())
            if flags[-1]:
                kept[n] = h
                n += 1
        return pdf[flags]

    return keep


def _pieces(nodes: DataFrame, hamming_max: int) -> DataFrame:
    """Each node once for each of hamming_max + 1 pieces of its hash: hashes within that distance share a piece."""
    cuts = [64 * i // (hamming_max + 1) for i in range(hamming_max + 2)]
    bits = lambda a, b: F.shiftrightunsigned("simhash", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
    return nodes.withColumn("piece", F.explode(F.array(*[F.struct(F.lit(i).alias("p"), bits(a, b).alias("v")) for i, (a, b) in enumerate(pairwise(cuts))])))


def _greedy_rounds(nodes: DataFrame, hamming_max: int) -> DataFrame:
    """What ``greedy_near`` keeps of each group (g, id, simhash), decided in rounds over pieces of hashes.

    A node that is among the LOWEST undecided of all its pieces and near none of those before it is kept, as whatever is near it
    shares a piece; then all that is near a kept one is decided. The first undecided node of a group is always kept, so rounds end."""
    kept = None
    while nodes.head(1):
        pieces = _pieces(nodes, hamming_max)
        low = pieces.withColumn("_r", F.row_number().over(W.partitionBy("g", "piece").orderBy("id", "simhash"))).filter(F.col("_r") <= LOWEST)
        lists = low.groupBy("g", "piece").agg(F.array_sort(F.collect_list(F.struct("id", "simhash"))).alias("l"))
        near = lambda a, b: ids.hamming(a["simhash"], b["simhash"]) <= hamming_max
        free = F.filter("l", lambda x: ~F.exists("l", lambda y: (y < x) & near(x, y)))
        found = lists.select("g", F.explode(free).alias("x")).groupBy("g", "x").agg(F.count("*").alias("n")).filter(F.col("n") == hamming_max + 1).select("g", "x.id", "x.simhash")
        found = _written(found)
        kept = found if kept is None else kept.unionByName(found)
        by = _pieces(found, hamming_max).select("g", "piece", F.col("simhash").alias("_k"))
        decided = pieces.join(by, ["g", "piece"]).filter(ids.hamming(F.col("simhash"), F.col("_k")) <= hamming_max).select("g", "id", "simhash").distinct()
        nodes = _written(nodes.join(decided, ["g", "id", "simhash"], "left_anti"))
    return nodes if kept is None else kept


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_near(rows: DataFrame, by: list[str], hamming_max: int = 5, group: int = GROUP) -> DataFrame:
    """``rows`` (id, simhash, ...) without those within ``hamming_max`` bits of a kept one before them (in id order) in their group.

    Of equal hashes the first decides for all. A group of up to ``group`` different hashes is one task's work; those of larger
    groups meet by pieces of their hashes, in rounds that are jobs of their own. Ids are taken to be unique in a group."""
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by, "simhash").orderBy("id"))).filter("_r = 1").drop("_r")
    first = _written(first.withColumn("g", F.to_json(F.struct(*by))))
    nodes = first.select("g", "id", "simhash")
    large = nodes.groupBy("g").count().filter(F.col("count") > group).select("g")
    schema = nodes.schema
    kept = nodes.join(large, "g", "left_anti").groupBy("g").applyInPandas(greedy_near(hamming_max), schema)
    if large.head(1):
        kept = kept.unionByName(_greedy_rounds(_written(nodes.join(large, "g", "left_semi")), hamming_max))
    return first.join(kept, ["g", "id", "simhash"], "left_semi").select(*rows.columns)


def dedup_drafts(drafts: DataFrame, hamming_max: int = 5, choose=None) -> DataFrame:
    """One draft of each (path, cluster, theme): near copies go first, then the best by heuristic, or by ``choose``, a
    function of a DataFrame with a ``value`` column to rank by. A group may be of any size (``drop_near``)."""
    d = anchor_clusters(drafts).withColumn("theme", T.theme(F.col("body"))).withColumn("simhash", ids.simhash(F.col("body")))
    rest = drop_near(d, ["path", "cluster", "theme"], hamming_max)
    rest = rest.withColumn("value", heuristic(F.col("severity"), F.col("body"), F.col("start"), F.col("end")))
    rest = choose(rest) if choose else rest
    w = W.partitionBy("path", "cluster", "theme").orderBy(F.desc("value"), "id")
    return rest.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pick_best(drafts: DataFrame, key: list[str]) -> DataFrame:
    """By severity, then length, then a patch; ties by id."""
    order = [F.desc(rank_of(SEVERITY_RANK, F.col("severity"))), F.desc(F.char_length("body")), F.desc(F.contains("body", F.lit("```diff"))), F.col("id")]
    return drafts.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


#: How a published comment marks itself; the name before ``=`` is a parameter where other writers' comments are read.
MARKER_NAME = "review:key"


def markers(*bodies: DataFrame, name: str = MARKER_NAME) -> DataFrame:
    """Distinct markers, the first of each body."""
    pattern, out = rf"<!--\s*{name}=([^\s>]+)\s*-->", None
    for b in bodies:
        m = b.select(F.nullif(F.regexp_extract("body", pattern, 1), F.lit("")).alias("marker")).filter("marker is not null")
        out = m if out is None else out.union(m)
    return out.distinct()


def unpublished(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Drafts whose key no marker has."""
    keyed = drafts.withColumn("key", ids.idempotency_key(F.col("path"), F.col("line"), F.col("kind"), F.col("snippet_hash")))
    return keyed.join(existing, F.col("key") == F.col("marker"), "left_anti")


def publish_plan(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Every draft with its action, ``create`` or ``skip``."""
    keyed = drafts.withColumn("key", ids.idempotency_key(F.col("path"), F.col("line"), F.col("kind"), F.col("snippet_hash")))
    seen = existing.select(F.col("marker").alias("key"), F.lit(True).alias("_seen"))
    return keyed.join(seen, "key", "left").withColumn("action", F.when(F.col("_seen"), "skip").otherwise("create")).drop("_seen")


def counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def to_markdown(title: Column, body: Column, patch: Column) -> Column:
    """The title in bold, the body, and the patch, where there is one, in a fence."""
    fence = F.when(patch.isNotNull(), F.concat(F.lit("\n```diff\n"), T.trim_ws(patch), F.lit("\n```\n"))).otherwise("")
    return F.concat(F.lit("**"), T.trim_ws(title), F.lit("**\n\n"), T.trim_ws(body), F.lit("\n"), fence)


def report_rows(drafts: DataFrame) -> DataFrame:
    """A row for each draft (id, path, kind, line, start, end, snippet_hash, severity, body, confidence, prompt_tokens, escalated)."""
    key = ids.idempotency_key(F.col("path"), F.col("line"), F.col("kind"), F.col("snippet_hash"))
    return drafts.select(
        "id", F.col("kind").alias("target_kind"), "path", F.col("start").alias("anchor_start"), F.col("end").alias("anchor_end"), "snippet_hash", key.alias("idempotency_key"), "severity", "confidence",
        F.col("prompt_tokens").alias("prompt_len"), "escalated", F.octet_length("body").alias("body_len"),
    )


def anchor_ranges(ranges: Column) -> Column:
    """``a-b, c-d``, or a dash."""
    return F.when(F.size(ranges) == 0, "-").otherwise(F.array_join(F.transform(ranges, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ", "))
