"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last give the columns of ``documents``, and further columns of the caller's as they are,
whatever their names: a stage packs a row's columns into one while it works.

Defined cases, in every stage: a null text is the empty one; a null id is an id like any other; an empty table gives an
empty table with the same columns; very long texts are read whole. What repeated rows and ties give, each stage says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import decontaminate, mixing, near_dedup, quality, sharding
from codestrata.llm.common import delete, fresh, new_folder, packed, row_key, ship, store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, gives a score of 0.7 or more.

    Empty texts have a score like any other; repeated rows are kept or go together."""
    ship(spark)
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = docs.select(packed(docs), "text")
    return quality.score(rows, model, keep=("row",)).filter("predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one with the least id, then the least text hash.

    Of rows with the same id and text, one stays: the one whose other columns, written out, come first. Documents
    without words are copies of one another only if their texts are equal."""
    ship(spark)
    kept = near_dedup.classes(docs).filter("kept").select(row_key("doc_id", "text_key")).distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*(F.col(f"row.`{c}`") for c in others))) if others else F.lit("")
    rows = docs.select(packed(docs), row_key(F.col("doc_id").cast("long"), near_dedup.text_key("text")))
    return rows.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", rest).alias("row")).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; repeated rows are kept or go together, texts without words are kept."""
    ship(spark)
    found = fresh(docs, "matches")
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), out_col=found).filter(F.size(found) == 0).drop(found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it starts in it (once or twice).

    Documents without words are in no stretch of the mix and go; rows with the same id, source and text are taken alike."""
    ship(spark)
    return mixing.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every document; repeated rows, which the mix makes, get places of their own."""
    ship(spark)
    return sharding.shard(docs).records


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix_sources), ("shard", assign_shards)]
#: Trained, hashed and searched stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        docs = store(stage(spark, docs, sf_dir), name, path)
        if before:
            delete(spark, before)
        before = path
    return docs
