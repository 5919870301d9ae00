"""Review rules: texts of a folder joined to files by language, global ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of rules for each extension; what has none of them is ``other``.
FOLDERS = {
    "dart": ("dart",), "rust": ("rs",), "ts": ("ts",), "js": ("tsx", "jsx", "js"), "python": ("py",), "java": ("java",), "kotlin": ("kt", "kts"),
    "cpp": ("cc", "cpp", "cxx", "hpp"), "csharp": ("cs",), "go": ("go",), "php": ("php",),
}
SEPARATOR = "\n\n---\n\n"


def rule_folder(path: Column) -> Column:
    extension = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    out = F.lit("other")
    for folder, extensions in FOLDERS.items():
        out = F.when(extension.isin(*extensions), folder).otherwise(out)
    return out


def read_rules(spark: SparkSession, root: str) -> DataFrame:
    """folder, name and text of the ``.md`` files in the folders directly below ``root``; one row a file."""
    root = root.rstrip("/")
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(root).select("value", F.col("_metadata.file_path").alias("p"))
    tail = F.url_decode(F.regexp_replace("p", r"\+", "%2B"))
    return rows.select(F.element_at(F.split(tail, "/"), -2).alias("folder"), F.element_at(F.split(tail, "/"), -1).alias("name"), F.col("value").alias("text"))


def folder_texts(rules: DataFrame) -> DataFrame:
    """body: the rules of each folder by name, each under its name; folders with nothing but white space fall out."""
    one = F.struct("name", F.concat(F.lit("### "), "name", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]), "")
    return rules.groupBy("folder").agg(body.alias("body")).filter(F.col("body").rlike(r"\S"))


def compose(files: DataFrame, rules: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """files (path) with ``rules``: the global text, then that of the path's language; empty where there is none; a null or empty path
    has the global text only. With ``most_bytes`` whole parts (global, then language) are taken while they fit.

    Texts are put together once for each language (as many as FOLDERS names, so that their table is broadcast), not for each path."""
    texts = folder_texts(rules).filter(F.col("folder").isin("global", "other", *FOLDERS))
    whole = texts.filter("folder = 'global'").select(F.concat(F.lit("## Global rules\n\n"), "body").alias("_global"))
    own = texts.filter("folder <> 'global'").select(F.col("folder").alias("_folder"), F.concat(F.lit("## Language rules ("), "folder", F.lit(")\n\n"), "body").alias("_own"))
    placed = files.withColumn("_folder", F.when(F.coalesce("path", F.lit("")) != "", rule_folder(F.col("path"))))
    out = placed.join(F.broadcast(own), "_folder", "left").join(F.broadcast(whole), F.lit(True), "left")  # twelve rows and one
    given = F.filter(F.array("_global", "_own"), lambda x: x.isNotNull())
    if most_bytes is not None:
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"), F.array().cast("array<string>").alias("out"))

        def step(a, x):
            n = a["n"] + F.octet_length(x) + F.when(F.size(a["out"]) > 0, len(SEPARATOR)).otherwise(0)
            fits = a["on"] & (n <= most_bytes)
            return F.struct(F.when(fits, n).otherwise(a["n"]).alias("n"), fits.alias("on"), F.when(fits, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

        given = F.aggregate(given, start, step, lambda a: a["out"])
    return out.withColumn("rules", F.array_join(given, SEPARATOR)).select(*files.columns, "rules")
