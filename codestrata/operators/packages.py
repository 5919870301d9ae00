"""Packages of a repository: their specifications, path dependencies with all they reach, and ``package:`` URIs as paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import text as T

#: The blocks of a specification that name dependencies, and its file name.
BLOCKS = ("dependencies", "dev_dependencies", "dependency_overrides")
SPEC = "pubspec.yaml"
_PLAIN = r"""^\s*(?:'([^']*)'|"([^"]*)"|([^#\s][^#]*?))\s*(?:#.*)?$"""


def _value(c):
    """A plain or quoted scalar."""
    return F.nullif(F.concat(*(F.regexp_extract(c, _PLAIN, i) for i in (1, 2, 3))), F.lit(""))


def specifications(files: DataFrame, text_col: str = "text") -> DataFrame:
    """dir, name and deps (name, path) of each file named ``pubspec.yaml``: its name and its dependencies by path, in block or
    inline form. The block a line belongs to is carried down the lines of a file; what is malformed is passed over."""
    spec = files.filter(F.element_at(F.split("path", "/"), -1) == SPEC)
    lines = spec.select("path", F.posexplode(T.lines(F.coalesce(text_col, F.lit("")))).alias("n", "line")).filter(~F.col("line").rlike(r"^\s*(#|$)"))
    w = W.partitionBy("path").orderBy("n")
    key = F.regexp_extract("line", r"^\s*['\"]?([\w-]+)['\"]?\s*:", 1)
    rest = F.regexp_replace("line", r"^\s*['\"]?[\w-]+['\"]?\s*:", "")
    rows = lines.withColumns({"indent": F.char_length(F.regexp_extract("line", r"^( *)", 1)), "key": key, "value": _value(rest)})
    rows = rows.withColumn("block", F.last(F.when(F.col("indent") == 0, F.col("key")), True).over(w))
    inside = F.col("block").isin(*BLOCKS) & (F.col("indent") > 0)
    # The first indented line of a block gives the depth of its dependencies; deeper lines belong to the dependency above.
    rows = rows.withColumn("_top", F.sum(F.when(F.col("indent") == 0, 1)).over(w))
    rows = rows.withColumn("depth", F.first(F.when(inside, F.col("indent")), True).over(W.partitionBy("path", "_top").orderBy("n")))
    rows = rows.withColumn("dep", F.last(F.when(inside & (F.col("indent") == F.col("depth")), F.col("key")), True).over(w))
    inline = _value(F.regexp_extract(rest, r"^\s*\{(?:.*[,{\s])?path\s*:\s*([^,}]+)", 1))
    at = F.when(inside & (F.col("indent") == F.col("depth")), inline).when(inside & (F.col("key") == "path"), F.col("value"))
    dep = F.when(at.isNotNull() & F.col("dep").isNotNull(), F.struct("n", F.col("dep").alias("name"), at.alias("path")))
    own = F.when((F.col("indent") == 0) & (F.col("key") == "name") & (F.col("block") == "name"), F.col("value"))
    out = rows.groupBy("path").agg(F.first(own, True).alias("name"), F.transform(F.array_sort(F.collect_list(dep)), lambda d: F.struct(d["name"].alias("name"), d["path"].alias("path"))).alias("deps"))
    return out.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), "name", "deps")


def _beside(base, path):
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.when(base == "", "").otherwise("/"), path))
    return P.normal_segments(joined)


def registry(specs: DataFrame) -> DataFrame:
    """name and dir of all packages: those with a specification, then those that only a path dependency names; of several of one name
    the first by folder."""
    own = specs.filter("name is not null").select("name", "dir", F.lit(0).alias("_k"))
    named = specs.select("dir", F.explode("deps").alias("d")).select("d.name", _beside(F.col("dir"), F.col("d.path")).alias("dir"), F.lit(1).alias("_k"))
    return own.unionByName(named).groupBy("name").agg(F.min_by("dir", F.struct("_k", "dir")).alias("dir"))


def reachable(specs: DataFrame, folder: str) -> DataFrame:
    """name and dep: every package that a package reaches by path dependencies, itself not unless on a cycle.

    Rounds that join the pairs found last with direct dependencies; pairs found before fall out, so that cycles end. Each round is
    written below ``folder``, which cuts the plan; there are as many rounds as the longest chain has links."""
    spark = specs.sparkSession
    direct = specs.filter("name is not null").select("name", F.explode("deps").alias("d")).select("name", F.col("d.name").alias("dep")).distinct()
    direct.write.mode("overwrite").parquet(f"{folder}/0")
    direct = spark.read.parquet(f"{folder}/0")
    known, last, n = direct, direct, 0
    while last.head(1):
        n += 1
        step = last.select("name", F.col("dep").alias("_via")).join(direct.select(F.col("name").alias("_via"), "dep"), "_via").select("name", "dep").distinct()
        step.join(known, ["name", "dep"], "left_anti").write.mode("overwrite").parquet(f"{folder}/{n}")
        last = spark.read.parquet(f"{folder}/{n}")
        known = spark.read.parquet(*[f"{folder}/{i}" for i in range(n + 1)])
    return known


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path with the package whose folder is the longest prefix of it; null without one. Files meet packages by equal folders: a
    path has as many as it has parts."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    near = files.select("path", F.explode(folders).alias("dir")).join(packages.select("dir", F.col("name").alias("package")), "dir")
    best = near.groupBy("path").agg(F.max_by("package", F.struct(F.char_length("dir"), "package")).alias("package"))
    return files.join(best, "path", "left")


def resolve(uses: DataFrame, packages: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """uses (path, uri) with ``target``: relative URIs from the file's folder, ``package:`` URIs below the package's ``lib``, null for
    others and unknown packages. With ``pairs`` (``reachable``) also ``declared``: whether the file's own package is or reaches it."""
    name = F.regexp_extract("uri", r"^package:([^/]+)", 1)
    rest = F.regexp_replace("uri", r"^package:[^/]+/?", "")
    rows = uses.withColumn("_name", F.when(F.col("uri").startswith("package:"), name))
    rows = rows.join(packages.select(F.col("name").alias("_name"), F.col("dir").alias("_dir")), "_name", "left")
    inside = P.normal_segments(F.concat_ws("/", F.nullif("_dir", F.lit("")), F.lit("lib"), rest))
    out = rows.withColumn("target", F.when(F.col("_name").isNull(), P.resolve_relative(F.col("path"), F.col("uri"))).when(F.col("_dir").isNotNull(), inside))
    if pairs is not None:
        owners = package_of(uses.select("path").distinct(), packages)
        links = pairs.select(F.col("name").alias("package"), F.col("dep").alias("_name"), F.lit(True).alias("_linked"))
        out = out.join(owners, "path", "left").join(links, ["package", "_name"], "left")
        out = out.withColumn("declared", F.when(F.col("_name").isNotNull(), F.col("_name").eqNullSafe(F.col("package")) | F.coalesce("_linked", F.lit(False))))
        return out.select(*uses.columns, "target", "package", "declared")
    return out.select(*uses.columns, "target")
