"""The typed code graph: edges by rules, and ranked neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions.vectors import LABEL_PRIORITY, rank_of

#: What files do not declare, by linker.
NOT_DECLARED = {"dart": ("file", "import", "export", "part", "part_of"), "generic": ("file", "import", "export", "part", "part_of"), "typescript": ("file", "import", "export"), "python": ("file", "import"), "rust": ("file", "import")}
#: Labels of edges, and which are followed from which profile of a record.
ALLOWED = {
    "file": ("declares", "imports", "exports", "reexports", "imports_via_export", "part", "same_file"),
    "class_like": ("declares", "extends", "implements", "inherits", "uses", "decorates", "calls", "same_file"),
    "callable": ("calls", "uses", "decorates", "extends", "implements", "inherits", "same_file", "declares"),
    "other": ("declares", "uses", "calls", "imports", "exports", "same_file", "extends", "implements", "inherits", "part", "reexports", "imports_via_export", "decorates", "routes_to"),
}
PROFILES = {"file": "file", "class": "class_like", "enum": "class_like", "mixin": "class_like", "extension": "class_like", "extension_type": "class_like", "interface": "class_like", "method": "callable", "function": "callable"}


def profile(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv]), F.lower(kind)), F.lit("other"))


def declares(nodes: DataFrame, language: str = "dart") -> DataFrame:
    """Edges from each file node to the symbols of its file: an equi-join on file."""
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("src"), "file")
    members = nodes.filter(~F.col("kind").isin(*NOT_DECLARED[language])).select(F.col("id").alias("dst"), "file")
    return files.join(members, "file").select("src", "dst", F.lit("declares").alias("label"))


def same_file(nodes: DataFrame) -> DataFrame:
    """Edges between all different nodes of a file (a rule of the graph: its size is the output's)."""
    a, b = nodes.select(F.col("id").alias("src"), "file"), nodes.select(F.col("id").alias("dst"), "file")
    return a.join(b, "file").filter("src != dst").select("src", "dst", F.lit("same_file").alias("label"))


#: What TypeScript resolution tries.
TS_EXTENSIONS, TS_INDEXES = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs"), ("/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def import_edges(nodes: DataFrame, language: str = "dart") -> DataFrame:
    """Edges between file nodes from import, export and part rows: the resolved target, else the language's guess."""
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("_fid"), F.col("file").alias("_ff"))
    rows = nodes.filter(F.col("kind").isin("import", "export", "part")).select("file", "name", "kind", "resolved_target")
    relative = F.col("name").startswith("./") | F.col("name").startswith("../")
    base = F.regexp_replace("file", r"[^/]*$", "")
    joined = P.normal_segments(F.concat(base, F.col("name")))
    if language == "dart":
        guess = F.array(F.when(relative | F.col("name").endswith(".dart"), joined))
    elif language == "typescript":
        guess = F.when(F.col("name").startswith("."), F.concat(F.array(joined), *[F.array(F.concat(joined, F.lit(e))) for e in (*TS_EXTENSIONS, *TS_INDEXES)])).otherwise(F.array().cast("array<string>"))
    elif language == "python":
        guess = F.array(F.when(F.col("name").startswith("."), P.normal_segments(F.concat(base, F.translate(F.regexp_replace("name", r"^\.+", ""), ".", "/"), F.lit(".py")))))
    else:
        guess = None
    src = files.withColumnsRenamed({"_fid": "src", "_ff": "_sf"})
    if guess is None:  # any file that ends with the last segment: the least path, by an equi-join on that segment
        tail = F.element_at(F.split(F.col("name"), "/"), -1)
        named = files.withColumn("_t", F.element_at(F.split(F.col("_ff"), "/"), -1)).groupBy("_t").agg(F.min_by("_fid", "_ff").alias("_fid"), F.min("_ff").alias("_ff"))
        direct = rows.filter("resolved_target is not null").join(files, F.col("resolved_target") == F.col("_ff"))
        found = direct.unionByName(rows.filter("resolved_target is null").withColumn("_t", tail).join(named, "_t").drop("_t"))
    else:
        tries = rows.select("*", F.posexplode_outer(F.when(F.col("resolved_target").isNotNull(), F.array("resolved_target")).otherwise(guess)).alias("_p", "_target"))
        hit = tries.join(files, F.col("_target") == F.col("_ff"))
        found = hit.withColumn("_r", F.row_number().over(W.partitionBy("file", "name", "kind").orderBy("_p"))).filter("_r = 1")
    label = F.when(F.col("kind") == "import", "imports").when(F.col("kind") == "export", "exports").otherwise("part")
    return found.join(src, F.col("file") == F.col("_sf")).select("src", F.col("_fid").alias("dst"), label.alias("label"))


def imports_via_export(edges: DataFrame) -> DataFrame:
    """One hop: a file imports a facade that exports an implementation (repeats kept)."""
    i = edges.filter("label = 'imports'").select("src", F.col("dst").alias("_mid"))
    e = edges.filter("label = 'exports'").select(F.col("src").alias("_mid"), "dst")
    return i.join(e, "_mid").select("src", "dst", F.lit("imports_via_export").alias("label"))


def intrafile_calls(nodes: DataFrame) -> DataFrame:
    """Callables whose signature (else doc) contains another callable's name, in the same file."""
    c = nodes.filter(F.col("kind").isin("function", "method"))
    a = c.select(F.col("id").alias("src"), "file", F.coalesce("signature", "doc").alias("_text"))
    b = c.select(F.col("id").alias("dst"), "file", F.col("name").alias("_name"))
    return a.join(b, "file").filter((F.col("src") != F.col("dst")) & (F.col("_name") != "") & F.contains("_text", F.col("_name"))).select("src", "dst", F.lit("calls").alias("label"))


def language_aware_graph(nodes: DataFrame) -> DataFrame:
    """Edges of every language by its own rules, united."""
    out = None
    for language in ("dart", "typescript", "python", "rust", "generic"):
        own = nodes.filter(F.col("language") == language) if language != "generic" else nodes.filter(~F.col("language").isin("dart", "typescript", "python", "rust") | F.col("language").isNull())
        e = declares(own, language).unionByName(import_edges(own, language))
        if language in ("rust", "generic"):
            e = e.unionByName(same_file(own))
        out = e if out is None else out.unionByName(e)
    return out.unionByName(imports_via_export(out))


def neighbours(records: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, most: int = 24) -> DataFrame:
    """The most ``most`` neighbours of each record (id, node, kind, file, owner), ranked.

    Hop 0 are all edges at the node, in both directions; further hops follow declares edges, which every profile allows, from what a hop
    found. A neighbour counts where it is met first, through an allowed label. Ids of records and of nodes are unique.

    Files and owners are put to the edges, not to the pairs, so that a pair has its score where it is made, and pairs move once, to their
    record. A node with one declares edge leads back to where it was met from; only others are followed further."""
    prefix = F.regexp_extract("owner", r"^(.*:):", 1)
    roots = records.select(F.col("id").alias("rec"), F.col("node").alias("at"), profile(F.col("kind")).alias("_profile"), F.col("file").alias("_file"), prefix.alias("_prefix"))
    way = lambda at, nbr, back: F.struct(F.col(at).alias("at"), F.col(nbr).alias("nbr"), F.lit(back).alias("dir"))
    both = edges.select("label", F.explode(F.array(way("src", "dst", 0), way("dst", "src", 1))).alias("_w")).select("_w.at", "_w.nbr", "label", "_w.dir")
    may = F.lit(False)
    for name, labels in ALLOWED.items():
        may = may | ((F.col("_profile") == name) & F.col("label").isin(*labels))
    first = F.min(F.struct("dir", (-rank_of(LABEL_PRIORITY, F.col("label"))).alias("p"), "label"))
    # The pairs are grouped where they were joined: by node.
    known = roots.join(both, "at").filter((F.col("nbr") != F.col("at")) & may).groupBy("at", "rec", "nbr", "_file", "_prefix").agg(first["label"].alias("label"))
    known = known.select("rec", F.col("at").alias("_root"), F.col("nbr").alias("at"), "_file", "_prefix", "label")
    # Declares edges, each with the file and name of its end and whether that end has more of them: both are known of a
    # node where its edges lie, and the edges are there in both directions. A node itself is a step of none.
    info = nodes.select(F.col("id").alias("nbr"), F.col("file").alias("_nf"), "fqn", F.lit(True).alias("_there"))
    walk = both.filter("label = 'declares'").select(F.col("at").alias("nbr"), F.col("nbr").alias("at")).distinct()
    walk = walk.withColumn("more", F.count("*").over(W.partitionBy("nbr")) > 1).join(info, "nbr", "left")
    steps = walk.select("at", "nbr", "_nf", "fqn", "_there", "more", F.lit(1).alias("step"))
    itself = info.select(F.col("nbr").alias("at"), "nbr", "_nf", "fqn", "_there", F.lit(False).alias("more"), F.lit(0).alias("step"))
    near = F.when(F.col("_nf") == F.col("_file"), 2).otherwise(0) + F.when(F.col("fqn").startswith(F.col("_prefix")), 1).otherwise(0)
    label = F.when(F.col("step") == 0, F.col("label")).otherwise("declares")
    met = known.join(itself.unionByName(steps) if hops > 0 else itself, "at").filter(F.col("nbr") != F.col("_root")).withColumn("label", label)
    found, front = None, met.withColumnRenamed("step", "hop")
    for hop in range(1, hops + 1):
        found = front if found is None else found.unionByName(front)
        if hop == hops:
            break
        # Of what a hop met, once a record.
        going = front.filter((F.col("hop") == hop) & F.col("more")).select("rec", "_root", F.col("nbr").alias("at"), "_file", "_prefix", "label").distinct()
        front = going.join(steps.drop("step"), "at").filter(F.col("nbr") != F.col("_root")).withColumn("hop", F.lit(hop + 1))
    found = front if found is None else found
    score = F.greatest(rank_of(LABEL_PRIORITY, F.col("label")) + near - F.col("hop"), F.lit(0))
    pairs = found.filter("_there").select("rec", "nbr", "hop", "label", score.alias("score"), "fqn").repartition("rec")
    # The first meeting counts; what one record meets lies together.
    best = F.min(F.struct("hop", "label", "score"))
    ranked = pairs.groupBy("rec", "nbr").agg(best.alias("_b"), F.min_by("fqn", "hop").alias("fqn")).select("rec", "nbr", "_b.label", "_b.hop", "_b.score", "fqn")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("rec").orderBy(F.desc("score"), "hop", "nbr")))
    return ranked.filter(F.col("rank") <= most).select("rec", "nbr", "label", "hop", "score", "rank", "fqn")


def children_and_parent(chunks: DataFrame) -> DataFrame:
    """chunks (id, file, symbol_path): parent_id by path, and how many children name the chunk as theirs."""
    from codestrata.functions.text import parent_path

    c = chunks.withColumn("_parent", parent_path(F.col("symbol_path")))
    p = chunks.groupBy("file", F.col("symbol_path").alias("_parent")).agg(F.min("id").alias("parent_id"))
    linked = c.join(p, ["file", "_parent"], "left").drop("_parent")
    kids = linked.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    return linked.join(kids, "id", "left").withColumn("children", F.coalesce("children", F.array().cast(kids.schema["children"].dataType)))


def ordinals(nodes: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """Ordinal 0 to N - 1 by ``order``, by ranges: counts of sorted ranges, then places within each."""
    spark = nodes.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").count()  # a row for each range
    starts = counts.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_start"))
    within = W.partitionBy("_part").orderBy(*order)
    return ranged.join(F.broadcast(starts), "_part").withColumn("ordinal", F.col("_start") + F.row_number().over(within) - 1).drop("_part", "_start")


def counts_by(df: DataFrame, c: str, name: str = "n", missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c)).agg(F.count("*").alias(name))
