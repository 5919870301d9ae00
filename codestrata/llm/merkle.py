"""Merkle manifest of a data set, built as an external-memory node store.

``build`` hashes each row to a leaf, sorts the leaves of each tree (a value of ``tree``; null is a tree too) into runs and
streams them to Parquet, one folder a level. Each level reads the one below in the order of its files: eight
consecutive nodes become their parent on the spot, and only groups that a split or the end of a tree cuts apart, at most two
for each split, are put together by a shuffle. The subroots of all trees, ordered by tree, are the leaves of one more tree.

``proofs`` and ``verified`` extract proofs by coordinate: nodes of STRATUM levels meet in blocks of 8^STRATUM leaves, sorted by
level and index, and one scan merges a block's levels. A block starts from the path of its own root, which the scan
of the stratum above gives; so no leaf is joined level by level, and no task holds more than a block.

Hashes are lower-case hexadecimal SHA-256; digests are hashed as that text. A row's leaf is the hash of its fields, each ``-``
if null, else the number of its UTF-8 bytes, ``:``, and the value. A path is ``left|right`` for each step, joined by commas.

Defined cases: a null order value comes first; leaves of equal order value ascend by their hash, and rows equal in all fields are
leaves of their own, whose places are interchangeable; a lone leaf is its tree's subroot, a lone subroot the root; empty and
very long texts are values like others; an empty table has no root and gives no rows; columns other than the fields are
not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import new_folder, partitions, store, table

FANOUT_BITS, STRATUM = 3, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass
class Forest:
    """Trees in the node store: ``leaves`` (tree, idx, digest, key, other), the nodes above by level, and each tree's root."""

    leaves: DataFrame
    roots: DataFrame  # tree, height, digest
    height: int
    levels: list[DataFrame] = field(default_factory=list)  # tree, idx, digest of level 1, 2, ...


@dataclass
class Manifest:
    """The trees, the tree over their subroots, and the root (None without rows)."""

    trees: Forest
    top: Forest | None
    root: str | None


def name_of(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def leaf_hash(values: list[Column]) -> Column:
    """The hash of a row's fields."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (c.cast("string") for c in values)]
    return F.sha2(F.concat(*parts), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _numbered(batches):
    """The run and, within it, the place of each row in its tree; rows come sorted by tree."""
    run, last, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        tree = b.column("tree")
        first = np.concatenate([[True], pc.not_equal(tree.slice(1), tree.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(first)
        at = np.arange(n) - starts[np.cumsum(first) - 1]
        if tree[0].as_py() == last:
            at[: starts[1] if len(starts) > 1 else n] += count
        last, count = tree[n - 1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, run, np.int32)), pa.array(at)], names=[*b.schema.names, "run", "at"])


def _ranked(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Sorted runs of ``rows`` as level 0 of the store, with ``idx``, each row's place in its tree."""
    by, spark = ["tree", *order], rows.sparkSession
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", run int, at long"
    runs = store(rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(_numbered, schema), "leaves", f"{path}/level=0")
    before = W.partitionBy("tree").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    # A tree that an earlier run began is the first of its run: at most one row for each run.
    begun = runs.groupBy("tree", "run").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before)).filter(F.col("before") > 0)
    return runs.join(F.broadcast(begun.select("tree", "run", "before")), ["tree", "run"], "left").withColumn("idx", F.col("at") + F.coalesce("before", F.lit(0))).drop("run", "at", "before")


_STAGED = "tree string, parent long, first long, n int, whole boolean, digest string"


def _parents(batches):
    """Consecutive children of one parent: all eight hashed, or fewer with their digests joined."""
    held = None
    for b in batches:
        b = pa.concat_batches([held, b]) if held is not None else b
        held = None
        n = b.num_rows
        if not n:
            continue
        tree, idx, digest = b.column("tree"), b.column("idx").to_numpy(), b.column("digest")
        parent = idx >> FANOUT_BITS
        cut = np.concatenate([[True], (parent[1:] != parent[:-1]) | (idx[1:] != idx[:-1] + 1) | pc.not_equal(tree.slice(1), tree.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(cut)
        if n - starts[-1] < 1 << FANOUT_BITS:
            held = b.slice(starts[-1])  # the next batch may go on
            n, starts = int(starts[-1]), starts[:-1]
        if len(starts):
            yield _staged(tree, parent, idx, "".join(digest.slice(0, n).to_pylist()), starts, n)
    if held is not None:
        yield _staged(held.column("tree"), held.column("idx").to_numpy() >> FANOUT_BITS, held.column("idx").to_numpy(), "".join(held.column("digest").to_pylist()), np.array([0]), held.num_rows)


def _staged(tree, parent, idx, joined: str, starts: np.ndarray, n: int) -> pa.RecordBatch:
    ends = np.append(starts[1:], n)
    whole = ends - starts == 1 << FANOUT_BITS
    text = [joined[64 * lo : 64 * hi] for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
    digest = [sha256(t.encode()).hexdigest() if w else t for t, w in zip(text, whole.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([tree.take(pa.array(starts)), pa.array(parent[starts]), pa.array(idx[starts]), pa.array((ends - starts).astype(np.int32)), pa.array(whole), pa.array(digest)], names=["tree", "parent", "first", "n", "whole", "digest"])


def _grown(leaves: DataFrame, path: str) -> Forest:
    """All levels above ``leaves``, each read from the one below."""
    most = leaves.agg(F.max("idx")).first()[0]
    height = 0
    while most is not None and most >> FANOUT_BITS * height:
        height += 1
    out, nodes, roots = Forest(leaves, None, height), leaves.select("tree", "idx", "digest"), []
    for level in range(height):
        staged = store(nodes.mapInArrow(_parents, _STAGED), "nodes", f"{path}/level={level + 1}")
        cut = staged.filter(~F.col("whole")).groupBy("tree", "parent").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "digest"))).alias("parts"))
        lone = (F.col("parent") == 0) & (F.col("n") == 1)
        roots.append(cut.filter(lone).select("tree", F.lit(level).alias("height"), F.col("parts")[0]["digest"].alias("digest")))
        mended = cut.filter(~lone).select("tree", F.col("parent").alias("idx"), F.sha2(F.array_join("parts.digest", ""), 256).alias("digest"))
        nodes = staged.filter("whole").select("tree", F.col("parent").alias("idx"), "digest").unionByName(mended)
        out.levels.append(nodes)
    # On the last level there are roots only.
    out.roots = reduce(DataFrame.unionByName, roots, nodes.select("tree", F.lit(height).alias("height"), "digest"))
    return out


def build(rows: DataFrame, fields: list[str] = FIELDS, tree: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None, path: str | None = None) -> Manifest:
    """The manifest of ``rows``. ``tampered`` gives columns other values in the rows ``where`` holds, for ``verified``."""
    path = path or new_folder(rows.sparkSession, "manifest")
    other = leaf_hash([(tampered or {}).get(c, name_of(c)) for c in fields])
    key = name_of(tree).cast("string")
    leaves = rows.select(
        F.when(key.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), key)).alias("tree"),  # null first, then bytewise
        name_of(order).alias("key"),
        leaf_hash([name_of(c) for c in fields]).alias("digest"),
        (F.when(where, other) if tampered and where is not None else F.lit(None).cast("string")).alias("other"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).alias("deal"),  # divides equal rows among runs
    )
    leaves = store(leaves, "hashed", f"{path}/hashed")  # before sorting, which samples its input: texts are read once
    trees = _grown(_ranked(leaves, ["key", "digest", "deal"], f"{path}/trees").drop("deal"), f"{path}/trees")
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.lit(None).cast("string").alias("other"))
    top = _grown(_ranked(subroots, ["key"], f"{path}/top"), f"{path}/top")
    root = (top.levels[-1] if top.levels else top.leaves).select("digest").first()
    return Manifest(trees, top, root[0]) if root else Manifest(trees, None, None)


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its path give."""
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def steps(path: str) -> list[tuple[str, str]]:
    return [tuple(s.split("|")) for s in path.split(",")] if path else []


def _joined(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{a}|{b}" for a, b in path)


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _merge(base: int, emit, kinds: list[pa.DataType], names: list[str], size: int = 2000):
    """A scan over blocks sorted by level: first the block's own path, then its levels from the top down, leaves last."""

    def run(batches):
        out = []
        for (tree, _), block in groupby(_rows(batches), key=lambda r: r[:2]):
            above, nodes, leaves = None, [{} for _ in range(STRATUM)], []
            for _, _, step, idx, digest, other, key, path, height in block:
                if step < 0:
                    above, subroot, tall = steps(path), digest, height
                else:
                    nodes[STRATUM - 1 - step][idx] = digest
                    if step == STRATUM - 1:
                        leaves.append((idx, digest, other, key))
            if above is None:  # a root, whose path the stratum below has
                continue
            known: dict[tuple[int, int], list[tuple[str, str]]] = {}

            def up(j, i, above=above, nodes=nodes, tall=tall, known=known):
                """The path of node i of the block's level j."""
                if j == STRATUM or base + j >= tall:
                    return above
                if (j, i) not in known:
                    start, level = i >> FANOUT_BITS << FANOUT_BITS, nodes[j]
                    side = lambda a, b: "".join(level[g] for g in range(a, b) if g in level)
                    known[j, i] = [(side(start, i), side(i + 1, start + (1 << FANOUT_BITS))), *up(j + 1, i >> FANOUT_BITS)]
                return known[j, i]

            for idx, digest, other, key in leaves:
                out.append(emit(tree, idx, digest, other, key, up(0, idx), subroot, tall))
            if len(out) >= size:
                yield _batch(out, kinds, names)
                out = []
        if out:
            yield _batch(out, kinds, names)

    return run


def _batch(rows: list[tuple], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _path(tree, idx, digest, other, key, path, subroot, height):
    return tree, key, idx, digest, _joined(path), subroot, height


def _digests(tree, idx, digest, other, key, path, subroot, height):
    proof = sha256("".join(a + b for a, b in path).encode()).hexdigest()
    return key, digest, subroot, proof, fold(other or digest, path)


def _scan(forest: Forest, above: DataFrame, emit, key_type: str) -> DataFrame:
    """Paths of all leaves. ``above``: tree, height, digest (of the root) and the path of each tree's root."""
    key_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type]
    none = lambda kind: F.lit(None).cast(kind)
    inner = ("tree string, key {0}, idx long, digest string, path string, subroot string, height int", [pa.string(), None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()])
    upper = None
    for base in range(max(forest.height - 1, 0) // STRATUM * STRATUM, -1, -STRATUM):
        low = base if base else -1
        context = above.filter((F.col("height") > low) & (F.col("height") <= base + STRATUM)).select("tree", F.lit(0).cast("long").alias("block"), F.col("digest"), "path", "height")
        if upper is not None:
            context = context.unionByName(upper.select("tree", F.col("idx").alias("block"), F.col("subroot").alias("digest"), "path", "height"))
        kind = "string" if base else key_type
        rows = context.select("tree", "block", F.lit(-1).alias("step"), F.lit(0).cast("long").alias("idx"), "digest", none("string").alias("other"), none(kind).alias("key"), "path", "height")
        for j in range(STRATUM):
            if base + j > forest.height:
                continue
            nodes = forest.leaves if base + j == 0 else forest.levels[base + j - 1]
            keyed = base + j == 0
            rows = rows.unionByName(nodes.select("tree", F.shiftright("idx", FANOUT_BITS * (STRATUM - j)).alias("block"), F.lit(STRATUM - 1 - j).alias("step"), "idx", "digest", (F.col("other") if keyed else none("string")).alias("other"), (F.col("key") if keyed else none(kind)).alias("key"), none("string").alias("path"), none("int").alias("height")))
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "step", "idx")
        if base == 0 and emit is _digests:
            return rows.mapInArrow(_merge(0, _digests, [key_arrow] + [pa.string()] * 4, ["key", "leaf", "subroot", "proof_sha256", "folded_root"]), f"key {key_type}, leaf string, subroot string, proof_sha256 string, folded_root string")
        kinds = [k or (pa.string() if base else key_arrow) for k in inner[1]]
        upper = rows.mapInArrow(_merge(base, _path, kinds, ["tree", "key", "idx", "digest", "path", "subroot", "height"]), inner[0].format(kind))
    return upper


def _above(manifest: Manifest) -> DataFrame:
    """The root of each tree with its path to the root of all."""
    top = manifest.top
    paths = _scan(top, top.roots.withColumn("path", F.lit("")), _path, "string")
    return manifest.trees.roots.join(paths.select(F.col("key").alias("tree"), "path"), "tree")


def proofs(manifest: Manifest) -> DataFrame:
    """tree, key, idx, digest, path, subroot, height for each leaf; ``fold(digest, steps(path))`` gives the root."""
    return _scan(manifest.trees, _above(manifest), _path, dict(manifest.trees.leaves.dtypes)["key"])


def verified(manifest: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, if any, and the stored siblings), verified."""
    kind = dict(manifest.trees.leaves.dtypes)["key"]
    if manifest.root is None:
        return manifest.trees.leaves.sparkSession.createDataFrame([], f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = _scan(manifest.trees, _above(manifest), _digests, kind)
    return out.select("key", "leaf", "subroot", F.lit(manifest.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == manifest.root).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    manifest = build(docs, tampered={"text": ascii_lower(F.col("text"))}, where=hit)
    return verified(manifest).withColumnRenamed("key", "doc_id")


ORACLE = {
    "op11_merkle_manifest": """
WITH RECURSIVE crc AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
row_of AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS told
  FROM crc),
leaf AS (
  SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(told) || ':' || told, '-')) AS told FROM row_of),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
node(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM ranked
  UNION ALL SELECT tree, level + 1, idx // 8, (min(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY tree, level, idx // 8),
sub AS (SELECT tree AS lang, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
top(level, idx, n, digest) AS (
  SELECT 0, idx, n, digest FROM sub
  UNION ALL SELECT level + 1, idx // 8, (min(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 8),
every AS (
  SELECT tree, level, idx, n, digest FROM node WHERE n > 1
  UNION ALL SELECT lang, 1000 + level, top.idx, top.n, top.digest FROM top, sub WHERE top.n > 1 AND top.idx // 8 = (sub.idx >> (3 * level)) // 8),
side AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 GROUP BY ALL),
path AS (
  SELECT ranked.rid, list({'l': side.l, 'r': side.r} ORDER BY level) AS path FROM ranked JOIN sub ON sub.lang = ranked.tree
    JOIN side ON side.tree = ranked.tree AND side.idx = CASE WHEN level < 1000 THEN ranked.idx >> (3 * level) ELSE sub.idx >> (3 * (level - 1000)) END
  GROUP BY ranked.rid),
done AS (
  SELECT doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    sha256(coalesce(list_reduce(list_prepend('', list_transform(path, lambda s: s.l || s.r)), lambda a, b: a || b), '')) AS proof_sha256,
    coalesce(list_reduce(list_prepend({'l': told, 'r': ''}, path), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l, told) AS folded_root
  FROM ranked JOIN sub ON sub.lang = ranked.tree LEFT JOIN path USING (rid))
SELECT *, folded_root = root AS verified FROM done"""
}
