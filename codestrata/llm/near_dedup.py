"""Near-duplicate documents by ProbMinHash signatures, banding, and exact verification.

Equal texts are put together first; each different text then has one signature. ProbMinHash lets every shingle (five
lower-case words) send Poisson arrivals at a rate of its weight to random registers, and stops a shingle as soon as its
next arrival is later than the latest register; equal registers estimate the probability Jaccard similarity of
weighted shingle sets. A shingle that a text holds n times weighs 1 + ln n (``weighting='log'``), n (``'count'``) or 1
(``'set'``). Links are verified by the Jaccard similarity of the sets, so a text that repeats a shingle has a second
signature with unit weights, lest weights hide a link; where nothing repeats the two are the same.

Bands of ``ROWS`` registers make buckets. A pair of similarity 0.8 shares none of the 32 buckets with a probability of
6e-5. Within a bucket, full signatures are compared and a spanning forest of pairs estimated at ``ESTIMATE`` (six
deviations under 0.8) is kept; the components of those forests are families, which hold every link among their members.
Within a family similarities are computed exactly from the shingles, by postings, and a spanning forest of the pairs at
or above the threshold is kept. Its components are the classes. No step writes more edges than it reads rows.

A bucket or family over ``BLOCK`` members is dealt to blocks, each of which also meets about ``LEADERS`` members in
common: as most are copies of one another, that alone ties most of them together, at a cost in proportion to their number.
Only members outside the group's largest component are then compared with all others, again block by block, so that no pair
that could still join two components is left out, nothing is capped and no task holds an unbounded group.

Defined cases: a null text is the empty one; texts of one to four words are one shingle; texts without words are only
copies of equal texts; a very long text is one set of shingles (a task holds it whole, 16 bytes a shingle). Rows are told
apart by id and text, so that rows of a repeated id belong to the classes of their texts. A class is named by its least
doc_id; where that is null, or names another class too, by the hash of its text. ``kept`` marks the class's row with the
least doc_id, then the least text hash (and whole repeats of that row). An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import Scratch, key_sieve, partitions, passes, spread_join, store, table
from codestrata.llm.graph import components
from codestrata.llm.words import STEP, WordHashes, grams, mix64

SHINGLE, BANDS, ROWS, ESTIMATE, BLOCK, BLOCK_SHINGLES, LEADERS = 5, 32, 6, 0.62, 256, 1_000_000, 16
REGISTERS = BANDS * ROWS


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    return np.unique(grams(hashes.of(words), min(SHINGLE, len(words))), return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def prob_min_hash(sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """The winning element of each register, for several sets at once: (sets, REGISTERS)."""
    m, n = REGISTERS, len(sets)
    times, winner = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    h, rate = np.concatenate(sets) if n else np.zeros(0, np.uint64), np.concatenate(weights).astype(float) if n else np.zeros(0)
    t, k = np.zeros(len(h)), 0
    while len(h):
        k += 1
        x = mix64(h + np.uint64(int(STEP) * 2 * k & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = of * m + (mix64(x ^ STEP) % np.uint64(m)).astype(np.int64)
        np.minimum.at(times, at, t)
        first = times[at] == t
        winner[at[first]] = h[first]
        on = t < times.reshape(n, m).max(axis=1)[of]  # its later arrivals come later still
        h, rate, t, of = h[on], rate[on], t[on], of[on]
    return winner.reshape(n, m)


def _bands(won: np.ndarray) -> np.ndarray:
    """A hash of the registers of each band."""
    key = mix64(won).reshape(len(won), BANDS, ROWS)
    bands = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(won), BANDS)).copy()
    for r in range(ROWS):
        bands = mix64(bands + STEP) ^ key[:, :, r]
    return bands.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """doc_id, text_key (md5), n (distinct shingles), bands (array of long; null without words), sig (a byte a register)
    and, of texts that repeat a shingle, unit (the signature with unit weights, whose bands are among the bands too)."""
    weight = {"set": lambda c: np.ones(len(c)), "log": lambda c: 1 + np.log(c), "count": lambda c: c}[weighting]

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            for lo in range(0, len(texts), 128):
                part = texts[lo : lo + 128]
                found = [shingles(t, hashes) for t in part]
                some = [i for i, (s, _) in enumerate(found) if len(s)]
                again = [i for i in some if weighting != "set" and found[i][1].max() > 1]
                sets = [found[i][0] for i in some + again]
                won = prob_min_hash(sets, [weight(found[i][1]) for i in some] + [np.ones(len(found[i][0])) for i in again])
                bands, sig = _bands(won).tolist(), (won & np.uint64(255)).astype(np.uint8)
                rows, sigs, units = [None] * len(part), [None] * len(part), [None] * len(part)
                for j, i in enumerate(some):
                    rows[i], sigs[i] = bands[j], sig[j].tobytes()
                for j, i in enumerate(again, len(some)):
                    rows[i], units[i] = list(set(rows[i] + bands[j])), sig[j].tobytes()
                ids, md5 = b.column("doc_id").slice(lo, len(part)), b.column("text_key").slice(lo, len(part))
                columns = [ids, md5, pa.array([len(s) for s, _ in found], pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(units, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "bands", "sig", "unit"])

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), _text(text_col))
    return df.mapInArrow(run, "doc_id long, text_key binary, n long, bands array<long>, sig binary, unit binary")


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")


def text_key(text_col: str):
    """What tells texts apart: the md5 of the text, null as the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def _groups(batches, columns: list[str]):
    """Rows of a partition sorted by (group, block, id), as lists of columns for each group and block, an id once."""
    rest = None

    def part(lo: int, hi: int):
        ids = rest.column("id").to_numpy()[lo:hi]
        own = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return [rest.column(c).slice(lo, hi - lo).take(pa.array(own)) for c in columns] if len(own) > 1 else None

    for b in batches:
        t = pa.Table.from_batches([b])
        rest = pa.concat_tables([rest, t]) if rest is not None and len(rest) else t
        keys = np.stack([rest.column(k).to_numpy() for k in ("group", "block")])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if not len(cut):
            continue
        ends = np.concatenate([[0], cut])
        # Groups of one row, the most by far where blocks are sparse, need no work.
        for at in np.flatnonzero(np.diff(ends) > 1).tolist():
            if found := part(int(ends[at]), int(ends[at + 1])):
                yield found
        rest = rest.slice(cut[-1])
    if rest is not None and len(rest) > 1 and (found := part(0, len(rest))):
        yield found


class Forest:
    """Labels of the components of what has been linked so far."""

    def __init__(self, known: np.ndarray):
        self.label = np.unique(known, return_index=True, return_inverse=True)[1:]
        self.label = self.label[0][self.label[1]]

    def link(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True

    def others(self, i: int) -> np.ndarray:
        """Those behind i that are not linked with it."""
        return np.flatnonzero(self.label[i + 1 :] != self.label[i]) + i + 1


def _edges(out: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([float(x[2]) for x in out], pa.float64())], names=["u", "v", "similarity"])


_EDGE = "u long, v long, similarity double"


def _estimated(batches):
    """Spanning forests of the pairs of a block that signatures put at ESTIMATE or more."""
    for ids, label, sig, unit in _groups(batches, ["id", "label", "sig", "unit"]):
        ids, sig = ids.to_numpy(), sig.to_pylist()
        s = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(ids), REGISTERS)
        u = np.frombuffer(b"".join(x or y for x, y in zip(unit.to_pylist(), sig, strict=True)), dtype=np.uint8).reshape(len(ids), REGISTERS)
        out, forest = [], Forest(label.to_numpy())
        for i in range(len(ids) - 1):
            other = forest.others(i)
            if len(other):
                alike = np.maximum((s[other] == s[i]).sum(axis=1), (u[other] == u[i]).sum(axis=1)) / REGISTERS
                out += [(int(ids[i]), int(ids[j]), a) for j, a in zip(other.tolist(), alike.tolist(), strict=True) if a >= ESTIMATE and forest.link(i, j)]
        if out:
            yield _edges(out)


def _exact(threshold: float):
    def run(batches):
        """Spanning forests of the pairs of a block whose shingle sets have the similarity, by postings."""
        for ids, label, packed in _groups(batches, ["id", "label", "shingles"]):
            ids, sets = ids.to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in packed.to_pylist()]
            sizes = np.array([len(x) for x in sets])
            every, code = np.unique(np.concatenate(sets), return_inverse=True)
            who = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(code, kind="stable")
            posted, begin = who[order], np.searchsorted(code[order], np.arange(len(every) + 1))
            ends, out, forest = np.cumsum(sizes), [], Forest(label.to_numpy())
            for i in range(len(sets) - 1):
                if not len(forest.others(i)):
                    continue
                common = np.zeros(len(sets), dtype=np.int64)
                c = code[ends[i] - sizes[i] : ends[i]]
                for lo in range(0, len(c), 4096):
                    p = np.concatenate([posted[begin[x] : begin[x + 1]] for x in c[lo : lo + 4096]])
                    common += np.bincount(p, minlength=len(sets))
                with np.errstate(divide="ignore", invalid="ignore"):
                    alike = common / (sizes + sizes[i] - common)
                near = np.flatnonzero((common > 0) & (alike >= threshold - 1e-12))
                out += [(int(ids[i]), int(ids[j]), alike[j]) for j in near.tolist() if j > i and forest.link(i, j)]
            if out:
                yield _edges(out)

    return run


def linked(placed: DataFrame, sizes: DataFrame, run, scratch: Scratch) -> DataFrame:
    """(id, component) of the members of each group that edges tie which ``run`` finds among them.

    placed: group, id, what run needs, and of its group _n (members) and _size (the same, or more where they are large:
    a block holds a size of about BLOCK); sizes: group, _n, _size."""
    n = partitions(placed.sparkSession)
    payload = [c for c in placed.columns if c not in ("group", "id", "_n", "_size")]

    def solve(rows: DataFrame) -> DataFrame:
        return rows.select("group", "block", "id", "label", *payload).repartition(n, "group", "block").sortWithinPartitions("group", "block", "id").mapInArrow(run, _EDGE)

    parts = F.ceil(F.col("_size") / BLOCK).cast("long")
    part = lambda of: F.pmod(F.xxhash64("id"), of)
    first = lambda of: F.sequence(F.lit(0).cast("long"), of - 1)
    leader = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.ceil(F.col("_n") / LEADERS).cast("long"), F.lit(1).cast("long"))) == 0
    dealt = placed.withColumn("label", F.col("id")).withColumn("block", F.explode(F.when((parts > 1) & leader, first(parts)).otherwise(F.array(part(parts)))))
    edges = scratch.store(solve(dealt), "forest")
    large = placed.filter(parts > 1)
    if not sizes.filter(F.col("_size") > BLOCK).head(1):
        return components(edges)
    # Members outside the largest component of a large group meet all of its members.
    tied = components(edges)
    large = scratch.store(large.join(tied, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), "large")
    per = large.groupBy("group", "label").agg(F.count("*").alias("_c"))
    most = per.groupBy("group").agg(F.max(F.struct("_c", "label")).alias("_m"), F.sum("_c").alias("_n")).select("group", "_n", F.col("_m.label").alias("_most"), (F.col("_n") - F.col("_m._c")).alias("_rest"))
    most = scratch.store(most.filter("_rest > 0"), "rest")
    if not most.head(1):
        return tied
    other = spread_join(large.drop("_n"), most, ["group"], "_n", ["id"])
    # The rest is as heavy as its share of the group. Blocks four times as large make a quarter of the copies.
    slices = F.greatest(F.ceil(F.col("_rest") * F.col("_size") / F.col("_n") / (4 * BLOCK)).cast("long"), F.lit(1).cast("long"))
    parts = F.ceil(F.col("_size") / (4 * BLOCK)).cast("long")
    is_rest = F.col("label") != F.col("_most")
    cross = lambda a, b: F.xxhash64(a, b)
    own = other.withColumn("_b", F.explode(first(slices))).withColumn("block", cross(part(parts), F.col("_b")))
    outside = other.filter(is_rest).withColumn("_a", F.explode(first(parts))).withColumn("block", cross(F.col("_a"), part(slices)))
    more = scratch.store(solve(own.select("group", "block", "id", "label", *payload).union(outside.select("group", "block", "id", "label", *payload))), "forest-rest")
    return components(tied.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more.select("u", "v"))) if more.head(1) else tied


def _family_shingles(docs: DataFrame, families: DataFrame, text_col: str) -> DataFrame:
    """(group, id, shingles) of the texts of families (text_key, id, group), one row for a text."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(key_sieve(families, F.xxhash64("text_key")))

    def run(batches):
        hashes, sieve, seen = WordHashes(), bits.value, set()
        for b in batches:
            keep = np.flatnonzero(passes(sieve, b.column("h").to_numpy()))
            part = b.take(pa.array(keep))
            for lo in range(0, len(part), 512):
                p = part.slice(lo, 512)
                texts = [(k, t) for k, t in zip(p.column("text_key").to_pylist(), p.column("_text").to_pylist(), strict=True) if k not in seen and not seen.add(k)]
                if len(seen) > 100_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts], pa.binary()), pa.array([shingles(t, hashes)[0].tobytes() for _, t in texts], pa.binary())], names=["text_key", "shingles"])

    key = text_key(text_col)
    got = docs.select(key.alias("text_key"), F.xxhash64(key).alias("h"), _text(text_col)).mapInArrow(run, "text_key binary, shingles binary")
    # Copies are put together before they move: a text that a third of all rows hold is a row of each task.
    return got.groupBy("text_key").agg(F.first("shingles").alias("shingles")).join(families, "text_key").select("group", "id", "shingles")


def classes(docs: DataFrame, threshold: float = 0.8, weighting: str = "log", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, class_id, kept, text_copies (rows with an equal text), for every row of docs."""
    spark = docs.sparkSession
    signed = store(signatures(docs, id_col, text_col, weighting), "signatures")
    scratch = Scratch(spark, "near-dedup")
    texts = signed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("text_copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("unit").alias("unit"))
    texts = scratch.store(texts.withColumn("id", F.monotonically_increasing_id()), "texts")  # numbers hold once they are written
    rows = texts.filter("bands is not null").select("id", F.explode("bands").alias("group"))
    buckets = scratch.store(rows.groupBy("group").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_size", F.col("_n")), "buckets")
    members = spread_join(rows, buckets, ["group"], "_n", ["id"]).join(texts.select("id", "sig", "unit"), "id")
    near = linked(members, buckets, _estimated, scratch)
    families = near.select("id", F.col("component").alias("group"))
    families = scratch.store(texts.select("id", "text_key").join(families, "id"), "families")
    classed = texts.select("text_key", "id", "doc_id", "text_copies")
    if families.head(1):
        packed = scratch.store(_family_shingles(docs, families, text_col), "shingles")
        size = F.greatest(F.count("*"), F.ceil(F.sum(F.length("shingles") / 8) * BLOCK / F.lit(BLOCK_SHINGLES)))
        sizes = scratch.store(packed.groupBy("group").agg(F.count("*").alias("_n"), size.cast("long").alias("_size")).filter("_n > 1"), "sizes")
        exact = linked(spread_join(packed, sizes, ["group"], "_n", ["id"]), sizes, _exact(threshold), scratch)
        classed = classed.join(exact, "id", "left").withColumn("class", F.coalesce("component", "id"))
    else:
        classed = classed.withColumn("class", F.col("id"))
    classed = scratch.store(classed.select("text_key", "doc_id", "text_copies", "class"), "classed")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    heads = scratch.store(classed.groupBy("class").agg(F.min(least).alias("k"), F.count("*").alias("_n")), "heads")
    # A least id names one class: that of the least text hash.
    twice = heads.groupBy(F.col("k.doc_id").alias("_id")).agg(F.count("*").alias("_c"), F.min("k.text_key").alias("_first")).filter("_c > 1 and _id is not null")
    named = heads.join(twice, F.col("k.doc_id") == F.col("_id"), "left").withColumn("class_id", F.when(F.col("_first").isNull() | (F.col("_first") == F.col("k.text_key")), F.col("k.doc_id")))
    named = named.select("class", "_n", F.coalesce("class_id", F.xxhash64("k.text_key")).alias("class_id"), F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    by_text = spread_join(classed.select("text_key", "text_copies", "class"), named, ["class"], "_n", ["text_key"])
    by_text = store(by_text.select("text_key", "text_copies", "class_id", "_id", (F.col("text_key") == F.col("_key")).alias("_head")), "classes")
    scratch.clear()
    out = spread_join(signed.select("doc_id", "text_key"), by_text, ["text_key"], "text_copies", ["doc_id"])
    return out.select("doc_id", "text_key", "class_id", (F.col("_head") & F.col("doc_id").eqNullSafe(F.col("_id"))).alias("kept"), "text_copies")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "text_copies")
