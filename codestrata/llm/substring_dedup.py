"""Exact substring deduplication by a common-prefix interval tree over suffix arrays of repeat candidates.

A string of ``length`` bytes is repeated if it starts at another place too. Every window of that length is assigned to
one anchor: the place of the least hash among its 32-byte grams. Equal windows have equal anchors, so the places that
share an anchor's hash are the only ones that can repeat each other, and neighbouring windows of one anchor form one
context (on average 285 bytes). Contexts that occur twice or more, byte for byte, are repeated throughout: they are
grouped by 128 bits of hash before any text moves. What is left are contexts that share an anchor but differ, at the
edges of repeats. Those, and one of each repeated context that shares their anchor, go to suffix arrays: suffixes are
ranked by prefix doubling, adjacent common-prefix lengths give an interval tree by a stack scan, and intervals of at least
``length`` whose occurrences differ on their left (or begin a context) are maximal repeat groups. A group is a depth and
a range of the suffix array, so that groups and places together are linear in the text; ``occurrences`` writes a group out.
For the spans, each place needs the deepest group that holds it only, and the places of a context make one span, as
they begin less than ``length`` apart. The union of spans covers every repeated window.

An anchor with more than ``MOST`` different contexts is split exactly: its windows are dealt to four ranges, each keyed
by the hash of the bytes that all windows of the range contain, and equal pieces are grouped again, down to
single windows. No group is capped, gathered on the driver or held whole by one task.

Contexts that very many places hold are dealt over several tasks (``common.spread_join``).

Defined cases: a null text is the empty one; texts under ``length`` bytes keep all; a very long text is cut to contexts
like any other (its grams and their hashes are held by one task: about 40 bytes a byte of text); rows are told apart by
id and text, so that repeated rows repeat each other like copies; ties between equal gram hashes go to the leftmost; an
empty table gives an empty result; other columns are not read. ``length`` has to be ``GRAM`` + 8 at least.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import Scratch, key_sieve, partitions, passes, spread_join, store, table, utf8
from codestrata.llm.words import mix64

LENGTH, GRAM, MOST, BATCH = 200, 32, 1024, 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _eights(data: bytes) -> np.ndarray:
    """The unsigned 64-bit number at every byte."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's gram, first window, last window) of each anchor: the leftmost least gram of its windows."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _eights(data)
    m = n - GRAM + 1
    h = mix64(x[:m] * _ODD[0] + x[8 : m + 8] * _ODD[1] + x[16 : m + 16] * _ODD[2] + x[24 : m + 24] * _ODD[3])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return h[at[first]], first, last


def contexts(data: bytes, length: int = LENGTH):
    """(anchor hash, context hash, first window, windows) of each anchor."""
    h, first, last = anchors(data, length)
    view = memoryview(data)
    c = np.array([xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)
    return h, c, first, last - first + 1


@dataclass
class Repeats:
    """Maximal repeats: ``groups`` has rows (depth, from, to), the last included, over the suffix array whose places are
    ``text`` and ``place``; ``widest`` is the depth of the deepest group that holds each place, 0 for none."""

    text: np.ndarray
    place: np.ndarray
    groups: list[tuple[int, int, int]]
    widest: np.ndarray

    def occurrences(self, group: tuple[int, int, int]) -> list[tuple[int, int]]:
        """(text, place) of every occurrence of a group."""
        return list(zip(self.text[group[1] : group[2] + 1].tolist(), self.place[group[1] : group[2] + 1].tolist(), strict=True))


def repeat_groups(texts: list[bytes], windows: list[int], length: int = LENGTH) -> Repeats:
    """Maximal repeats of at least ``length`` among the texts; only places under ``windows`` of a text count.

    A text ends in a mark that sorts before every byte, so that a suffix cut short by its text's end comes first among
    those that begin alike and hides no longer common prefix of theirs."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = b"\0".join(texts) + bytes(1)
    total, most = len(data), int(sizes.max())
    symbols = np.zeros(total + 8, dtype=np.int64)
    symbols[:total] = np.frombuffer(data, dtype=np.uint8)
    symbols[:total] += 1
    symbols[begin + sizes] = 0
    # Seven symbols to the base 257 fit 63 bits.
    key = np.zeros(total, dtype=np.int64)
    for k in range(7):
        key = key * 257 + symbols[k : k + total]
    r = np.unique(key, return_inverse=True)[1].astype(np.int64)
    ranks, span = {7: r}, 7
    while 2 * span <= most:
        after = np.concatenate([r[span:], np.full(min(span, total), -1)])[:total] + 1
        r = np.unique(r * (total + 2) + after, return_inverse=True)[1].astype(np.int64)
        span *= 2
        ranks[span] = r
    text_of = np.repeat(np.arange(len(texts)), windows)
    starts = begin[text_of] + np.arange(len(text_of)) - np.repeat(np.cumsum(windows) - windows, windows)
    # The order of `span` symbols, then of the `span` that end where the longest text would: of all that any text holds.
    rest = max(0, most - span)
    later = np.where(starts + rest < total, r[np.minimum(starts + rest, total - 1)] + 1, 0)
    order = np.argsort(r[starts] * (total + 2) + later, kind="stable")
    sa, text_of = starts[order], text_of[order]
    limit = begin[text_of] + sizes[text_of] - sa
    # Common prefixes of neighbours in the array, by descending spans, then single symbols.
    a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(max(0, len(sa) - 1), dtype=np.int64)
    for span in sorted(ranks, reverse=True):
        inside = (a < total) & (b < total)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ranks[span][a[inside]] == ranks[span][b[inside]]
        a, b, lcp = a + span * same, b + span * same, lcp + span * same
    for _ in range(6):
        same = symbols[np.minimum(a, total)] == symbols[np.minimum(b, total)]
        same &= lcp % 7 < 6
        a, b, lcp = a + same, b + same, lcp + same
    lcp = np.minimum(lcp, np.minimum(limit[:-1], limit[1:]))
    found = Repeats(text_of, sa - begin[text_of], [], np.zeros(len(sa), dtype=np.int64))
    deep = lcp >= length
    if not deep.any():
        return found
    left = np.where(sa > begin[text_of], symbols[np.maximum(sa - 1, 0)], -1 - np.arange(len(sa)))  # a context's first place differs from all
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]).tolist()  # a range is diverse on its left if its ends differ in this
    edges = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # suffixes lo..hi share `length` bytes
        if changes[lo] == changes[hi]:
            continue  # one byte to the left the same places share more
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*lcp[lo:hi].tolist(), 0], lo):
            from_ = i
            while stack and stack[-1][0] > depth:
                d, from_ = stack.pop()
                if d >= length and changes[from_] != changes[i]:
                    found.groups.append((d, from_, i))
            if not stack or stack[-1][0] < depth:
                stack.append((depth, from_))
    for d, from_, to in reversed(found.groups):  # outer groups come after inner ones
        found.widest[from_ : to + 1] = d
    return found


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, body: the id and the text's hash tell rows apart."""
    body = utf8(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("body"))


def _scan(length: int):
    def run(batches):
        for b in batches:
            ids, keys, parts = [], [], []
            for i, (d, k, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("body").to_pylist(), strict=True)):
                p = contexts(t, length)
                parts.append(p)
                ids += [d] * len(p[0])
                keys += [k] * len(p[0])
                if len(ids) > 200_000 or i == b.num_rows - 1:
                    h, c, a, w = (np.concatenate([p[j] for p in parts]) for j in range(4))
                    arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(w.astype(np.int16))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "h", "c", "first", "windows"])
                    ids, keys, parts = [], [], []

    return run


def _fetch(sieve, length: int):
    def run(batches):
        """The contexts whose anchors the sieve lets through, with their bytes."""
        for b in batches:
            out = []
            for d, k, t in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("body").to_pylist(), strict=True):
                h, first, last = anchors(t, length)
                for i in np.flatnonzero(passes(sieve.value, h)).tolist() if len(h) else ():
                    bytes_ = t[first[i] : last[i] + length]
                    out.append((d, k, int(h[i : i + 1].view(np.int64)[0]), np.uint64(xxhash.xxh3_64_intdigest(bytes_)).astype(np.int64), int(first[i]), int(last[i] - first[i] + 1), bytes_))
                if len(out) > 20_000:
                    yield _context_batch(out)
                    out = []
            yield _context_batch(out)

    return run


_CONTEXT = "doc_id long, text_key long, h long, c long, first int, windows int, bytes binary"


def _context_batch(rows):
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _CONTEXT.split(", ")])


_SPAN = "doc_id long, text_key long, lo int, hi int"


def _arrays(length: int):
    def run(batches):
        """Suffix arrays over whole groups of an anchor, several groups to an array."""

        def solve(groups):
            """A span for each context found once that shares something: its places begin less than `length` apart."""
            out = []
            rows = [r for g in groups for r in g]
            if len(rows) > 1:
                got = repeat_groups([r["bytes"] for r in rows], [r["windows"] for r in rows], length)
                own = np.flatnonzero(got.widest)
                lo, hi = np.full(len(rows), 1 << 62), np.zeros(len(rows), dtype=np.int64)
                np.minimum.at(lo, got.text[own], got.place[own])
                np.maximum.at(hi, got.text[own], got.place[own] + got.widest[own])
                for t in np.flatnonzero(hi).tolist():
                    r = rows[t]
                    if r["alone"]:
                        out.append((r["doc_id"], r["text_key"], r["first"] + int(lo[t]), r["first"] + int(hi[t])))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "text_key", "lo", "hi"])

        groups, now, size = [], None, 0
        for b in batches:
            for r in b.to_pylist():
                if r["h"] != now:
                    if size > BATCH:
                        yield solve(groups)
                        groups, size = [], 0
                    now = r["h"]
                    groups.append([])
                groups[-1].append(r)
                size += len(r["bytes"])
        yield solve(groups)

    return run


def _gram(text: bytes, length: int) -> int:
    """Where a context's anchor lies in it: its first window has the anchor's gram as its leftmost least."""
    x = _eights(text)
    m = min(len(text), length) - GRAM + 1
    h = mix64(x[:m] * _ODD[0] + x[8 : m + 8] * _ODD[1] + x[16 : m + 16] * _ODD[2] + x[24 : m + 24] * _ODD[3])
    return int(((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)).min() & np.uint64(0xFFFFFFFF))


def _split(length: int):
    def run(batches):
        """Contexts cut to four ranges of their windows; the new anchor is the hash of what all windows of a range hold.

        Ranges lie on a grid that is fixed to the anchor's gram, so that equal windows fall to equal ranges."""
        for b in batches:
            out = []
            for r in b.to_pylist():
                # `grid`: windows by their distance before the gram, in [lo, lo + width)
                width, lo, gram = (r["width"], r["grid"], r["gram"]) if "gram" in r else (length - GRAM + 1, 0, _gram(r["bytes"], length))
                step = -(-width // 4)
                for g in range(lo, lo + width, step):
                    top = min(g + step, lo + width) - 1  # distances g..top; a window at distance d starts d before the gram
                    a, z = max(0, gram - top), min(r["windows"] - 1, gram - g)
                    if a > z:
                        continue
                    core = r["bytes"][gram - g : gram - top + length]
                    piece = r["bytes"][a : z + length]
                    key = np.uint64(xxhash.xxh3_64_intdigest(core, seed=g << 20 | top)).astype(np.int64)
                    c = np.uint64(xxhash.xxh3_64_intdigest(piece)).astype(np.int64)
                    out.append((r["doc_id"], r["text_key"], int(key), int(c), r["first"] + a, z - a + 1, piece, gram - a, g, top - g + 1, r["n"]))
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] + [pa.int32()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in f"{_CONTEXT}, {_GRID}, n long".split(", ")])

    return run


_GRID = "gram int, grid int, width int"


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, Scratch]:
    """doc_id, text_key, lo, hi: byte ranges that repeats cover, for ``keyed`` documents; ranges may overlap. The
    tables that they are made from can be cleared once they have been read."""
    if length < GRAM + 8:
        raise ValueError(f"length {length} is under {GRAM + 8}")
    spark = docs.sparkSession
    n = partitions(spark)
    scratch = Scratch(spark, "substrings")
    store = scratch.store
    found = store(docs.mapInArrow(_scan(length), "doc_id long, text_key long, h long, c long, first int, windows short"), "anchors")
    cells = found.groupBy("h", "c").agg(F.count("*").alias("n"))
    per_anchor = cells.groupBy("h").agg(F.count("*").alias("different"), F.sum("n").alias("places"))
    cells = store(cells.join(per_anchor.filter("places > 1"), "h"), "cells")
    # Contexts that occur twice: every window of theirs is repeated.
    twice = spread_join(found, cells.filter("n > 1").select("h", "c", "n"), ["h", "c"], "n", ["doc_id", "text_key", "first"])
    whole = twice.select("doc_id", "text_key", F.col("first").alias("lo"), (F.col("first") + F.col("windows") + F.lit(length - 1)).cast("int").alias("hi"))
    # The rest: anchors with different contexts, one of them at least found once.
    mixed = cells.filter("different > 1")
    sieve = spark.sparkContext.broadcast(key_sieve(mixed, F.col("h")))
    # One of each context before any join: a context that a third of all rows hold is a row of each task, not a hot key.
    one = F.min_by(F.struct("doc_id", "text_key", "first", "windows", "bytes"), F.struct("doc_id", "text_key", "first"))
    got = docs.mapInArrow(_fetch(sieve, length), _CONTEXT).groupBy("h", "c").agg(one.alias("r"))
    got = got.join(mixed.select("h", "c", "n", "different"), ["h", "c"]).select("h", "c", "n", "different", "r.*")
    got = store(got, "contexts")
    spans = [whole]
    small = got.filter(F.col("different") <= MOST)
    solve = lambda rows: rows.withColumn("alone", F.col("n") == 1).repartition(n, "h").sortWithinPartitions("h", "c").mapInArrow(_arrays(length), _SPAN)
    spans.append(solve(small))
    large = got.filter(F.col("different") > MOST)
    if large.head(1):
        columns = [x.split()[0] for x in f"{_CONTEXT}, {_GRID}, n long".split(", ")]
        level = large.drop("different")
        while True:  # a quarter of the windows at each level: at most log4(length) levels
            pieces = store(level.mapInArrow(_split(length), f"{_CONTEXT}, {_GRID}, n long"), "pieces")
            cells2 = pieces.groupBy("h", "c").agg(F.sum("n").alias("total"))
            per = cells2.groupBy("h").agg(F.count("*").alias("different"), F.sum("total").alias("places")).filter("places > 1")
            cells2 = store(cells2.join(per, "h"), "piece-cells")
            spans.append(
                pieces.filter("n = 1").join(cells2.filter("total > 1").select("h", "c"), ["h", "c"])
                .select("doc_id", "text_key", F.col("first").alias("lo"), (F.col("first") + F.col("windows") + F.lit(length - 1)).cast("int").alias("hi"))
            )
            parts = F.struct(*[x for x in columns if x not in ("h", "c", "n")])
            rows = pieces.groupBy("h", "c").agg(F.min_by(parts, F.struct("doc_id", "text_key", "first")).alias("r"))
            rows = rows.join(cells2.filter("different > 1").select("h", "c", F.col("total").alias("n"), "different"), ["h", "c"])
            rest = store(rows.select("h", "c", "n", "different", "r.*"), "pieces-left")
            spans.append(solve(rest.filter(F.col("different") <= MOST).drop("gram", "grid", "width")))
            level = rest.filter((F.col("different") > MOST) & (F.col("width") > 1)).select(columns)
            if not level.head(1):
                break
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out, scratch


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(keep_bytes: bool, sieve=None):
    """Cut the spans out; with a sieve, only rows that it stops, which have none."""

    def run(batches):
        for b in batches:
            out = []
            if sieve is not None:
                b = b.filter(pa.array(~passes(sieve.value, b.column("text_key").to_numpy())))
            spans = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
            for d, t, s in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), spans, strict=True):
                gone = merged([(x["lo"], x["hi"]) for x in s or ()])
                edges = [0, *(e for g in gone for e in g), len(t)]
                kept = b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((d, len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _RESULT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True, **columns: str) -> DataFrame:
    """A row for each document: sizes, the digest of what is left and, with ``keep_bytes``, what is left."""
    spark = docs.sparkSession
    base = keyed(docs, **columns)
    found, scratch = repeated_spans(base, length)
    spans = store(found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.clear()
    sieve = spark.sparkContext.broadcast(key_sieve(spans, F.col("text_key")))

    def passing(batches):
        for b in batches:
            yield b.filter(pa.array(passes(sieve.value, b.column("text_key").to_numpy())))

    # Rows that no repeat touches stay where they are; the others meet their spans.
    untouched = base.mapInArrow(_cut(keep_bytes, sieve), _RESULT)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    joined = base.mapInArrow(passing, base.schema).join(spans.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "spans"), same, "left")
    return untouched.unionByName(joined.select("doc_id", "body", "spans").mapInArrow(_cut(keep_bytes), _RESULT))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")
