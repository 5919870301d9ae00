"""Benchmark decontamination: windows near a benchmark item in edit distance over words.

Items and texts are compared as lower-case runs of letters and digits. A window matches an item of L words if at most
``floor(rate * L)`` words have to be inserted, deleted or replaced (items under ``MIN_WORDS``: none).

CGK random walks turn edit distance into Hamming distance: a walk copies the word at its place and then goes on if a random
bit of (walk, step, word) says so, so that two walks over texts that differ fall into step again behind an edit. Bit sampling
reads a few coordinates of an embedding, and equal samples make a candidate. Here ``WALKS`` = 64 walks start at every word
of the corpus and of every item, and the coordinates 0, 2 and 4 are sampled; samples of three different places count. As walks
depend on the words alone, one pass serves the windows of items of all lengths, and the 64 repetitions are the bits of one
number. Wherever three words in a row are left unedited, a walk samples just those with a probability of 1/4, so all 64
miss with one of 1e-8; every match within the allowed edits has such a place, as ``floor(L / 5)`` edits leave a run of at least
3 of L >= 8 words. Each candidate is the item-sized window that puts the equal samples over each other.

Windows whose surroundings lack too many of the item's words are left out (none of these can match). An exact edit
distance between the item and the surroundings of the others decides; all occurrences that do not overlap are reported.

The scan keeps rows where they are: one pass, no shuffle. Items are broadcast in slices of about ``SLICE`` characters; a
larger benchmark takes several passes.

Defined cases: null texts and texts without words match nothing; items that are null or without words are left out;
repeated items and documents match as often as they stand there; a text shorter than the item is compared whole; a very
long text is scanned whole (8 bytes a word); of overlapping occurrences the nearest, then the first, is reported; an empty
table or benchmark gives no matches; other columns pass through, and one that has the result's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import packed, table
from codestrata.llm.words import M1, PLAIN, STEP, WordHashes, mix64

RATE, MIN_WORDS, WALKS, SLICE = 0.2, 8, 64, 1 << 22
MATCH = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32())])
MATCH_SQL = "array<struct<item_id:long,distance:int,item_words:int,start_word:int,end_word:int>>"
PAD = np.uint64(0)
NONE = np.zeros(0, dtype=np.uint64)
#: Stands between texts: no word hashes to it but by chance, and no item holds it.
GAP = np.uint64(0x6A09E667F3BCC909)
#: The different places that a walk can be at after two and after four steps, beside 0 at the start.
PLACES = ((1, 2), (1, 3), (2, 3), (2, 4))


def allowed(words: int, rate: float = RATE) -> int:
    return int(rate * words + 1e-9) if words >= MIN_WORDS else 0


def _step(k: int) -> np.uint64:
    return np.uint64(int(STEP) * k & 0xFFFFFFFFFFFFFFFF)


def keys(h: np.ndarray, n: int, a: int | None, b: int | None) -> np.ndarray:
    """A hash of the words at 0, a and b behind each of the first n places; None is past an item's end."""
    at = lambda k: h[k : k + n] if k is not None else np.full(1, PAD)
    return mix64(mix64(h[:n] + _step(1 + (a or 0) + 8 * (b or 0))) ^ at(a) * M1 ^ mix64(at(b) + STEP))


def walkers(h: np.ndarray, at: np.ndarray, a: int, b: int) -> np.ndarray:
    """The walks (a bit each) from places ``at`` of h that are a places on after two steps and b after four."""
    bits = lambda step, k: mix64(h[at + k] + _step(7 * step + 3))
    go = bits(0, 0)
    first = (~go & bits(1, 0)) | (go & ~bits(1, 1)) if a == 1 else go & bits(1, 1)
    on = bits(2, a)
    return first & (on & bits(3, a + 1) if b == a + 2 else (on & ~bits(3, a + 1)) | (~on & bits(3, a)))


@dataclass
class Items:
    """Items as word hashes, hashes of all pairs of an item and a word of its, allowed edits and numbers of words, and an
    index of their walks' samples (key, item, place, walks, sieve) by places."""

    ids: list[int]
    words: list[np.ndarray]
    pairs: np.ndarray
    limits: np.ndarray
    sizes: np.ndarray
    index: dict[tuple, tuple[np.ndarray, ...]]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], rate: float) -> Items:
        hashes, ids, words = WordHashes(), [], []
        for item_id, text in rows:
            h = hashes.of(PLAIN.findall((text or "").lower()))
            if len(h):
                ids.append(item_id)
                words.append(h)
        every = np.concatenate([*words, np.zeros(0, np.uint64)])
        size = np.array([len(h) for h in words], dtype=np.int64)
        item = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
        longer, index = np.concatenate([every, np.full(8, GAP)]), {}
        for a, b in PLACES:
            own = np.flatnonzero(place + b < size[item])
            index[a, b] = keys(longer, len(every), a, b)[own], item[own], place[own], walkers(longer, own, a, b)
        for short in (1, 2):  # the walks run past the end
            a = 1 if short == 2 else None
            own = np.flatnonzero((size[item] == short) & (place == 0))
            index[a, None] = keys(longer, len(every), a, None)[own], item[own], place[own], np.full(len(own), ~np.uint64(0))
        for k, found in index.items():
            order = np.argsort(found[0], kind="stable")
            width = max(16, (8 * len(order)).bit_length())
            sieve = np.zeros(1 << width, dtype=bool)
            sieve[(found[0] & np.uint64((1 << width) - 1)).astype(np.int64)] = True
            index[k] = (*(x[order] for x in found), sieve)
        pairs = np.unique(mix64(every ^ mix64(item.astype(np.uint64) + STEP)))
        return cls(ids, words, pairs, np.array([allowed(len(h), rate) for h in words], dtype=np.int64), size, index)


def seeds(h: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in h, item, where the item would start) of all equal samples; h ends in at least 8 gaps."""
    out = []
    for (a, b), (known, item, place, walks, sieve) in items.index.items():
        if not len(known):
            continue
        key = keys(h, len(h) - 8, a, b)
        at = np.flatnonzero(sieve[(key & np.uint64(len(sieve) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(known, key[at], "left"), np.searchsorted(known, key[at], "right")
        at, n, lo = at[hi > lo], (hi - lo)[hi > lo], lo[hi > lo]
        if not len(at):
            continue
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own = walkers(h, at, a, b) if b is not None else np.full(len(at), ~np.uint64(0))
        met = np.flatnonzero(np.repeat(own, n) & walks[entry])
        at, entry = np.repeat(at, n)[met], entry[met]
        out.append((at, item[entry], at - place[entry]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of text nearest to item in edit distance; the first end of the nearest."""
    n = len(text)
    cost, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    for i, w in enumerate(item, 1):
        diag = cost[:-1] + (text != w)
        up = cost[1:] + 1
        best = np.concatenate([[i], np.minimum(diag, up)])
        origin = np.concatenate([[0], np.where(diag <= up, start[:-1], start[1:])])
        # Insertions run from left to right: the least of best[k] + (j - k).
        shifted = best - np.arange(n + 1)
        low = np.minimum.accumulate(shifted)
        src = np.maximum.accumulate(np.where(shifted == low, np.arange(n + 1), 0))
        cost, start = low + np.arange(n + 1), origin[src]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def possible(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Which windows hold all but the allowed number of their item's words, within the allowed distance of them.

    at: where the item would start; lo, hi: where the window's text begins and ends."""
    d, size, out = items.limits[item], items.sizes[item], np.zeros(len(at), dtype=bool)
    begin, end = np.maximum(at - d, lo), np.minimum(at + size + 2 * d, hi)
    n = np.maximum(end - begin, 0)
    total = np.cumsum(n)
    first = 0
    while first < len(at):  # about a million words at a time
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + (1 << 20), "right")))
        m = n[first:last]
        own = np.repeat(np.arange(last - first), m)
        words = h[np.repeat(begin[first:last] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        key = mix64(words ^ mix64(item[first:last].astype(np.uint64) + STEP)[own])
        known = items.pairs[np.minimum(np.searchsorted(items.pairs, key), len(items.pairs) - 1)] == key
        out[first:last] = np.bincount(own[known], minlength=last - first) >= (size - d)[first:last]
        first = last
    return out


def occurrences(h: np.ndarray, item: int, starts: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(distance, start, end) of the item in a text, from the places (sorted) where seeds let it start."""
    words, d = items.words[item], int(items.limits[item])
    size, out = len(words), []
    for s in starts.tolist():
        if s >= 0 and np.array_equal(h[s : s + size], words):
            out.append((0, s, s + size))
    for _, s, _ in out:  # no other occurrence has a seed there that does not overlap this one
        starts = starts[(starts <= s - size + 2 * d) | (starts >= s + size - d)]
    while len(starts):
        # A match lies within d of its seeds' places: those of one match are at most 2 * d apart.
        together = int(np.searchsorted(starts, starts[0] + 2 * d, "right"))
        open_ = [(max(0, int(starts[0]) - d), min(len(h), int(starts[together - 1]) + size + 2 * d))]
        starts = starts[together:]
        while open_:
            a, z = open_.pop()
            cost, start, end = best_alignment(words, h[a:z])
            if cost <= d:
                out.append((cost, a + start, a + end))
                open_ += [(x, y) for x, y in ((a, a + start), (a + end, z)) if y - x >= max(1, size - d) and (x, y) != (a, z)]
    kept: list[tuple[int, int, int]] = []
    for m in sorted(set(out)):
        if all(m[2] <= k[1] or k[2] <= m[1] for k in kept):
            kept.append(m)
    return kept


def matches(texts: list[np.ndarray], items: Items) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text, given as word hashes, (item_id, distance, item words, start, end) of all occurrences of items."""
    found: list[list] = [[] for _ in texts]
    gap = np.full(8, GAP)
    size = np.array([len(t) + 8 for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    if not texts or not items.ids:
        return found
    h = np.concatenate([x for t in texts for x in (t, gap)])
    at, item, start = seeds(h, items)
    text = np.searchsorted(begin, at, "right") - 1
    order = np.lexsort((start, item, text))  # a window once, of however many samples
    text, item, start = text[order], item[order], start[order]
    once = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])])[: len(text)]
    text, item, start = text[once], item[once], start[once]
    good = possible(h, start, begin[text], begin[text] + size[text] - 8, item, items)
    text, item, start = text[good], item[good], start[good] - begin[text[good]]
    cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])).tolist() if len(text) else []
    for lo, hi in pairwise([*cut, len(text)]):
        t, i = int(text[lo]), int(item[lo])
        found[t] += [(items.ids[i], c, len(items.words[i]), s, e) for c, s, e in occurrences(texts[t], i, start[lo:hi], items)]
    return [sorted(f, key=lambda m: (m[0], m[3], m[1])) for f in found]


def mark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text", out_col: str = "matches") -> DataFrame:
    """``docs`` with an array of matches added, each row where it was."""
    spark, docs = docs.sparkSession, docs.drop(out_col)
    rows = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_col).alias("t")).filter("t is not null and i is not null")
    slices = max(1, -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // SLICE))
    out = docs.select(packed(docs), F.col(text_col).cast("string").alias("body"), F.array().cast(MATCH_SQL).alias("found"))
    for k in range(slices):
        part = rows.filter(F.pmod(F.xxhash64("i"), F.lit(slices)) == k).collect()  # about SLICE characters
        items = spark.sparkContext.broadcast(Items.of(sorted((r["i"], r["t"]) for r in part), rate))

        def run(batches, items=items):
            own, hashes = items.value, WordHashes()
            for b in batches:
                found = matches([hashes.of(PLAIN.findall(t.lower())) if t else NONE for t in b.column("body").to_pylist()], own)
                so_far = b.column("found").to_pylist()
                now = [(x or []) + [dict(zip((f.name for f in MATCH), m, strict=True)) for m in y] for x, y in zip(so_far, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("body"), pa.array(now, pa.list_(MATCH))], names=["row", "body", "found"])

        out = out.mapInArrow(run, out.schema)
    return out.select("row.*", F.col("found").alias(out_col))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.distance", "m.item_words", "m.start_word", "m.end_word", F.round(1 - F.col("m.distance") / F.col("m.item_words"), 6).alias("similarity"))
