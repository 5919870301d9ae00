"""Token ids in a content-addressed store.

Each text is encoded, an end id follows, and a rolling hash over ``WINDOW`` ids cuts the stream of each document into
chunks of about ``2 ** MASK_BITS`` ids, so that equal passages give equal chunks whatever stands before them. A chunk's
key is a SHA-256 (16 bytes) of its ids. A unique chunk is stored once, in the row of the least doc_id that has it; all other documents refer to
it by key. A document's recipe is its list of keys.

Layout of a store: ``rows`` (Parquet parts in ascending doc_id order; doc_id, part, page, offset, n_tokens, keys, lengths,
owned, payload, leaf) and ``manifest`` (a Merkle tree in three levels: a leaf hashes a recipe, a page hashes up to PAGE
leaves, a part its pages, the root all parts) and ``root``. Ids are little-endian, 2 bytes each where the vocabulary allows, else 4.
Reading fetches the chunks that other documents own, joins them in recipe order, checks every chunk's key and leaf
against what it rebuilt, and every page against the manifest.

Sorting and writing take one shuffle of the ids; reading shuffles only chunks that several documents share.

Defined cases: a null text is the empty one (only the end id); null ids come first; rows of a repeated id keep rows
of their own, one after the other; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import delete, new_folder, partitions, store, table

WINDOW, MASK_BITS, LEAST, MOST, PAGE, CACHE = 8, 8, 64, 1024, 512, 1_000_000
MARKS = ".,;:!?"
_GEAR = np.random.default_rng(20240501).integers(0, 2**63, 1 << 16, dtype=np.uint64)


class Encoder:
    """Encodes texts with a tokenizer, remembering the ids of pieces between blanks and line feeds.

    The tokenizer must not carry anything across those (its pre-tokenizer drops white space). Pieces that are not
    remembered are encoded many at a time, with an added token between them as separator."""

    def __init__(self, json_text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        parts = json.loads(json_text)
        self.lowers = '"Lowercase"' in json.dumps(parts.get("normalizer"))
        added = [(t["content"], t["id"]) for t in parts.get("added_tokens", ()) if not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"))]
        self.separator, self.separator_id = added[0] if added else (None, -1)
        self.added = [t["content"] for t in parts.get("added_tokens", ())]
        cuts = [[x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("ab" + m)] for m in MARKS] if self.tokenizer.pre_tokenizer else []
        #: Marks that the pre-tokenizer cuts off a word of ASCII letters; such a word needs no entry of its own to be learnt.
        self.marks = {m for m, c in zip(MARKS, cuts, strict=False) if c == ["ab", m]}
        suffix, self.word_ends = parts.get("model", {}).get("end_of_word_suffix"), None
        if suffix:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.word_ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.word_ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        #: What is remembered: word -> number; the numbers' ids are runs of one array.
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=self.dtype), 0
        self.begin, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember words whose ids follow one another in ``ids``, each up to its end."""
        n, base = len(words), len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        starts = np.concatenate([[0], ends[:-1]])
        self.begin[base : base + n], self.size[base : base + n] = starts + self.used, ends - starts
        self.used += len(ids)
        self.known.update(zip(words, range(base, base + n), strict=True))

    def _ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after the other, and how many each has."""
        size = self.size[number]
        return self.flat[np.repeat(self.begin[number] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    def _learn_all(self, new: list[str]) -> None:
        """Learn words, those of letters and one mark by way of their parts."""
        marked = [w for w in new if w[-1:] in self.marks and w.isascii() and w[:-1].isalpha()]
        if not marked:
            self._learn(new)
            return
        cores, tails = [w[:-1] for w in marked], [w[-1] for w in marked]
        self._learn(list(set(new).difference(marked) | ((set(cores) | set(tails)) - self.known.keys())))
        number = np.empty(2 * len(marked), dtype=np.int64)
        number[::2] = np.fromiter(map(self.known.__getitem__, cores), np.int64, len(cores))
        number[1::2] = np.fromiter(map(self.known.__getitem__, tails), np.int64, len(tails))
        ids, size = self._ids(number)
        self._add(marked, ids, np.cumsum(size)[1::2])

    def _learn(self, new: list[str]) -> None:
        """Learn words, many to a text: those of (Latin) letters parted where a token ends a word, others by a separator."""
        rest = new
        if self.word_ends is not None:
            letters = [w for w in new if w.isalpha() and max(w) < "\u0250"]
            rest = [w for w in new if not (w.isalpha() and max(w) < "\u0250")]
            rest += self._learn_lots(letters, " ", lambda ids: (np.flatnonzero(self.word_ends[ids]) + 1, ids))
        if self.separator:

            def parted(ids):
                cuts = np.flatnonzero(ids == self.separator_id)
                return np.concatenate([cuts - np.arange(len(cuts)), [len(ids) - len(cuts)]]), np.delete(ids, cuts)

            rest = self._learn_lots(rest, self.separator, parted)
        for w in rest:
            ids = self._whole(w)
            self._add([w], ids, np.array([len(ids)]))

    def _learn_lots(self, words: list[str], between: str, part) -> list[str]:
        """Encode 64 words to a text; gives back the words of texts that do not part into as many."""
        failed = []
        for lo in range(0, len(words), 64 * 256):
            lots = [words[k : k + 64] for k in range(lo, min(lo + 64 * 256, len(words)), 64)]
            good, ids, ends, at = [], [], [], 0
            for lot, e in zip(lots, self.tokenizer.encode_batch_fast([between.join(x) for x in lots], add_special_tokens=False), strict=True):
                z, own = part(np.array(e.ids, dtype=self.dtype))
                if len(z) != len(lot):
                    failed += lot
                    continue
                good += lot
                ids.append(own)
                ends.append(z + at)
                at += len(own)
            if good:
                self._add(good, np.concatenate(ids), np.concatenate(ends))
        return failed

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id last, and where each text's begin (and the last ends). Different words of the batch are looked up once each."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), dtype=bool)
        for a in self.added:  # texts that may hold an added token go to the tokenizer as they are
            whole |= pc.match_substring(texts, a, ignore_case=True).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts)
        if self.lowers:
            plain = pc.ascii_lower(plain)
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            if len(self.known) + len(new) > CACHE:
                self._forget()
                new = list(range(len(words)))
            self._learn_all([words[i] for i in new])
            number[new] = np.fromiter((self.known[words[i]] for i in new), np.int64, len(new))
        out, each = self._ids(number[at])
        edges = np.concatenate([[0], np.cumsum(each)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if whole.any():
            parts = [self._whole(texts[i].as_py()) if w else out[x:y] for i, (x, y, w) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), whole.tolist(), strict=True))]
            out, edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        # The end id behind each text.
        return np.insert(out, edges[1:], end), edges + np.arange(len(edges))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(json_text: str) -> Encoder:
    """The encoder of a worker process: what it remembers outlives a task."""
    key = hashlib.sha256(json_text.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(json_text)
    return _encoders[key]


def cuts(ids: np.ndarray, edges: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text: where the low bits of a rolling hash of the last WINDOW ids of the text are 0,
    within LEAST and MOST."""
    n = len(ids)
    place = np.arange(n) - np.repeat(edges[:-1], np.diff(edges))
    g, h = _GEAR[ids.astype(np.int64) & 0xFFFF], np.zeros(n, dtype=np.uint64)
    for k in range(min(WINDOW, n)):
        h[k:] += np.where(place[k:] >= k, g[: n - k] << np.uint64(k), np.uint64(0))
    marks = np.flatnonzero((h >> np.uint64(WINDOW)) & np.uint64((1 << MASK_BITS) - 1) == 0)
    own = np.searchsorted(marks, edges)
    ends = place[marks] + 1
    out = []
    for i in range(len(edges) - 1):
        size, at, found = int(edges[i + 1] - edges[i]), 0, []
        for m in chain(ends[own[i] : own[i + 1]].tolist(), [size]):
            while m - at > MOST:
                at += MOST
                found.append(at)
            if m - at >= LEAST or m == size and m > at:
                found.append(m)
                at = m
        out.append(found)
    return out


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    return cuts(ids, np.array([0, len(ids)]))[0]


def key_of(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:16]


def leaf_of(keys: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(keys)).digest()


def _release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and share their host with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _larger(batches, rows: int, most: int = 1 << 23):
    """Batches put together to about ``rows`` rows or ``most`` bytes: fewer different words to look up in all."""
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encoded(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed), keys, lengths."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a file of fixed size

    def run(batches):
        encode = encoder(vocabulary.value)
        for b in _larger(batches, 2000):
            texts = b.column("_text")
            for lo in range(0, len(texts), 2000):
                ids, edges = encode(texts.slice(lo, 2000), end)
                raw, width, packed, keys, lengths = ids.tobytes(), ids.dtype.itemsize, [], [], []
                for x, y, ends in zip(edges[:-1].tolist(), edges[1:].tolist(), cuts(ids, edges), strict=True):
                    starts = [0, *ends[:-1]]
                    packed.append(raw[x * width : y * width])
                    keys.append([key_of(raw[(x + a) * width : (x + z) * width]) for a, z in zip(starts, ends, strict=True)])
                    lengths.append([z - a for a, z in zip(starts, ends, strict=True)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(packed)), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32()))], names=["doc_id", "ids", "keys", "lengths"])
        _release()

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return df.mapInArrow(run, "doc_id long, ids binary, keys array<binary>, lengths array<int>")


ROW = "doc_id long, part int, page long, offset long, n_tokens long, width int, keys array<binary>, lengths array<int>, owned array<boolean>, shared array<boolean>, payload binary, leaf binary"


def _place(width: int):
    def run(batches):
        """Rows in doc_id order: before a document's own rows (kind 1) come the keys that it owns (kind 0)."""
        from pyspark import TaskContext

        part, offset, n, now, owned, seen = TaskContext.get().partitionId(), 0, 0, object(), {}, set()
        for b in batches:
            out = []
            for doc_id, kind, ids, keys, lengths, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "kind", "ids", "keys", "lengths", "own")), strict=True):
                if doc_id != now:
                    now, owned, seen = doc_id, {}, set()  # rows of one id own their chunks together: the first place stores one
                if kind == 0:
                    owned = {x["key"]: x["shared"] for x in own}
                    continue
                pieces, at, mine, many = [], 0, [], []
                for k, size in zip(keys, lengths, strict=True):
                    mine.append(k in owned and k not in seen)
                    many.append(owned.get(k, True))
                    if mine[-1]:
                        pieces.append(ids[at : at + size * width])
                        seen.add(k)
                    at += size * width
                total = at // width
                out.append((doc_id, part, n // PAGE, offset, total, width, keys, lengths, mine, many, b"".join(pieces), leaf_of(keys)))
                offset, n = offset + total, n + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in ROW.split(", ")])
        _release()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1, **columns: str) -> None:
    """Write the store of ``docs`` to ``path``."""
    spark = docs.sparkSession
    staged_path = new_folder(spark, "encoded")
    staged = store(encoded(docs, tokenizer, end, **columns), "encoded", staged_path)
    with open(tokenizer, encoding="utf-8") as f:
        width = Encoder(f.read()).dtype.itemsize
    refs = staged.select(F.col("doc_id"), F.explode("keys").alias("key"))
    owners = refs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("shared"))
    own = owners.groupBy("doc_id").agg(F.collect_list(F.struct("key", "shared")).alias("own"))
    empty = lambda kind: F.lit(None).cast(kind)
    rows = staged.select("doc_id", F.lit(1).alias("kind"), "ids", "keys", "lengths", empty("array<struct<key:binary,shared:boolean>>").alias("own"))
    rows = rows.union(own.select("doc_id", F.lit(0), empty("binary"), empty("array<binary>"), empty("array<int>"), "own"))
    placed = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "kind", F.xxhash64("keys")).mapInArrow(_place(width), ROW)
    placed.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    delete(spark, staged_path)
    pages = spark.read.schema(ROW).parquet(f"{path}/rows")
    tree = pages.groupBy("part", "page").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _page_hash().alias("hash"))
    tree.write.mode("overwrite").parquet(f"{path}/manifest")
    spark.range(1).select(F.lit(root(spark, path)).alias("root")).write.mode("overwrite").parquet(f"{path}/root")


def _page_hash():
    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "leaf"))), lambda x: F.hex(x["leaf"])), "")), 256))


def root(spark: SparkSession, path: str) -> str:
    """The root of the Merkle tree, in hexadecimal."""
    joined = lambda order: F.unhex(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "hash"))), lambda x: F.hex(x["hash"])), "")), 256))
    parts = spark.read.parquet(f"{path}/manifest").groupBy("part").agg(joined("page").alias("hash"))
    return parts.agg(F.hex(joined("part")).alias("r")).first()["r"].lower()


def check(spark: SparkSession, path: str) -> None:
    """Raise unless the stored leaves hash to the manifest's pages, with their counts, and these to the stored root."""
    if spark.read.parquet(f"{path}/root").first()["root"] != root(spark, path):
        raise ValueError("the manifest does not hash to the stored root")
    again = spark.read.schema(ROW).parquet(f"{path}/rows").groupBy("part", "page").agg(F.count("*").alias("_n"), F.sum("n_tokens").alias("_t"), _page_hash().alias("_again"))
    same = F.col("hash").eqNullSafe(F.col("_again")) & F.col("n_docs").eqNullSafe(F.col("_n")) & F.col("n_tokens").eqNullSafe(F.col("_t"))
    bad = spark.read.parquet(f"{path}/manifest").join(again, ["part", "page"], "full").filter(~same).first()
    if bad:
        raise ValueError(f"part {bad['part']}, page {bad['page']}: not as in the manifest")


READ = "doc_id long, part int, page long, offset long, n_tokens long, ids binary, leaf binary"


def _rebuild(batches):
    """Ids of each document from its own chunks and those fetched, in recipe order; every key is checked."""
    for b in batches:
        out = []
        for doc_id, part, page, offset, n, width, keys, lengths, owned, payload, leaf, fetched in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "page", "offset", "n_tokens", "width", "keys", "lengths", "owned", "payload", "leaf", "fetched")), strict=True):
            if leaf_of(keys) != leaf:
                raise ValueError(f"document {doc_id}: the recipe is damaged")
            got, at, pieces = {x["key"]: x["payload"] for x in fetched or ()}, 0, []
            for k, size, mine in zip(keys, lengths, owned, strict=True):
                if mine:
                    got[k] = payload[at : at + size * width]
                    at += size * width
                if k not in got or key_of(got[k]) != k:
                    raise ValueError(f"document {doc_id}: a chunk is missing or damaged")
                pieces.append(got[k])
            ids = b"".join(pieces)
            if len(ids) != n * width:
                raise ValueError(f"document {doc_id}: {len(ids) // width} ids, {n} expected")
            out.append((doc_id, part, page, offset, n, np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes(), leaf))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in READ.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, page, offset (ids before it in its part), n_tokens, ids (32-bit little-endian), leaf."""
    rows = spark.read.schema(ROW).parquet(f"{path}/rows")
    lacks = F.exists("owned", lambda x: ~x)
    whole = rows.filter(~lacks).withColumn("fetched", F.lit(None).cast("array<struct<key:binary,payload:binary>>"))
    part = rows.filter(lacks)
    # A key that a row needs from elsewhere: not owned there, and not by another place of the same row either.
    need = part.select("part", "offset", F.explode(F.array_distinct(F.transform(F.filter(F.arrays_zip("keys", "owned"), lambda x: ~x["owned"]), lambda x: x["keys"]))).alias("key"))
    have = rows.filter(F.exists(F.arrays_zip("owned", "shared"), lambda x: x["owned"] & x["shared"])).mapInArrow(_shared_chunks, "key binary, payload binary")
    fetched = need.join(have, "key").groupBy("part", "offset").agg(F.collect_list(F.struct("key", "payload")).alias("fetched"))
    return whole.unionByName(part.join(fetched, ["part", "offset"]).select(*whole.columns)).select("doc_id", "part", "page", "offset", "n_tokens", "width", "keys", "lengths", "owned", "payload", "leaf", "fetched").mapInArrow(_rebuild, READ)


def _shared_chunks(batches):
    for b in batches:
        keys_out, payloads = [], []
        for keys, lengths, owned, shared, width, payload in zip(*(b.column(c).to_pylist() for c in ("keys", "lengths", "owned", "shared", "width", "payload")), strict=True):
            at = 0
            for k, size, mine, many in zip(keys, lengths, owned, shared, strict=True):
                if mine:
                    if many:
                        keys_out.append(k)
                        payloads.append(payload[at : at + size * width])
                    at += size * width
        yield pa.RecordBatch.from_arrays([pa.array(keys_out, pa.binary()), pa.array(payloads, pa.binary())], names=["key", "payload"])


def verified(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole store), n_tokens, ids, of a store that has passed ``check``; each document's leaf is checked as it is rebuilt."""
    check(spark, path)
    manifest = spark.read.parquet(f"{path}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_t"))  # a row for each part file
    starts = parts.select("part", (F.sum("_t").over(W.orderBy("part")) - F.col("_t")).alias("_start"))
    return read(spark, path).join(F.broadcast(starts), "part").withColumn("start", F.col("_start") + F.col("offset"))


def damaged_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages whose rebuilt leaves do not hash to the manifest's value: none in a sound store."""
    again = read(spark, path).groupBy("part", "page").agg(_page_hash().alias("_again"), F.count("*").alias("_n"))
    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest.join(again, ["part", "page"], "full").filter(~F.col("hash").eqNullSafe(F.col("_again")) | ~F.col("n_docs").eqNullSafe(F.col("_n")))


def op4_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = new_folder(spark, "token-store")
    write(table(spark, sf_dir, "documents"), path, tokenizer)
    return verified(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
