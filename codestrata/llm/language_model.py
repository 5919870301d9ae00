"""Language-model scores from a bigram model kept in Elias-Fano tries.

Counting and scoring cut documents into chunks of about CHUNK tokens. Within a chunk equal pairs of words are put together
before anything moves; blobs of pairs then go to shards by ranges of the first word's hash. A shard of the
model is a trie: all words of the shard with exact counts, the number of different successors of each, and the
pairs found twice or more, with quantised values.

The model is absolute discounting by one: ``p(w | v) = (c(v w) - 1) / c(v) + n(v) / c(v) * p(w)``, with n(v) the
different successors of v, over the add-one unigram ``p(w) = (c(w) + 1) / (n + v + 1)`` of the exact counts. A pair found once
thus needs no entry. As ``log p`` of a stored pair is that of the unigram plus a term of the pair's own, each shard adds
up what it knows of each document, and the sums meet by chunk; texts and probabilities are never joined word by word. For
that term a shard has the counts of the successors it stores: it asks for each once, by ranges of the successors' hashes.

Tokens: runs of other than ASCII white space, A-Z lower-cased, then one end token. Defined cases: a null text is the
empty one and scores its end; words unknown in training have a count of 0; with no training
documents every token is unknown; rows of repeated ids are scored alike, row by row; a very long text is one chunk, held
whole by a task (about 100 bytes a word); words of equal frequency are taken as heavy in the order of their characters; an
empty table gives an empty result; columns other than those in ``keep`` and the text are not read.
The most frequent words' pairs are spread over all shards by their second word, all others' share their word's shard. A
shard holds what ``SHARD`` bytes of text give, up to ``MOST_SHARDS`` shards, from where on shards grow with the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.common import id_crc, partitions, store, table, utf8
from codestrata.llm.elias_fano import SUCCESSOR_BITS, Trie, pack, unpack
from codestrata.llm.words import WordHashes

CHUNK, MOST_DOCS = 1 << 20, 60_000
#: Bytes of text for each shard of the model, and shards at most (their number is that of the blobs of a chunk).
SHARD, MOST_SHARDS = 1 << 26, 1 << 14
#: Hashes of the marks at the ends of a text; words never hash from a text with white space.
_marks = WordHashes()
START, END = np.uint64(_marks["\n start"]), np.uint64(_marks["\n end"])
_FORTY = np.uint64((1 << SUCCESSOR_BITS) - 1)


def _small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, with those over 254 apart."""
    return [np.minimum(counts, 255).astype(np.uint8), counts[counts > 254].astype("<u4")]


def _counts(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def _five(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)


def _from_five(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x) // 5, 8), dtype=np.uint8)
    wide[:, :5] = x.reshape(-1, 5)
    return wide.reshape(-1).view("<u8")


def blobs(words: list[np.ndarray], shards: int, keep_docs: bool, heavy: np.ndarray):
    """(shard, blob) of a chunk: different first words, their different successors, and how often (or in which
    documents) each pair occurs. A heavy word's pairs go to shards by their successors."""
    size = np.array([len(w) + 1 for w in words])
    first, second = np.empty(int(size.sum()), np.uint64), np.empty(int(size.sum()), np.uint64)
    at = 0
    for w in words:
        n = len(w) + 1
        first[at], first[at + 1 : at + n], second[at : at + n - 1], second[at + n - 1] = START, w, w, END
        at += n
    second &= _FORTY
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    pairs = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    times, word, second = np.diff(np.concatenate([pairs, [len(first)]])), first[pairs], second[pairs]
    shard = (word >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    hot = np.isin(word, heavy)
    shard[hot] = second[hot] * np.uint64(shards) >> np.uint64(SUCCESSOR_BITS)
    by_shard = np.argsort(shard, kind="stable")  # within a shard the order by word and successor stays
    shard, word, second, times, pairs = shard[by_shard], word[by_shard], second[by_shard], times[by_shard], pairs[by_shard]
    ends = np.concatenate([[0], np.cumsum(times)])
    if keep_docs:
        docs = np.repeat(np.arange(len(words), dtype=np.uint16), size)[order]
        docs = docs[np.repeat(pairs - ends[:-1], times) + np.arange(ends[-1])]
    cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        heads = np.flatnonzero(np.concatenate([[True], word[a + 1 : z] != word[a : z - 1]]))
        different = np.diff(np.concatenate([heads, [z - a]]))
        parts = [word[a:z][heads], *_small(different), _five(second[a:z]), *_small(times[a:z])]
        yield int(shard[a]), pack(parts + ([docs[ends[a] : ends[z]]] if keep_docs else []))


def _chunks(batches, columns: list[str]):
    """Lists of (other columns, word hashes) of about CHUNK tokens."""
    hashes, rows, words, total = WordHashes(), [], [], 0
    for b in batches:
        other = list(zip(*(b.column(c).to_pylist() for c in columns), strict=True)) if columns else [()] * b.num_rows
        for o, t in zip(other, b.column("body").to_pylist(), strict=True):
            w = hashes.of(t.lower().split())  # bytes: A-Z only, ASCII white space only
            rows.append(o)
            words.append(w)
            total += len(w) + 1
            if total >= CHUNK or len(rows) >= MOST_DOCS:
                yield rows, words
                rows, words, total = [], [], 0
    if rows:
        yield rows, words


def _shard_rows(batches, columns: list[str]):
    """Rows of one shard after the other, from batches sorted by shard."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if r[0] != now and rows:
                yield now, rows
                rows = []
            now = r[0]
            rows.append(r)
    if rows:
        yield now, rows


@dataclass
class Model:
    """tries: a row (shard, trie) for each shard; n, v: tokens and different tokens in training; docs: training documents;
    after: rows (shard, part, blob) with the counts of the successors that a shard stores, in ranges of their hashes;
    heavy: words whose pairs lie in all shards, sorted, with their counts and different successors overall."""

    tries: DataFrame
    after: DataFrame
    shards: int
    n: int
    v: int
    docs: int
    heavy: np.ndarray
    heavy_counts: np.ndarray
    heavy_kinds: np.ndarray

    def totals(self, word: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and different successors, those of heavy words from all shards."""
        at = np.minimum(np.searchsorted(self.heavy, word), len(self.heavy) - 1)
        own = self.heavy[at] == word
        return np.where(own, self.heavy_counts[at], counts), np.where(own, self.heavy_kinds[at], kinds)

    def logp(self, count: np.ndarray) -> np.ndarray:
        """The unigram of words with these counts."""
        return np.log10((count + 1) / (self.n + self.v + 1))


def heavy_words(docs: DataFrame, text_col: str, most: int = 64, sample: int = 2000) -> np.ndarray:
    """Hashes of the most frequent words of about ``sample`` documents, and of the start: a hint for how to spread load.

    Which words these are changes where pairs are counted, never a count or a score."""
    every = max(1, docs.count() // sample)
    some = docs.select(utf8(text_col).alias("b")).filter(F.pmod(F.xxhash64("b"), F.lit(every)) == 0)
    low = F.translate(F.decode("b", "UTF-8"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = some.select(F.explode(F.split(low, "[ \\t\\n\\x0b\\f\\r]+")).alias("w")).filter("w != ''").groupBy("w").count()
    hashes = WordHashes()
    top = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(most).collect()]
    return np.unique(np.array([int(START), *(hashes[w] for w in top)], dtype=np.uint64))


def train(docs: DataFrame, text_col: str = "text", shards: int | None = None) -> Model:
    """Count all documents and build the tries."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n_shards = shards or min(MOST_SHARDS, max(partitions(spark), -(-size // SHARD)))
    heavy = heavy_words(docs, text_col)

    def count(batches):
        for _, words in _chunks(batches, []):
            out = list(blobs(words, n_shards, False, heavy))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "blob"])

    def build(batches):
        for shard, rows in _shard_rows(batches, ["shard", "blob"]):
            first, second, times = [], [], []
            for _, blob in rows:
                word, d1, d2, five, t1, t2 = unpack(blob)
                first.append(np.repeat(word, _counts(d1, d2)))
                second.append(_from_five(five))
                times.append(_counts(t1, t2))
            first, second, times = np.concatenate(first), np.concatenate(second), np.concatenate(times)
            order = np.lexsort((second, first))
            first, second, times = first[order], second[order], times[order]
            new_word = np.concatenate([[True], first[1:] != first[:-1]])
            new_pair = np.flatnonzero(new_word | np.concatenate([[True], second[1:] != second[:-1]]))
            total = np.add.reduceat(times, new_pair)
            heads = np.flatnonzero(new_word)
            word, counts = first[heads], np.add.reduceat(times, heads)
            at = np.searchsorted(new_pair, heads)
            kinds = np.diff(np.concatenate([at, [len(new_pair)]]))
            owner, many = np.repeat(np.arange(len(word)), kinds), total > 1
            trie = Trie.build(word, counts, kinds, owner[many], second[new_pair][many], (total[many] - 1).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([trie.to_bytes()], pa.binary())], names=["shard", "trie"])

    counted = docs.select(utf8(text_col).alias("body")).mapInArrow(count, "shard int, blob binary")
    tries = store(counted.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(build, "shard int, trie binary"), "tries")

    def unigrams(batches):
        for b in batches:
            for raw in b.column("trie").to_pylist():
                t = Trie.load(raw)
                yield pa.RecordBatch.from_arrays([pa.array(t.words().view(np.int64)), pa.array(np.array(t.counts, dtype=np.int64)), pa.array(np.array(t.kinds, dtype=np.int64))], names=["word", "n", "kinds"])

    seen = tries.mapInArrow(unigrams, "word long, n long, kinds long")
    start = int(START.astype(np.int64))
    is_heavy = F.col("word").isin(heavy.view(np.int64).tolist())
    spread = {r["word"]: (r["n"], r["kinds"]) for r in seen.filter(is_heavy).groupBy("word").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()}
    light = seen.filter(~is_heavy)
    row = light.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    d = spread.get(start, (0, 0))[0]
    # The start's entry stands for the end token: both occur once a document.
    total, v = (row["n"] or 0) + sum(n for n, _ in spread.values()), row["v"] + len(spread)
    return Model(tries, successor_counts(tries, n_shards), n_shards, total, v, d, heavy, *(np.array([spread.get(w, (0, 0))[k] for w in heavy.view(np.int64).tolist()], dtype=np.int64) for k in (0, 1)))


def successor_counts(tries: DataFrame, shards: int) -> DataFrame:
    """shard, part, blob: the different successors that a shard's trie stores, and how often each occurs in training.

    Shards send what they counted, and which successors they ask for, to ranges of the 40-bit hashes; a heavy word's
    counts from all shards are added up there."""

    def ranges(forty: np.ndarray):
        """(range, from, to) over sorted hashes."""
        part = forty * np.uint64(shards) >> np.uint64(SUCCESSOR_BITS)
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        return [(int(part[a]), a, z) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if a < z]

    def ask(batches):
        for b in batches:
            for shard, raw in zip(b.column("shard").to_pylist(), b.column("trie").to_pylist(), strict=True):
                t = Trie.load(raw)
                word, counts = t.words(), np.array(t.counts, dtype=np.int64)
                word = np.where(word == START, END, word) & _FORTY  # as often as texts start, they end
                order = np.argsort(word, kind="stable")
                word, counts, wanted = word[order], counts[order], np.unique(t.stored())
                out = [(p, 0, shard, pack([_five(word[a:z]), counts[a:z]])) for p, a, z in ranges(word)]
                out += [(p, 1, shard, pack([_five(wanted[a:z])])) for p, a, z in ranges(wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())], names=["part", "kind", "shard", "blob"])

    def answer(batches):
        now, got, word, counts = None, [], None, None
        for b in batches:
            out = []
            for part, kind, shard, blob in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "shard", "blob")), strict=True):
                if part != now:
                    now, got, word = part, [], None
                if kind == 0:
                    got.append(unpack(blob))
                    continue
                if word is None:
                    word, at = np.unique(np.concatenate([_from_five(x) for x, _ in got]), return_inverse=True)
                    counts, got = np.zeros(len(word), np.int64), [n for _, n in got]
                    np.add.at(counts, at, np.concatenate(got))
                    got = []
                five = unpack(blob)[0]
                out.append((shard, part, pack([five, *_small(counts[np.searchsorted(word, _from_five(five))])])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["shard", "part", "blob"])

    asked = tries.mapInArrow(ask, "part int, kind int, shard int, blob binary")
    return store(asked.repartitionById(shards, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(answer, "shard int, part int, blob binary"), "after")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, n_tokens, n_known, train_tokens, base_score and score, for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(None, None, model.shards, model.n, model.v, model.docs, model.heavy, model.heavy_counts, model.heavy_kinds))
    names = ["shard", "chunk", "kind", "blob"]
    fields = docs.select(*keep).schema

    def split(batches):
        """Kind 2: a chunk's pairs for a shard; kind 3: the chunk's rows themselves, which any shard passes on."""
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), shared.value
        for i, (rows, words) in enumerate(_chunks(batches, list(keep))):
            chunk = part << 32 | i
            table_ = pa.Table.from_arrays([pa.array([r[k] for r in rows], type=_arrow(fields[c])) for k, c in enumerate(keep)] + [pa.array([len(w) for w in words], pa.int64())], names=[*keep, "_words"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table_.schema) as w:
                w.write_table(table_)
            out = [(s, 2, x) for s, x in blobs(words, own.shards, True, own.heavy)] + [(chunk % own.shards, 3, sink.getvalue().to_pybytes())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=names)

    def look_up(batches):
        own, base_of = shared.value, None
        trie, now, after = None, None, []
        for b in batches:
            out = []
            for shard, chunk, kind, blob in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if shard != now:
                    now, trie, after, follower = shard, None, [], None
                if kind == 0:
                    trie = Trie.mapped(blob)
                elif kind == 1:
                    after.append(unpack(blob))
                elif kind == 3:
                    out.append((chunk, 0, blob))
                else:
                    if follower is None:  # parts are ranges of hashes, in order
                        follower = np.concatenate([np.zeros(0, np.uint64), *(_from_five(x[0]) for x in after)])
                        often, after = np.concatenate([np.zeros(0, np.int64), *(_counts(*x[1:]) for x in after)]), []
                    word, d1, d2, five, t1, t2, docs_ = unpack(blob)
                    pairs_of, times, second = _counts(d1, d2), _counts(t1, t2), _from_five(five)
                    at = trie.context(word) if trie else np.full(len(word), -1)
                    found = at >= 0
                    c = np.where(found, trie.counts[at], 0) if trie and len(trie.counts) else np.zeros(len(word))
                    kinds_ = np.where(found, trie.kinds[at], 0) if trie and len(trie.counts) else np.zeros(len(word))
                    c, kinds_ = own.totals(word, c, kinds_)
                    known = c > 0
                    token = word != START
                    base_of = np.where(token, own.logp(c), 0)
                    model_of = base_of + np.where(known, np.log10(np.maximum(kinds_, 1) / np.maximum(c, 1)), 0)
                    pair_word = np.repeat(np.arange(len(word)), pairs_of)
                    value = trie.values(at, pairs_of, second) if trie else np.zeros(len(second))
                    gain = np.zeros(len(second))
                    hit = value > 0
                    gain[hit] = np.log10(1 + value[hit] / kinds_[pair_word[hit]] / 10 ** own.logp(often[np.searchsorted(follower, second[hit])]))
                    each = np.repeat(np.arange(len(second)), times)
                    w = pair_word[each]
                    n_docs = int(docs_.max()) + 1
                    sums = [np.bincount(docs_, weights=x, minlength=n_docs) for x in (base_of[w], model_of[w] + gain[each], (known & token)[w])]
                    used = np.flatnonzero(np.bincount(docs_, minlength=n_docs))
                    out.append((chunk, 1, pack([used.astype("<u2"), sums[0][used], sums[1][used], sums[2][used].astype("<u4")])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=names[1:])

    def gather(batches):
        own, now, sums, rows = shared.value, None, None, None
        end = float(own.logp(np.array(own.docs)))

        def result():
            n = rows.column("_words").to_numpy()
            columns = [rows.column(c).combine_chunks() for c in keep]
            extra = [pa.array(n + 1), pa.array(np.rint(sums[2]).astype(np.int64) + (own.docs > 0)), pa.array(np.full(len(n), own.n, np.int64)), pa.array(sums[0] + end), pa.array(sums[1] + end)]
            return pa.RecordBatch.from_arrays([*columns, *extra], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            for chunk, kind, blob in zip(*(b.column(c).to_pylist() for c in names[1:]), strict=True):
                if chunk != now:
                    if rows is not None:
                        yield result()
                    now, rows = chunk, None
                if kind == 0:
                    rows = pa.ipc.open_stream(blob).read_all()
                    sums = np.zeros((3, len(rows)))
                else:
                    docs_, *parts = unpack(blob)
                    for k in range(3):
                        sums[k][docs_] += parts[k]
        if rows is not None:
            yield result()

    n = partitions(spark)
    text = docs.select(*keep, utf8(text_col).alias("body"))
    pairs = text.mapInArrow(split, "shard int, chunk long, kind int, blob binary")
    tries = model.tries.select("shard", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("kind"), F.col("trie").alias("blob"))
    after = model.after.select("shard", F.col("part").cast("long").alias("chunk"), F.lit(1).alias("kind"), "blob")
    summed = tries.union(after).union(pairs).repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard", "kind", "chunk").mapInArrow(look_up, "chunk long, kind int, blob binary")
    out = T.StructType(list(fields))
    for c in ("n_tokens", "n_known", "train_tokens"):
        out = out.add(c, T.LongType())
    out = out.add("base_score", T.DoubleType()).add("score", T.DoubleType())
    return summed.repartition(n, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(gather, out)


def _arrow(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def held_out(id_col: str = "doc_id") -> Column:
    return id_crc(id_col) % 7 == 2


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    return score(docs, train(docs.filter("not held_out")), keep=("doc_id", "held_out"))
