"""Vector compression by product codes in whole numbers.

Vectors become integers (``integer_vectors``) in a table that all passes read. The codebooks, at most ``entries`` rows of a part
for each of ``parts`` parts, are broadcast; Arrow batches compute the distances to all entries as |x|^2 - 2 x.c + |c|^2
with exact int64 matrix products and take the first least. In each round a task sums the parts of each entry, a grouped
shuffle merges the sums (at most parts x entries x width rows), and the driver divides them.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a vector of another length than
most, or beyond the exact range, keeps its row with null code and error; the codebooks start from rows with an id, of repeated
ids in the order of their vectors; with fewer rows than entries there are as many entries; parts are equal, behind zeros where
``parts`` does not divide the length; entries that no part chose stay; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import spread_join, store, table
from codestrata.llm.integer_vectors import as_integers, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, dimension) as int64 (parts, rows, width), with zeros behind."""
    width = -(-x.shape[1] // parts)
    padded = np.zeros((len(x), parts * width), dtype=np.int64)
    padded[:, : x.shape[1]] = x
    return np.ascontiguousarray(padded.reshape(len(x), parts, width).transpose(1, 0, 2))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each part of each row, and its squared distance: (parts, rows) both."""
    d = (x * x).sum(axis=2)[:, :, None] - 2 * np.matmul(x, books.transpose(0, 2, 1)) + (books * books).sum(axis=2)[:, None, :]
    code = d.argmin(axis=2)
    return code, np.take_along_axis(d, code[:, :, None], axis=2)[:, :, 0]


def _parts_of(b: pa.RecordBatch, parts: int) -> np.ndarray:
    return cut(matrix(b.column("values")), parts)


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of integers from a table of ``as_integers``; None if no vector can start them."""
    spark, usable = vectors.sparkSession, vectors.filter(F.col("values").isNotNull())
    first = usable.filter(F.col("vec_id").isNotNull()).orderBy("vec_id", "values").limit(entries).collect()
    if not first:
        return None
    books = cut(np.array([r["values"] for r in first], dtype=np.int64), parts)
    shape = books.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches, shared=shared):
            total, count = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = _parts_of(b, parts)
                code, _ = nearest(x, shared.value)
                for p in range(parts):
                    count[p] += np.bincount(code[p], minlength=shape[1])
                    order = np.argsort(code[p], kind="stable")
                    used, start = np.unique(code[p][order], return_index=True)
                    total[p, used] += np.add.reduceat(x[p][order], start, axis=0)
            slot = np.flatnonzero(np.repeat(count.ravel() > 0, shape[2]))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total.ravel()[slot]), pa.array(count.ravel()[slot // shape[2]])], names=["slot", "total", "n"])

        merged = usable.select("values").mapInArrow(sums, "slot int, total long, n long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(19,0)")).alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in merged:
            books.reshape(-1)[r["slot"]] = int(r["total"]) // r["n"]
        shared.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray | None, parts: int = PARTS) -> DataFrame:
    """``vectors`` with code and error in place of values."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    others = [c for c in vectors.columns if c != "values"]

    def run(batches):
        for b in batches:
            has = b.column("values").is_valid()
            code, error = np.full(b.num_rows, None, dtype=object), np.zeros(b.num_rows, dtype=np.int64)
            at = np.flatnonzero(has.to_numpy(zero_copy_only=False))
            if len(at) and shared.value is not None:
                best, d = nearest(_parts_of(b.filter(has), parts), shared.value)
                text = best.T.astype(np.uint8).tobytes().hex()
                code[at] = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(at))]
                error[at] = d.sum(axis=0)
            coded = pa.array(code, pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), coded, pa.array(error, mask=~coded.is_valid().to_numpy(zero_copy_only=False))], names=[*others, "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", code string, error long")


def fingerprint(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (of all rows of a label, null being one), codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    labelled = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("-")).alias("label"))
    vectors, dim = as_integers(labelled, "vec_id", "vector", {"label": "string"}, "integers")
    books = train(vectors, dim, parts, entries, rounds)
    coded = store(encode(vectors, books, parts), "codes")
    labels = store(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    out = spread_join(coded, labels, ["label"], "_n", ["vec_id", "code"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    near = """pair{k} AS (
  SELECT x.rid, x.part, x.v, c.entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM part x JOIN book{k} c USING (part)),
near{k} AS MATERIALIZED (SELECT rid, part, min(d) AS d, arg_min(entry, d * 64 + entry) AS entry, any_value(v) AS v FROM pair{k} GROUP BY rid, part)"""
    book = """book{n} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY pos) AS v FROM (
      SELECT part, entry, pos, sum(v[pos])::BIGINT AS s, count(*) AS n FROM near{k}, range(1, 5) t(pos) GROUP BY part, entry, pos) GROUP BY part, entry) m USING (part, entry))"""
    steps = [near.format(k=0), book.format(k=0, n=1), near.format(k=1), book.format(k=1, n=2), near.format(k=2)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT rid, p AS part, v[4 * p + 1 : 4 * p + 4] AS v FROM kept, range(16) t(p)),
book0 AS (SELECT part, rid AS entry, v FROM part WHERE rid < 64),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (rid)"""


ORACLE = {"op12_vector_codes": _oracle()}
