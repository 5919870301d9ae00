"""Stable ids and hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.functions.text import simhash_tokens

#: Name spaces of version-5 UUIDs.
NIL, URL = "00000000000000000000000000000000", "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(key: Column, namespace: str = NIL) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def symbol_id(language: Column, file: Column, start_byte: Column, end_byte: Column, name: Column, kind: Column) -> Column:
    return uuid5(F.concat(F.lit("sym|"), language, F.lit("|"), file, F.lit("|"), start_byte.cast("string"), F.lit("-"), end_byte.cast("string"), F.lit("|"), name, F.lit("|"), kind))


def file_id(language: Column, path: Column) -> Column:
    return uuid5(F.concat(F.lit("file|"), language, F.lit("|"), path))


def point_id(record_id: Column) -> Column:
    return uuid5(record_id, URL)


def chunk_id(file: Column, symbol_path: Column, start_byte: Column, end_byte: Column) -> Column:
    return F.sha2(F.concat_ws("|", file, symbol_path, start_byte.cast("string"), end_byte.cast("string")), 256)


def micro_id(parent: Column, order: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws("|", parent, order.cast("string"), start.cast("string"), end.cast("string")), 256)


def record_id(body: Column) -> Column:
    """An id for a record that brings none."""
    return F.concat(F.lit("rec_"), F.substring(F.sha2(body, 256), 1, 16))


def cache_key(provider: Column, project: Column, iid: Column, sha: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", provider, project, iid.cast("string"), sha), 256), 1, 12)


def idempotency_key(path: Column, line: Column, kind: Column, snippet_hash: Column) -> Column:
    """A dash stands for the line, and nothing for the path, of what has none (files and the whole)."""
    return F.concat(F.coalesce(path, F.lit("")), F.lit(":"), F.coalesce(line.cast("string"), F.lit("-")), F.lit("|"), kind, F.lit("#"), snippet_hash)


SIMHASH_BITS = 64


def simhash_of(tokens) -> int:
    """A bit for each of 64 hash bits (md5 of token trigrams): 1 where as many trigrams have it as not; a signed number.
    Under 3 tokens: 0."""
    raw = b"".join(hashlib.md5(" ".join(tokens[i : i + 3]).encode()).digest()[:8] for i in range(len(tokens) - 2))
    return _folded(raw)


def _folded(raw: bytes) -> int:
    """The majority of each bit over hashes of eight bytes."""
    if not raw:
        return 0
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    majority = bits.sum(axis=0, dtype=np.int64) * 2 >= len(bits)
    return int.from_bytes(np.packbits(majority).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: simhash_of(t.split(" ")) if t else 0)


def simhash(c: Column) -> Column:
    """SimHash of a text's tokens; an Arrow UDF, as folding 64 counters by higher-order functions is a hundred times slower."""
    # One text a row, as a batch of token lists is an object for each token of all its rows; tokens hold no space.
    return _simhash(F.array_join(simhash_tokens(c), " "))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
