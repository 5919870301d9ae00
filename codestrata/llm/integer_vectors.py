"""Vectors as whole numbers, ``floor(256 * x)`` of each component in double precision, in a table that later passes read.

Rows take part if their vector is there and all its components are there and finite. The dimension is the length that most of them
have (of equally frequent lengths the shortest). A vector of another length, or with a component whose number is beyond
``limit(dimension)`` (2^27 at 64 components; sums of products beyond it would leave 64 bits), has null ``values``.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import store

SCALE = 256


def limit(dim: int) -> int:
    """The greatest magnitude of a component: four times the sum of its products over all dimensions fits into 63 bits."""
    return min(2**31 - 1, isqrt(2**60 // max(dim, 1)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components as doubles, null as NaN, and the length of each row's vector (-1 for null)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), lengths


def _finite(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which rows hold a vector of finite components."""
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, none null, as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def as_integers(rows: DataFrame, id_col: str, vector_col: str, others: dict[str, str], tag: str) -> tuple[DataFrame, int]:
    """A written table of the rows that take part: vec_id long, values array<int>, and ``others`` (name: type); and the dimension."""
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>" if "float>" not in dict(rows.dtypes)[vector_col] else "array<float>").alias("vector"), *(F.col(c).cast(t).alias(c) for c, t in others.items()))

    def sizes(batches):
        for b in batches:
            values, lengths = flat(b.column("vector"))
            n, count = np.unique(lengths[_finite(values, lengths)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(count)], names=["size", "n"])

    most = picked.select("vector").mapInArrow(sizes, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").first()
    dim = most["size"] if most else 0
    bound = limit(dim)

    def integers(batches):
        for b in batches:
            values, lengths = flat(b.column("vector"))
            keep = _finite(values, lengths)
            own = np.repeat(keep & (lengths == dim), np.maximum(lengths, 0))
            whole = np.floor(SCALE * values[own]).reshape(-1, max(dim, 1))
            fits = keep & (lengths == dim)
            fits[fits] = (np.abs(whole) <= bound).all(axis=1) if dim else False
            inside = whole[(np.abs(whole) <= bound).all(axis=1)].astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.where(fits[keep], dim, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(inside.ravel()), mask=pa.array(~fits[keep]))
            kept = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), lists, *(kept.column(c) for c in others)], names=["vec_id", "values", *others])

    schema = "vec_id long, values array<int>" + "".join(f", {c} {t}" for c, t in others.items())
    return store(picked.mapInArrow(integers, schema), tag), dim
