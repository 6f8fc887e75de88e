"""Vectors of small integers, shared by the operators that work on scaled and floored embeddings.

A component x becomes floor(scale * x) in double precision. A vector is kept as the bytes of its 32-bit integers. So that
sums of squared differences over a whole vector fit into a long, an integer beyond ``limit(length)`` (2**27 for 64
components) counts as that limit. Vectors that are null or hold null or non-finite components are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType


def limit(length: int) -> int:
    """Largest integer for vectors of this length: ``length * (2 * limit)**2`` is at most 2**62."""
    return min(math.isqrt(2**62 // max(length, 1)) // 2, 2**31 - 1)


def floored(column: pa.Array, scale: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(places of the sound vectors in a list column, their packed integers, their lengths)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    unsound = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    sound = column.is_valid().to_numpy(zero_copy_only=False) & (unsound[ends] == unsound[ends - lengths])
    kinds, kind = np.unique(lengths, return_inverse=True)
    most = np.repeat(np.array([limit(n) for n in kinds.tolist()], np.float64)[kind], lengths)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.nan_to_num(np.floor(x * scale), nan=0.0, posinf=2.0**40, neginf=-(2.0**40)), -most, most).astype("<i4")
    at = np.flatnonzero(sound)
    return at, [whole[ends[i] - lengths[i] : ends[i]].tobytes() for i in at.tolist()], lengths[at]


def integer_rows(df: DataFrame, keep: Sequence[Column], vector: str, scale: int) -> DataFrame:
    """``keep`` of the rows with a sound vector, with v (packed integers), dim and norm (sum of squares, long)."""
    picked = df.select(*keep, F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, packed, lengths = floored(b.column(b.num_columns - 1), scale)
            norms = [int((a := np.frombuffer(p, "<i4").astype(np.int64)) @ a) for p in packed]
            kept = [c.take(pa.array(at)) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary()), pa.array(lengths, pa.int32()), pa.array(norms, pa.int64())],
                names=[*b.schema.names[:-1], "v", "dim", "norm"])

    return picked.mapInArrow(run, StructType([*picked.schema.fields[:-1], StructField("v", BinaryType()), StructField("dim", IntegerType()),
        StructField("norm", LongType())]))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Packed vectors as rows of an int64 matrix; shorter ones are filled with zeros up to ``width``."""
    packed = column.to_pylist()
    if all(len(p) == 4 * width for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), width).astype(np.int64)
    out = np.zeros((len(packed), width), np.int64)
    for i, p in enumerate(packed):
        out[i, : len(p) // 4] = np.frombuffer(p, "<i4")
    return out


def long_sum(column: str) -> Column:
    """A sum that ends at the limits of long instead of passing them."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def merged_sums(parts: DataFrame, *keys: str) -> dict[tuple, dict[int, int]]:
    """Rows (keys, s array<long>) of partial sums, merged by key and position in one grouped shuffle and brought to the driver.

    Each task sends one row a key at most, and there are no more keys and positions than a model has numbers.
    """
    each = parts.select(*keys, F.posexplode("s").alias("_pos", "_s")).groupBy(*keys, "_pos").agg(F.sum("_s").alias("_total"))
    out: dict[tuple, dict[int, int]] = {}
    for r in each.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["_pos"]] = r["_total"]
    return out
