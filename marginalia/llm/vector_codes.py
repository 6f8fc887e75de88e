"""Vector code compression: product quantisation by integer codebooks.

A vector of integers is cut into ``PARTS`` equal consecutive parts, and each part position has a codebook. Each round the
codebooks are broadcast (their size is that of the model, never of the data), every Arrow batch finds its parts' nearest entries
by norm expansion, ``|x|**2 - 2 x.c + |c|**2``, in exact int64 matrix products with the first least entry, and a task's sums of
each entry are merged in one grouped shuffle. Integer sums don't depend on order, so neither does any result.

Defined results: rows whose vector is null or holds null or non-finite components are left out. Vectors shorter than
the longest, and lengths that parts don't divide, are filled with zeros at the end. Ties go to the entry with the lower
index, entries start in the order of (id, vector), null ids last, and with fewer vectors than entries there are as many entries as
vectors. Repeated rows count each. Null labels are one group; labels may be of any type that has a string form. Integers beyond
the bound of :mod:`marginalia.llm.integer_vectors` count as that bound, and ``label_error`` ends at the limit of long. Empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, table
from .integer_vectors import integer_rows, long_sum, matrix, merged_sums

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, squared distance) of each row, in exact integers."""
    products = x @ entries.T
    distances = (entries * entries).sum(1)[None] - 2 * products + (x * x).sum(1)[:, None]
    at = distances.argmin(1)
    return at, distances[np.arange(len(x)), at]


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """(part, row, component) of packed vectors."""
    x = matrix(column, width)
    return np.ascontiguousarray(x.reshape(len(x), PARTS, width // PARTS).transpose(1, 0, 2))


def _sums(books, width: int):
    """Rows (part, entry, s): how many parts an entry has in this task, followed by their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        total = np.zeros((PARTS, own.shape[1], 1 + width // PARTS), np.int64)
        for b in batches:
            for p, x in enumerate(_parts(b.column(0), width)):
                at, _ = nearest(x, own[p])
                np.add.at(total[p], at, np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        part, entry = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
            pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "s"])

    return run


def _codes(books, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        for b in batches:
            found = [nearest(x, own[p]) for p, x in enumerate(_parts(b.column(2), width))]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def codebooks(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, component) after ``rounds`` rounds over all ``rows`` (vec_id, v)."""
    context = rows.sparkSession.sparkContext
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v")
    books = _parts(first, width)
    for _ in range(rounds):
        shared = context.broadcast(books)
        books = books.copy()
        for (part, entry), s in merged_sums(rows.select("v").mapInArrow(_sums(shared, width), "part int, entry int, s array<long>"), "part", "entry").items():
            books[part, entry] = [s[1 + i] // s[0] for i in range(width // PARTS)]
        shared.destroy()
    return books


def digest(numbers: np.ndarray) -> str:
    """Lower-case SHA-256 of integers in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, entries: int = ENTRIES,
    rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a sound vector; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte")
    spark = prepare(df.sparkSession)
    rows = cut(integer_rows(df, [F.col(id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label")], vector, scale).drop("norm"))
    longest = rows.agg(F.max("dim")).first()[0]
    if longest is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
            F.lit("").alias("codebooks_sha256"))
    width = -(-longest // PARTS) * PARTS
    books = codebooks(rows, width, entries, rounds)
    coded = cut(rows.select("vec_id", "label", "v").mapInArrow(_codes(spark.sparkContext.broadcast(books), width),
        "vec_id long, label string, code string, error long"))
    by_label = cut(coded.groupBy(F.col("label").alias("_label")).agg(long_sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds as chained common tables: b<r> the codebooks before round r, a<r> the parts with their nearest entries."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT n, part, e[CAST(part * len(e) / {parts} AS BIGINT) + 1 : CAST((part + 1) * len(e) / {parts} AS BIGINT)] AS x FROM v, range({parts}) AS r(part)
), b0 AS MATERIALIZED (
  SELECT part, k AS entry, x AS c FROM p JOIN (SELECT n, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v) USING (n) WHERE k < {entries}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT n, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT n, p.part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{r} USING (part)
  ) GROUP BY n, part
)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / k) AS BIGINT) ORDER BY i) AS m FROM (
      SELECT part, entry, i, sum(x[i]) AS s, count(*) AS k FROM a{r} JOIN p USING (n, part), range(1, 1 + len(x)) AS t(i) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) USING (part, entry)
)""")
    steps.append(f"""coded AS (
  SELECT n, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (n), books""")
    return "WITH " + ", ".join(steps)


SQL = _sql()
