"""Centroid clustering with Hamerly's bounds, in exact integers.

Each vector carries two bounds from round to round: an upper one on the distance to its own centroid and a lower one on the
distance to the second nearest. When centroids move, the upper bound grows by the drift of its own centroid and the
lower one shrinks by the largest drift of another. While the upper bound is under the lower one, the assignment
can't have changed and the vector isn't compared; every other, ambiguous vector gets a full scan of all centroids in
exact int64, ties to the smaller number. Bounds are doubles that are loosened by more than their rounding, so they never
decide a tie. The state of a round is written to the shared folder, and only vectors that changed their cluster send
anything: their differences of counts and sums, added up in the task, then merged by a grouped shuffle.

Defined results: only vectors with exactly ``dims`` components, none null or non-finite, are kept. Centroids start as the kept
vectors with the smallest hash of their id, ties by id, then vector; a null id hashes to nothing and comes last. With fewer vectors than
centroids there are as many centroids as vectors. Repeated rows count each; clusters without vectors keep their centroid.
Integers beyond the bound of :mod:`marginalia.llm.integer_vectors` count as that bound, and inertias end at the limit of long.
Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, table
from .integer_vectors import integer_rows, long_sum, matrix, merged_sums
from .vector_codes import digest

CENTROIDS, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, 1
#: Bounds are widened by this share at each step, far more than the rounding of a few operations.
PLAY = 1e-12
_STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double, scans int"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, in exact integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None]


def scanned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of rows by a full scan."""
    d = distances(x, centroids)
    own = d.argmin(1)
    at = np.arange(len(x))
    nearest = d[at, own]
    if d.shape[1] == 1:
        second = np.full(len(x), np.inf)
    else:
        d[at, own] = np.iinfo(np.int64).max
        second = d.min(1).astype(np.float64)
    return own, np.sqrt(nearest.astype(np.float64)) * (1 + PLAY), np.sqrt(second) * (1 - PLAY)


def loosened(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centroids moved by ``drift``."""
    other = np.array([np.delete(drift, c).max(initial=0.0) for c in range(len(drift))])
    return (upper + drift[cluster]) * (1 + PLAY), np.maximum(lower - other[cluster], 0.0) * (1 - PLAY)


def _assigned(shared, width: int):
    """The next state: bounds loosened, ambiguous vectors scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, drift = shared.value
        for b in batches:
            x = matrix(b.column(1), width)
            was = b.column(2).to_numpy(zero_copy_only=False)
            upper, lower, scans = (b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
            if drift is None:
                unsure = np.arange(len(x))
                upper, lower = upper.copy(), lower.copy()
            else:
                upper, lower = loosened(was, upper, lower, drift)
                unsure = np.flatnonzero(upper >= lower)
            cluster = was.copy()
            if len(unsure):
                cluster[unsure], upper[unsure], lower[unsure] = scanned(x[unsure], centroids)
            scans = scans.copy()
            scans[unsure] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()),
                pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(scans, pa.int32())], names=_NAMES)

    return run


def _moves(clusters: int, width: int):
    """Rows (cluster, s): how the count and the sums of a cluster change by the vectors of this task that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((clusters, 1 + width), np.int64)
        for b in batches:
            x = matrix(b.column(0), width)
            counted = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
            cluster, was = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            np.add.at(change, cluster, counted)
            np.subtract.at(change, was[was >= 0], counted[was >= 0])
        at = np.flatnonzero(change.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(change[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "s"])

    return run


def _measured(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap = matrix(b.column(1), width) - shared.value[b.column(2).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array((gap * gap).sum(1), pa.int64()), b.column(6)],
                names=["vec_id", "cluster", "distance", "scans"])

    return run


def cluster(df: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED,
    id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scans (full scans it took) of every kept vector."""
    spark = prepare(df.sparkSession)
    kept = cut(integer_rows(df.where(F.size(vector) == dims), [F.col(id).cast("long").alias("vec_id")], vector, scale).select("vec_id", "v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "vec_id", "v").limit(centroids).select("v").toArrow().column("v")
    means = matrix(first, dims)
    tail = [F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
    if not len(means):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *tail, F.lit("").alias("centroid_sha256"),
            F.lit(0).alias("scans"))
    state = kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"),
        F.lit(0).alias("scans"))
    totals, drift = [[0] * (1 + dims) for _ in means], None
    for r in range(rounds + 1):
        state = cut(state.mapInArrow(_assigned(spark.sparkContext.broadcast((means, drift)), dims), _STATE))
        if r == rounds:
            break
        moved = state.where("cluster != was").select("v", "cluster", "was")
        for (c,), s in merged_sums(moved.mapInArrow(_moves(len(means), dims), "cluster int, s array<long>"), "cluster").items():
            totals[c] = [t + s[i] for i, t in enumerate(totals[c])]
        after = np.array([[x // t[0] for x in t[1:]] if t[0] else m for t, m in zip(totals, means.tolist(), strict=True)], np.int64).reshape(means.shape)
        drift = np.sqrt(((after - means) ** 2).sum(1).astype(np.float64)) * (1 + PLAY)
        means = after
    measured = cut(state.mapInArrow(_measured(spark.sparkContext.broadcast(means), dims), "vec_id long, cluster int, distance long, scans int"))
    inertia = {r.cluster: r.i for r in measured.groupBy("cluster").agg(long_sum("distance").alias("i")).collect()}  # a row a centroid
    total = min(sum(inertia.values()), 2**63 - 1)
    named = spark.createDataFrame([(c, i, total, digest(means[c])) for c, i in sorted(inertia.items())],
        "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(named), F.col("cluster") == F.col("_c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        "centroid_sha256", "scans")  # named has a row a centroid


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("scans")


def _sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED) -> str:
    """The rounds as chained common tables: c<r> the centroids before round r, a<r> the vectors with their nearest centroids."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, vec_id, e) - 1 AS cluster, e AS c FROM v QUALIFY cluster < {centroids}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT n, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT n, cluster, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r}
  ) GROUP BY n
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(CAST(floor(s / k) AS BIGINT) ORDER BY i) AS m FROM (
      SELECT cluster, i, sum(e[i]) AS s, count(*) AS k FROM a{r} JOIN v USING (n), range(1, {dims + 1}) AS t(i) GROUP BY cluster, i
    ) GROUP BY cluster
  ) USING (cluster)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (n) JOIN c{rounds} USING (cluster)"""


SQL = _sql()
